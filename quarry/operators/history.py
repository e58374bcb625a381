"""Questions about stored histories: summaries, handoff, repair, error logs, counters, mixed search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import content_words, identifier, once
from quarry.operators.retrieval import RRF_K, best_of, disclose, rank_of, reciprocal_rank_fusion, substring_search
from quarry.operators.tables import truncated

SUMMARY_FIELDS = ("request", "investigated", "learned", "completed", "next_steps")


def summary_search(summaries: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Summaries with any content word of the query in any field, newest first; without words, all."""
    wanted = F.array_distinct(content_words(F.lit(query)))
    whole = F.lower(F.concat_ws("\n", *SUMMARY_FIELDS))
    hit = once(whole, lambda t: F.exists(wanted, lambda w: F.contains(t, w)) | (F.size(wanted) == 0))
    return summaries.filter(hit).orderBy(F.desc_nulls_last("generated_at"), "session_id").limit(limit)


def real_summaries(summaries: DataFrame) -> DataFrame:
    """Without summaries of synthetic models, but for benchmark projects."""
    return summaries.filter(~F.col("model").startswith("synth-") | F.col("project").endswith("-bench"))


def handoff(summaries: DataFrame, observations: DataFrame, project: str, current: str | None = None, newest: int = 5) -> DataFrame:
    """(kind, title, ts): the project's latest summary and newest observations, of other sessions."""
    own = lambda df: df.filter((F.col("project") == project) & (F.lit(current is None) | (F.col("session_id") != F.lit(current or ""))))
    last = own(summaries).orderBy(F.desc("generated_at"), "session_id").limit(1)
    recent = own(observations).orderBy(F.desc("ts"), "title").limit(newest)
    return last.select(F.lit("summary").alias("kind"), F.concat_ws(" ", *SUMMARY_FIELDS).alias("title"), F.col("generated_at").alias("ts")).unionByName(
        recent.select("kind", "title", "ts")
    )


def newest_that_fit(turns: DataFrame, budget: int, most: int = 200, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """The newest turns of each session whose texts fit the budget, to be read oldest first."""
    w = Window.partitionBy(*by).orderBy(F.desc("idx"))
    placed = turns.withColumns({"_n": F.row_number().over(w), "_used": F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.filter((F.col("_n") <= most) & (F.col("_used") <= budget)).drop("_n", "_used")


def rule_digest(turns: DataFrame) -> DataFrame:
    """(session_id, request, learned): first user line, and first line that tells of a finding."""
    line = F.substring(F.regexp_extract(F.trim("content"), r"^([^\n]+)", 1), 1, 200)
    found = F.nullif(F.regexp_extract("content", r"(?im)^\W*((?:learned|found|discovered|fixed|turns out|root cause)\b[^\n]*)", 1), F.lit(""))
    return turns.groupBy("session_id").agg(
        F.min_by(F.when(F.col("role") == "user", line), F.when(F.col("role") == "user", F.col("idx"))).alias("request"),
        F.min_by(found, F.when(found.isNotNull(), F.col("idx"))).alias("learned"),
    )


def restorable(live: DataFrame, backup: DataFrame) -> DataFrame:
    """(session_id, reason): sessions that are gone, or shorter than their backup, by bytes."""
    a = backup.select("session_id", F.col("bytes").alias("stored"))
    b = live.select(F.col("session_id").alias("_s"), F.col("bytes").alias("live"))
    joined = a.join(b, F.col("session_id") == F.col("_s"), "left")
    reason = F.when(F.col("live").isNull(), "deleted").when(truncated(F.col("live"), F.col("stored")), "truncated")
    return joined.select("session_id", reason.alias("reason")).filter("reason is not null")


def repair(live: DataFrame, stored: DataFrame) -> DataFrame:
    """(session_id, idx, uuid, content, source): live entries, and stored ones that are missing, in order.

    Entries are matched by uuid. An entry whose live text is empty is taken from the store.
    """
    b = live.select(F.col("session_id").alias("s2"), F.col("uuid").alias("u2"), F.col("idx").alias("i2"), F.col("content").alias("c2"))
    same = (F.col("session_id") == F.col("s2")) & (F.col("uuid") == F.col("u2"))
    joined = stored.join(b, same, "full_outer")
    whole = F.coalesce("c2", F.lit("")) != ""
    return joined.select(
        F.coalesce("session_id", "s2").alias("session_id"), F.coalesce("idx", "i2").alias("idx"), F.coalesce("uuid", "u2").alias("uuid"),
        F.when(whole, F.col("c2")).otherwise(F.coalesce("content", "c2")).alias("content"), F.when(whole, "live").otherwise("stored").alias("source"),
    )


def stub_transcripts(files: DataFrame, largest: int = 500) -> DataFrame:
    """Paths of files (path, length, text) that hold one title line of their own session and nothing else."""
    one_line = F.size(F.filter(F.split(F.col("text"), "\n"), lambda s: F.trim(s) != "")) == 1
    own = F.get_json_object("text", "$.sessionId") == F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    return files.filter((F.col("length") <= largest) & one_line & (F.get_json_object("text", "$.type") == "ai-title") & own).select("path")


def recent_errors(spark: SparkSession, path: str, limit: int = 50, component: str | None = None, level: str | None = None, since: str | None = None) -> DataFrame:
    """Newest lines of rotated logs of JSON objects (ts, level, component, message)."""
    rows = spark.read.schema("ts string, level string, component string, message string").json(path)
    if component:
        rows = rows.filter(F.col("component").startswith(component))
    if level:
        rows = rows.filter(F.col("level") == level)
    if since:
        rows = rows.filter(F.try_to_timestamp("ts") >= F.lit(since).cast("timestamp"))
    return rows.orderBy(F.desc("ts"), "message").limit(limit)


def count_names(memory: DataFrame, seen: DataFrame) -> DataFrame:
    """The counter table (project, name, domain, n, status, notes) after sightings (project, name, domain)."""
    keys = ["project", "name", "domain"]
    new = seen.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = memory.join(new, keys, "full_outer")
    return joined.select(*keys, (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("status", F.lit("open")).alias("status"), "notes")


def triage(memory: DataFrame, decisions: DataFrame) -> DataFrame:
    """Statuses replaced by decisions (project, name, domain, status, notes); notes stay where none is given."""
    keys = ["project", "name", "domain"]
    d = decisions.select(*keys, F.col("status").alias("_s"), F.col("notes").alias("_t"))
    joined = memory.join(d, keys, "left")
    return joined.select(*keys, "n", F.coalesce("_s", "status").alias("status"), F.coalesce("_t", "notes").alias("notes"))


def mixed_search(lists: dict[str, DataFrame], limit: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by..., kind, id, score) of rankings (by..., id, score) by kind. Several kinds are fused by rank;
    one is returned as it is.

    Hits too far down their lists to come among the first ``limit`` of the fusion are cut before it.
    """
    tagged = [df.select(*by, F.concat_ws(":", F.lit(kind), F.col("id").cast("string")).alias("id"), "score") for kind, df in lists.items()]
    if len(tagged) == 1:
        out = tagged[0]
    else:
        reach = len(tagged) * (RRF_K + 1 + limit)
        cut = [best_of(t, [F.desc("score"), F.asc("id")], reach, by) for t in tagged]
        out = reciprocal_rank_fusion([rank_of(t, by) for t in cut], by=by).select(*by, "id", F.col("rrf_score").alias("score"))
    parts = F.split("id", ":", 2)
    return best_of(out.select(*by, parts[0].alias("kind"), parts[1].alias("id"), "score"), [F.desc("score"), F.asc("kind"), F.asc("id")], limit, by)


def weighted_hybrid(lexical: DataFrame, semantic: DataFrame, alpha: float = 0.5, limit: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by..., id, score): scores scaled to 0..1 within each list and mixed, ``alpha`` for the vectors."""

    def scaled(df: DataFrame, weight: float) -> DataFrame:
        lo, hi = F.col("_ends.lo"), F.col("_ends.hi")
        ends = df.groupBy(*by).agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")).alias("_ends"))
        span = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0)
        joined = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))  # one row
        return joined.select(*by, "id", (span * weight).alias("score"))

    both = scaled(lexical, 1 - alpha).union(scaled(semantic, alpha))
    return best_of(both.groupBy(*by, "id").agg(F.sum("score").alias("score")), [F.desc("score"), F.asc("id")], limit, by)


def global_search(spark: SparkSession, corpus: DataFrame, primary: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, source, rank): a search's hits, then texts that hold the query's identifier literally."""
    first = rank_of(best_of(primary, [F.desc("score"), F.asc("id")], limit)).select("id", F.lit("search").alias("source"), "rank")
    needle = spark.range(1).select(identifier(F.lit(query)).alias("i")).first()["i"]
    if needle is None:
        return first.orderBy("rank").limit(limit)
    literal = substring_search(corpus, [needle]).join(first, "id", "left_anti").select("id").orderBy(F.desc("id")).limit(limit)
    # at most ``limit`` rows are numbered in one place
    placed = literal.select("id", F.lit("literal").alias("source"), (F.row_number().over(Window.orderBy(F.desc("id"))) - 1).alias("rank"))
    return first.orderBy("rank").limit(limit).unionByName(placed).orderBy(F.desc("source"), "rank").limit(limit)


def recall_in_time(hits: DataFrame, threshold: float, budget: int, size: Column) -> DataFrame:
    """Hits of at least a threshold, best first, as far as a budget goes; nothing below the threshold."""
    return disclose(hits.filter(F.col("score") >= threshold), budget, [F.desc("score"), F.asc("id")], size)


def markers_found(responses: DataFrame, markers: DataFrame) -> DataFrame:
    """(query_id, found): whether a response holds all markers (query_id, markers) of its query."""
    joined = responses.join(markers, "query_id")
    return joined.select("query_id", F.forall("markers", lambda m: F.contains(F.col("response"), m)).alias("found"))
