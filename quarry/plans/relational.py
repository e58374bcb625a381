"""Reporting queries over sessions, events and reference tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import CONTENT_WORD, STOPWORDS, query_tokens
from quarry.operators import history, ranking, retrieval, tables
from quarry.scope import Scope
from quarry.session import load
from quarry.streaming import attribution, incremental

AS_OF = "2024-01-31 00:00:00"
SIGNALS = {"view": 1, "purchase": 3, "error": -3}
MICROS = "unix_micros({})"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "conv_id", "turn", "role", F.col("text").alias("content")
    )


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.lit(None).cast("int")
    for kind, w in SIGNALS.items():
        weight = F.when(F.col("event_type") == kind, w).otherwise(weight)
    return load(spark, sf, "events").select(F.col("user_id").alias("turn_id"), "ts", weight.alias("weight")).filter("weight is not null")


FEEDBACK_SQL = "SELECT user_id AS turn_id, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN -3 END AS weight FROM events WHERE event_type IN ('view', 'purchase', 'error')"


def user_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).filter("role = 'user' and content is not null").select("turn_id", "conv_id", "content")


def errors_with_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").filter("event_type = 'error'")
    return rows.select("event_id", "user_id", F.unix_micros("ts").alias("at"), F.substring("props", 1, 1000).alias("preview"))


def errors_by_tool(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").filter("event_type = 'error'").groupBy(F.get_json_object("props", "$.k").alias("tool"))
    return rows.agg(F.count("*").alias("errors"), F.unix_micros(F.max("ts")).alias("last_at")).orderBy(F.desc("errors"), "tool").limit(10)


def files_ilike(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").filter(F.contains(F.lower("url"), F.lit("blog."))).select("page_id", "url")


def sessions_recent(spark: SparkSession, sf: str) -> DataFrame:
    per = turns(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"), F.sum(F.length("content")).alias("chars"))
    return per.orderBy(F.desc_nulls_last("last_turn"), F.desc("conv_id")).limit(20)


def corpus_status(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("sessions"))
    d = load(spark, sf, "documents").agg(F.count("*").alias("documents"), F.max("n_chars").alias("longest"))
    e = load(spark, sf, "events").agg(F.count("*").alias("events"), F.unix_micros(F.max("ts")).alias("last_at"))
    v = load(spark, sf, "embeddings").agg(F.count("*").alias("vectors"))
    one = t.crossJoin(d).crossJoin(e).crossJoin(v)  # four rows of one row each
    return one.withColumn("drifted", tables.drifted(F.col("vectors"), F.col("documents")))


def sessions_per_project_top10(spark: SparkSession, sf: str) -> DataFrame:
    joined = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("project")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(10)


def filtered_signal_counts(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["view", "click", "purchase", "error", "signup"]
    counts = [F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds]
    return load(spark, sf, "events").groupBy("user_id").agg(*counts, F.count("*").alias("n"))


def popularity_decay(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.popularity(feedback(spark, sf), AS_OF).withColumn("popularity", F.round("popularity", 6))


def popularity_boost(spark: SparkSession, sf: str) -> DataFrame:
    base = load(spark, sf, "events").groupBy(F.col("user_id").alias("turn_id")).agg(F.avg("value").alias("score"))
    joined = base.join(ranking.popularity(feedback(spark, sf), AS_OF), "turn_id", "left")
    return joined.select("turn_id", F.round(ranking.boost(F.col("score"), F.col("popularity")), 6).alias("boosted"))


def decl_collapse(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part").withColumn("canonical", F.col("p_type").startswith("STANDARD"))
    return rows.groupBy("p_brand").agg(
        F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"),
        F.min_by("p_name", F.struct(~F.col("canonical"), F.col("p_partkey"))).alias("first_name"),
        F.max("p_size").alias("largest"),
        F.bool_or(F.col("p_size") >= 50).alias("any_large"),
    )


def latest_open_trial(spark: SparkSession, sf: str) -> DataFrame:
    views = load(spark, sf, "events").filter("event_type = 'view'")
    return tables.latest(views, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", F.unix_micros("ts").alias("at"))


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    hits = load(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "ts", "value")
    return ranking.trials(hits, F.col("value"), F.col("ts"), ["user_id"])


def ranking_trials(spark: SparkSession, sf: str) -> DataFrame:
    return _trials(spark, sf).select("id", "user_id", "champion_rank", "challenger_rank")


def arbiter_window(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.arbiter(_trials(spark, sf), 1000).withColumn("win_rate", F.round("win_rate", 6))


THRESHOLDS = [round(0.30 + 0.05 * i, 2) for i in range(11)]


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    joined = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    outcome = F.when(F.col("quality") == 1, "accepted").when(F.col("toxic") == 1, "corrected").otherwise("rejected")
    rows = joined.select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("sim"), outcome.alias("outcome"))
    swept = ranking.threshold_sweep(rows, THRESHOLDS)
    return swept.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return threshold_sweep(spark, sf).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"))


def models_with_field_counts(spark: SparkSession, sf: str) -> DataFrame:
    n, s = load(spark, sf, "nation"), load(spark, sf, "supplier")
    return n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("fields"))


def last_turn_per_session(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf)
    last = t.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count("*").alias("n"))
    return last.join(t, ["conv_id", "turn"], "left").select("conv_id", "turn", "n", "role")


def missing_sessions(spark: SparkSession, sf: str) -> DataFrame:
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def wanted_sessions(spark: SparkSession, sf: str) -> DataFrame:
    o, c = load(spark, sf, "orders").filter("o_totalprice > 300000"), load(spark, sf, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    before = docs.select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    kept = docs.join(load(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, F.md5("text")).otherwise(F.md5(F.concat("text", F.lit("!")))).alias("hash")
    )
    added = load(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("path"), F.md5("text").alias("hash"))
    return tables.snapshot_diff(before, kept.union(added))


def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    scope = Scope.parse("EUROPE,ASIA")
    hidden = Scope.parse("-FRANCE,-JAPAN")
    r, n, c = load(spark, sf, "region"), load(spark, sf, "nation"), load(spark, sf, "customer")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.filter(scope.predicate("r_name") & hidden.predicate("n_name")).select("c_custkey", "n_name", "r_name")


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    old, new = e.filter("ts < timestamp'2024-01-15'"), e.filter("ts >= timestamp'2024-01-15'")
    merged = tables.upsert(
        tables.latest(old, ["user_id", "event_type"], [F.desc("ts")]), tables.latest(new, ["user_id", "event_type"], [F.desc("ts")]), ["user_id", "event_type"], "ts"
    )
    return merged.select("user_id", "event_type", "event_id", "value")


def retention_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return tables.keep_newest(load(spark, sf, "events"), 5, [F.desc("ts"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id")


def attribution_60s(spark: SparkSession, sf: str) -> DataFrame:
    return _attributed(spark, sf, 60)


def attribution_1h(spark: SparkSession, sf: str) -> DataFrame:
    return _attributed(spark, sf, 3600)


def _attributed(spark: SparkSession, sf: str, seconds: int) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "ts", "event_type")
    made = incremental.attribute(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "user_id", seconds)
    return made.select("user_id", F.unix_micros("used_ts").alias("used_at"), F.unix_micros("shown_ts").alias("shown_at"))


def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    made = incremental.tumbling(load(spark, sf, "events"), "1 day", "event_type")
    return made.select(F.unix_micros("window_start").alias("day"), "event_type", "n")


def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    made = incremental.session_windows(load(spark, sf, "events"), "30 minutes", "user_id")
    return made.select("user_id", F.unix_micros("session_start").alias("started"), "n")


def paged_sessions(spark: SparkSession, sf: str) -> DataFrame:
    per = turns(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "conv_id").offset(10).limit(10)


def session_export(spark: SparkSession, sf: str) -> DataFrame:
    cut = tables.running_cut(turns(spark, sf), 1000, F.length("content"), [F.asc("turn"), F.asc("turn_id")], ["conv_id"])
    return cut.select("turn_id", "conv_id", F.coalesce(F.substring("content", 1, 200), F.lit("")).alias("preview"))


def expand_turns(spark: SparkSession, sf: str) -> DataFrame:
    wanted = turns(spark, sf).groupBy("conv_id").agg(F.max_by("turn_id", F.struct(F.length("content"), -F.col("turn"))).alias("turn_id"))
    return turns(spark, sf).join(wanted.select("turn_id"), "turn_id", "left_semi").select("turn_id", "role", "content")


def status_by_role(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("sessions"), F.sum(F.length("content")).alias("chars"))


def project_digest(spark: SparkSession, sf: str) -> DataFrame:
    users = turns(spark, sf).filter("role = 'user'")
    return tables.even_sample(users, 50, [F.asc("turn_id")], ["turn"]).select("turn_id", "turn")


def topic_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns(spark, sf).filter("role = 'user'").withColumn("key", F.substring(F.lower("content"), 1, 60))
    return tables.latest(rows, ["key"], [F.asc("turn_id")]).select("turn_id", F.substring("content", 1, 80).alias("title"))


def observation_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = retrieval.any_token_matches(load(spark, sf, "documents"), "an erthe worthless there heron", F.col("text"))
    return hits.orderBy(F.desc("match_count"), F.desc("doc_id")).limit(25).select("doc_id", "match_count")


def find_sessions(spark: SparkSession, sf: str) -> DataFrame:
    words = query_tokens(F.col("content"))
    hits = turns(spark, sf).select(F.col("conv_id").alias("session_id"), F.col("turn_id").alias("id"), F.size(words).alias("score"))
    best = retrieval.best_per_session(hits.filter("score > 0"))
    return best.orderBy(F.desc("best_score"), F.desc("match_count"), "session_id").limit(20)


def popularity_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").groupBy("event_type")
    return e.agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


def errors_window_5(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback, sessions and customers in one: newest signals of the window with who gave them."""
    recent = feedback(spark, sf).filter(F.col("ts") > F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 90 DAYS"))
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    joined = recent.join(c, F.col("turn_id") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def newest_turns_fit(spark: SparkSession, sf: str) -> DataFrame:
    t = turns(spark, sf).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "turn_id", "content")
    return history.newest_that_fit(t, 1500).select("turn_id", F.col("session_id").alias("conv_id"))


def restorable_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """What would be restored if only the users' turns were left."""
    size = lambda df: df.groupBy(F.col("conv_id").alias("session_id")).agg(F.sum(F.octet_length("content")).alias("bytes"))
    t = turns(spark, sf)
    return history.restorable(size(t.filter("role = 'user'")), size(t))


def repair_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Histories without the assistant's turns, repaired from the whole."""
    t = turns(spark, sf).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), F.col("turn_id").cast("string").alias("uuid"), "content", "role")
    fixed = history.repair(t.filter("role <> 'assistant'").drop("role"), t.drop("role"))
    return fixed.select("session_id", "idx", "uuid", F.md5("content").alias("content_md5"), "source")


def name_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A counter of customers' segments by nation, after the suppliers of each nation are sighted."""
    c = load(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("project")).agg(F.count("*").alias("n"))
    memory = c.select("project", F.lit("party").alias("name"), F.lit("trade").alias("domain"), "n", F.lit("kept").alias("status"), F.lit(None).cast("string").alias("notes"))
    seen = load(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("project"), F.lit("party").alias("name"), F.lit("trade").alias("domain"))
    return history.count_names(memory, seen).select("project", "n", "status")


_T = "(SELECT conv_id * 1000 + turn AS turn_id, conv_id, turn, role, text AS content FROM conversations)"
_POP = f"""SELECT turn_id, sum(weight * exp(-(epoch(TIMESTAMP '{AS_OF}') - epoch(ts))::DOUBLE / (14 * 86400.0::DOUBLE))) AS popularity
FROM ({FEEDBACK_SQL}) WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY turn_id"""
# ages count whole seconds, as the engine's do
_POP = _POP.replace("epoch(ts)", "floor(epoch(ts))")
_TRIALS = """SELECT event_id AS id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS champion_rank,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS challenger_rank FROM events"""
_SWEEP = f"""SELECT t AS threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
FROM (SELECT t, count(*) FILTER (sim >= t AND o = 'accepted') AS tp, count(*) FILTER (sim >= t AND o = 'rejected') AS fp, count(*) FILTER (sim < t AND o = 'corrected') AS fn
FROM (SELECT least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS sim, CASE WHEN quality = 1 THEN 'accepted' WHEN toxic = 1 THEN 'corrected' ELSE 'rejected' END AS o
FROM documents JOIN labels USING (doc_id)), (SELECT unnest([{", ".join(map(str, THRESHOLDS))}])::DOUBLE AS t) GROUP BY t))"""

_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(content, '')), '{CONTENT_WORD}', 0), lambda w: NOT list_contains({STOPWORDS}, w)))"
_SESSIONS = f"""SELECT conv_id AS session_id, arg_max(turn_id, struct_pack(s := score, t := -turn_id)) AS best_id, max(score) AS best_score, count(*) AS match_count
FROM (SELECT conv_id, turn_id, len({_WORDS})::INTEGER AS score FROM {_T}) WHERE score > 0 GROUP BY 1 ORDER BY best_score DESC, match_count DESC, session_id LIMIT 20"""
_USED = """SELECT p.user_id, epoch_us(p.ts) AS used_at, epoch_us(max(v.ts)) AS shown_at FROM events p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view'
AND v.ts <= p.ts AND p.ts <= v.ts + INTERVAL {} SECOND WHERE p.event_type = 'purchase' GROUP BY p.user_id, p.ts"""

def attributed_expands(spark: SparkSession, sf: str) -> DataFrame:
    """Views as queries, clicks as trials and purchases as expands of sessions, closer in time: what led to each
    expand. Which trial it decides is left to the tests, as SQL has no such fold."""
    kind = F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "click", "trial").when(F.col("event_type") == "purchase", "expand")
    e = load(spark, sf, "events").withColumn("kind", kind).filter("kind is not null")
    rows = e.select(
        (F.col("user_id") % 15).cast("string").alias("session"), F.timestamp_micros(F.floor(F.unix_micros("ts") / 600).cast("long")).alias("ts"), "kind", F.col("event_id").alias("id"),
        F.when(F.col("kind") != "expand", F.concat(F.lit("q"), F.col("event_id") % 5)).alias("query"), F.when(F.col("kind") != "query", F.col("event_id") % 3).alias("turn_id"),
        F.when(F.col("kind") == "trial", F.col("event_id")).alias("trial_id"),
    )
    return attribution.attributed(rows).select("session", "id", "turn_id", "query")


SQL = {
    "attributed_expands": """WITH e AS (SELECT (user_id % 15)::VARCHAR AS session, epoch_us(ts) // 600 AS us, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS k, event_id AS id, 'q' || event_id % 5 AS query, event_id % 3 AS turn
FROM events WHERE event_type IN ('view', 'click', 'purchase')),
w AS (SELECT *, last_value(CASE WHEN k = 1 THEN struct_pack(us := us, query := query) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY us, k, id ROWS UNBOUNDED PRECEDING) AS q FROM e)
SELECT session, id, turn AS turn_id, q.query AS query FROM w WHERE k = 3 AND us - q.us <= 60000000""",
    "user_prompts": f"SELECT turn_id, conv_id, content FROM {_T} WHERE role = 'user' AND content IS NOT NULL",
    "errors_with_context": "SELECT event_id, user_id, epoch_us(ts) AS at, substr(props, 1, 1000) AS preview FROM events WHERE event_type = 'error'",
    "errors_by_tool": "SELECT json_extract_string(props, '$.k') AS tool, count(*) AS errors, epoch_us(max(ts)) AS last_at FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY errors DESC, tool LIMIT 10",
    "files_ilike": "SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog.')",
    "sessions_recent": f"SELECT conv_id, count(*) AS n, max(turn) AS last_turn, sum(length(content))::BIGINT AS chars FROM {_T} GROUP BY conv_id ORDER BY last_turn DESC NULLS LAST, conv_id DESC LIMIT 20",
    "corpus_status": f"""SELECT *, abs(vectors - documents) > greatest(50.0, documents * 0.05) AS drifted FROM
(SELECT count(*) AS turns, count(DISTINCT conv_id) AS sessions FROM {_T}), (SELECT count(*) AS documents, max(n_chars) AS longest FROM documents),
(SELECT count(*) AS events, epoch_us(max(ts)) AS last_at FROM events), (SELECT count(*) AS vectors FROM embeddings)""",
    "sessions_per_project_top10": "SELECT n_name AS project, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, project LIMIT 10",
    "filtered_signal_counts": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("view", "click", "purchase", "error", "signup")) + ", count(*) AS n FROM events GROUP BY user_id",
    "popularity_decay": f"SELECT turn_id, round(popularity, 6) AS popularity FROM ({_POP})",
    "popularity_boost": f"""SELECT turn_id, round(score * (1 + CASE WHEN coalesce(popularity, 0) > 0 THEN ln(1 + popularity) ELSE 0 END), 6) AS boosted
FROM (SELECT user_id AS turn_id, avg(value) AS score FROM events GROUP BY 1) LEFT JOIN ({_POP}) USING (turn_id)""",
    "decl_collapse": """SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types,
first(p_name ORDER BY NOT starts_with(p_type, 'STANDARD'), p_partkey) AS first_name, max(p_size) AS largest, bool_or(p_size >= 50) AS any_large FROM part GROUP BY p_brand""",
    "latest_open_trial": "SELECT DISTINCT ON (user_id) user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'view' ORDER BY user_id, ts DESC, event_id DESC",
    "ranking_trials": f"SELECT id, user_id, champion_rank, challenger_rank FROM ({_TRIALS})",
    "arbiter_window": f"""SELECT wins, losses, ties, round(rate, 6) AS win_rate, CASE WHEN wins + losses >= 1000 AND rate >= 0.6 THEN 'promote'
WHEN wins + losses >= 500 AND rate < 0.5 THEN 'demote' ELSE 'hold' END AS decision FROM (SELECT *, CASE WHEN wins + losses > 0 THEN wins / (wins + losses) ELSE 0 END AS rate FROM (
SELECT count(*) FILTER (challenger_rank < champion_rank) AS wins, count(*) FILTER (challenger_rank > champion_rank) AS losses,
count(*) FILTER (challenger_rank = champion_rank) AS ties FROM (SELECT * FROM ({_TRIALS}) ORDER BY ts DESC, id DESC LIMIT 1000)))""",
    "threshold_sweep": _SWEEP,
    "best_threshold": f"SELECT threshold FROM ({_SWEEP}) ORDER BY f1 DESC, threshold LIMIT 1",
    "models_with_field_counts": "SELECT n_name, count(s_suppkey) AS fields FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name",
    "last_turn_per_session": f"SELECT t.conv_id, t.turn, (SELECT count(*) FROM {_T} x WHERE x.conv_id = t.conv_id) AS n, role FROM {_T} t WHERE turn = (SELECT max(turn) FROM {_T} y WHERE y.conv_id = t.conv_id)",
    "missing_sessions": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "wanted_sessions": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "snapshot_diff": """SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT doc_id AS path, md5(text) AS hash FROM documents) b FULL JOIN (SELECT doc_id AS path, CASE WHEN quality = 1 THEN md5(text) ELSE md5(text || '!') END AS hash FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT -1 - item_id, md5(text) FROM benchmark) a ON a.path = b.path""",
    "scope_filter": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'ASIA') AND n_name NOT IN ('FRANCE', 'JAPAN')",
    "upsert_latest": "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC",
    "retention_top_n": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5",
    "attribution_60s": _USED.format(60),
    "attribution_1h": _USED.format(3600),
    "newest_turns_fit": f"""SELECT turn_id, conv_id FROM {_T} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 200
AND sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 1500""",
    "restorable_sessions": f"""SELECT conv_id AS session_id, CASE WHEN live IS NULL THEN 'deleted' ELSE 'truncated' END AS reason FROM (
SELECT conv_id, sum(octet_length(encode(content))) FILTER (role = 'user') AS live, sum(octet_length(encode(content))) AS stored FROM {_T} GROUP BY conv_id) WHERE live IS NULL OR live < stored * 0.95""",
    "repair_turns": f"SELECT conv_id AS session_id, turn AS idx, turn_id::VARCHAR AS uuid, md5(content) AS content_md5, CASE WHEN role <> 'assistant' AND coalesce(content, '') <> '' THEN 'live' ELSE 'stored' END AS source FROM {_T}",
    "name_counters": """SELECT project::VARCHAR AS project, coalesce(a, 0) + coalesce(b, 0) AS n, CASE WHEN a IS NULL THEN 'open' ELSE 'kept' END AS status FROM
(SELECT c_nationkey AS project, count(*) AS a FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS project, count(*) AS b FROM supplier GROUP BY 1) USING (project)""",
    "tumbling_counts": "SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "session_windows": """SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
    "paged_sessions": f"SELECT conv_id, count(*) AS n FROM {_T} GROUP BY 1 ORDER BY n DESC, conv_id LIMIT 10 OFFSET 10",
    "session_export": f"SELECT turn_id, conv_id, coalesce(substr(content, 1, 200), '') AS preview FROM {_T} QUALIFY sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn, turn_id ROWS UNBOUNDED PRECEDING) <= 1000",
    "expand_turns": f"SELECT turn_id, role, content FROM {_T} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(content) DESC NULLS LAST, turn) = 1",
    "status_by_role": f"SELECT role, count(*) AS n, count(DISTINCT conv_id) AS sessions, sum(length(content))::BIGINT AS chars FROM {_T} GROUP BY role",
    "find_sessions": _SESSIONS,
    "project_digest": f"""SELECT turn_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY turn_id) - 1 AS i, count(*) OVER (PARTITION BY turn) AS n FROM {_T} WHERE role = 'user')
WHERE n <= 50 OR list_contains(list_transform(range(50), lambda k: round_even(k * (n - 1) / 49, 0)::BIGINT), i)""",
    "topic_titles": f"SELECT turn_id, substr(content, 1, 80) AS title FROM {_T} WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY substr(lower(content), 1, 60) ORDER BY turn_id) = 1",
    "observation_search": """SELECT doc_id, match_count FROM (SELECT doc_id, len(list_filter(['erthe', 'worthless', 'there', 'heron'], lambda w: contains(lower(coalesce(text, '')), w)))::INTEGER AS match_count FROM documents)
WHERE match_count > 0 ORDER BY match_count DESC, doc_id DESC LIMIT 25""",
    "popularity_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "errors_window_5": f"""SELECT n_name, sum(weight)::BIGINT AS weight, count(*) AS n FROM ({FEEDBACK_SQL}) JOIN customer ON turn_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY 1""",
}
QUERIES = {n: globals()[n] for n in SQL}
