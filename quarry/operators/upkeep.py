"""Stores and registries: full replaces, vector stores, caches, feedback, versions, repositories."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.batches import map_batches
from quarry.functions.text import once, tokens
from quarry.operators.tables import latest
from quarry.session import kept

# Seconds of a duration's units, and the time that anything else means.
UNITS = {"d": 86400, "h": 3600, "m": 60, "s": 1}
ONE_DAY = 86400


def duration_seconds(text: Column) -> Column:
    """Seconds of ``7d``, ``24h``, ``60m`` or ``30s``; a day where a text is none of these."""
    number, unit = F.regexp_extract(text, r"(?i)^\s*(\d{1,9})([dhms])\s*$", 1), F.lower(F.regexp_extract(text, r"(?i)^\s*(\d{1,9})([dhms])\s*$", 2))
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.coalesce(F.when(number != "", number.cast("long") * F.element_at(factor, unit)), F.lit(ONE_DAY).cast("long"))


def replace_groups(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows of groups that ``new`` does not have, and all new rows: delete, then insert."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def write_groups(new: DataFrame, path: str, by: str) -> None:
    """The same on files: the folders of the groups in ``new`` are overwritten, others stay."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def by_prefix(rows: DataFrame, prefixes: DataFrame, key: str, length: int) -> DataFrame:
    """(prefix, matches, found): how many keys begin with each prefix (of one length), and the key if it is
    one alone. An equi-join on the prefix, since all have its length."""
    own = rows.select(F.left(F.col(key).cast("string"), F.lit(length)).alias("prefix"), F.col(key).alias("_k")).distinct()
    found = own.groupBy("prefix").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    joined = prefixes.select("prefix").distinct().join(found, "prefix", "left")
    return joined.select("prefix", F.coalesce("_n", F.lit(0)).alias("matches"), F.when(F.col("_n") == 1, F.col("_first")).alias("found"))


def mapped_lists(rows: DataFrame, key: str, values: str, mapping: DataFrame) -> DataFrame:
    """(key, ids, orphans): each list looked up in ``mapping`` (name, id), places kept; names without an id
    are orphans, in order."""
    each = rows.select(key, F.posexplode_outer(values).alias("_at", "name"))
    met = each.join(mapping.select("name", F.col("id").alias("_id")), "name", "left")
    pair = F.struct("_at", F.col("_id").alias("v"))
    lost = F.when(F.col("_id").isNull() & F.col("name").isNotNull(), F.struct("_at", F.col("name").alias("v")))
    out = met.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), pair))).alias("a"), F.array_sort(F.collect_list(lost)).alias("b"))
    return out.select(key, F.col("a.v").alias("ids"), F.col("b.v").alias("orphans"))


# --- vectors --------------------------------------------------------------------------------------

# Fixed value: the namespace of names that are URLs, as published for version 5 identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version 5 identifier of a name: SHA-1 of namespace and name, with version and variant set."""

    def parts(h: Column) -> Column:
        variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
        return F.concat_ws("-", F.left(h, F.lit(8)), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

    return once(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), parts)


def upsert_vectors(store: DataFrame, new: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(store, status) after ``new`` (name, vector, ...): ids follow from names, so a repeated delivery
    changes nothing.

    Status is one row for each id: ``inserted``, ``updated``, ``unchanged``, or ``failed`` for vectors that
    are null or not of ``dims`` numbers; these leave the store as it is. Of several rows of a name the
    last by vector counts.
    """
    keyed = new.withColumn("id", uuid5(F.col("name")))
    fits = F.col("vector").isNotNull() & (F.size("vector") == dims)
    one = latest(keyed, ["id"], [F.desc(F.coalesce(fits, F.lit(False))), F.desc("vector")])
    old = store.select("id", F.col("vector").alias("_v"))
    met = one.join(old, "id", "left")
    status = F.when(~F.coalesce(fits, F.lit(False)), "failed").when(F.col("_v").isNull(), "inserted").when(F.col("_v") == F.col("vector"), "unchanged").otherwise("updated")
    judged = met.withColumn("status", status)
    good = judged.filter("status in ('inserted', 'updated')").select(*store.columns)
    return delete_keys(store, good, ["id"]).unionByName(good), judged.select("id", "name", "status")


def rerank(hits: DataFrame, relevance: Column, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """``hits`` (query_id, id, score, text) with ``place`` from 1: those with a relevance first, by it, the
    others after them in their own order.

    ``relevance`` is any expression over a hit, a pandas UDF of a model included; null is no score. A
    query with fewer scored texts than two, or than a third of its hits, keeps its order.
    """
    w = Window.partitionBy(*by)
    scored = hits.withColumn("_r", relevance.cast("double"))
    scored = scored.withColumn("_all", F.count("*").over(w)).withColumn("_r", F.when(F.count("_r").over(w) >= F.greatest(F.lit(2), F.col("_all") / 3), F.col("_r")))
    order = [F.desc_nulls_last("_r"), F.desc("score"), F.asc("id")]
    return scored.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumnRenamed("_r", "relevance").drop("_all")


#: Words whose weights each task holds; the occurrences of all others, which are rare, are shuffled.
WEIGHED = 200_000


def hashed_vectors(corpus: DataFrame, dims: int = 256, weighed: int = WEIGHED) -> DataFrame:
    """(id, vector) of ``corpus`` (id, text) without any model: words hashed into ``dims`` places, each
    weighed by its rarity and the root of its count, scaled to length one.

    The default of semantic search where no embedding provider is plugged in (see ``semantic_search``). Texts
    are cut into words within tasks. The ``weighed`` most frequent words, nearly all occurrences, are summed
    there too; only occurrences of the others meet their weights by a shuffle. Vectors are written down.
    """
    from quarry.operators.textindex import word_counts

    counts = word_counts(corpus).filter(F.size("terms") > 0)
    n = corpus.count()
    sign = F.when(F.xxhash64(F.lit(1), "w") % 2 == 0, 1.0).otherwise(-1.0)
    held = counts.select(F.explode("terms").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    words = kept(held.select("w", "df", F.pmod(F.xxhash64("w"), F.lit(dims)).cast("int").alias("at"), (sign * F.log(1 + F.lit(n) / F.col("df"))).alias("x")))
    least, many = 1, 0
    for r in words.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).toLocalIterator():
        many += r["n"]
        if many > weighed:  # words in so few texts are too many
            least = r["df"] + 1
            break
    top = words.filter(F.col("df") >= least).select("w", "at", "x").toArrow().combine_chunks()
    known = pa.array(top.column("w").to_pylist(), pa.string())
    at, x = (top.column(c).to_numpy() for c in ("at", "x"))
    all_known = least == 1

    def found(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(words, text, place among the known or -1, root of the count) of the words of texts."""
        flat = pc.list_flatten(part.column(1))
        text = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
        place = pc.fill_null(pc.index_in(flat, value_set=known.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
        return flat, text, place, np.sqrt(pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False))

    def listed(matrix: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * dims), pa.array(matrix.reshape(-1).astype(np.float64)))

    def unit(matrix: np.ndarray) -> np.ndarray:
        return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def summed(part: pa.RecordBatch) -> pa.RecordBatch:
        _, text, place, root = found(part)
        text, place, root = text[place >= 0], place[place >= 0], root[place >= 0]
        sums = np.bincount(text * dims + at[place], weights=x[place] * root, minlength=part.num_rows * dims).reshape(-1, dims)
        return pa.RecordBatch.from_arrays([part.column(0), listed(unit(sums) if all_known else sums)], names=["id", "vector"])

    vectors = map_batches(counts, ["id", "terms", "tfs"], "id bigint, vector array<double>", lambda: summed)
    if all_known:
        return kept(vectors)

    def others(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, text, place, root = found(part)
        rare = np.flatnonzero(place < 0)
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text[rare])), flat.take(pa.array(rare)), pa.array(root[rare])], names=["id", "w", "root"])

    def whole(part: pa.RecordBatch) -> pa.RecordBatch:
        sums = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False).reshape(-1, dims).copy()
        text = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False))
        np.add.at(sums, (text, pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False)), pc.list_flatten(part.column(3)).to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([part.column(0), listed(unit(sums))], names=["id", "vector"])

    rest = words.filter(F.col("df") < least).select("w", "at", "x")
    rare = map_batches(counts, ["id", "terms", "tfs"], "id bigint, w string, root double", lambda: others).join(rest, "w")
    more = rare.groupBy("id").agg(F.collect_list(F.struct("at", (F.col("x") * F.col("root")).alias("y"))).alias("r")).select("id", F.col("r.at").alias("ats"), F.col("r.y").alias("ys"))
    return kept(map_batches(vectors.join(more, "id", "left"), ["id", "vector", "ats", "ys"], "id bigint, vector array<double>", lambda: whole))


def semantic_search(corpus: DataFrame, queries: DataFrame, k: int, embed: Callable[[DataFrame], DataFrame] | None = None, where: Column | None = None) -> DataFrame:
    """(query_id, id, score): texts nearest to each query's meaning.

    ``embed`` maps (id, text) to (id, vector) and is where a provider goes; texts and queries are embedded
    together, so that both see the same statistics. ``where`` limits the texts, after statistics.
    """
    from quarry.operators.retrieval import cosine_top_k

    both = corpus.select((2 * F.col("id")).alias("id"), "text").unionByName(queries.select((2 * F.col("query_id") + 1).alias("id"), "text"))
    made = (embed or hashed_vectors)(both)
    texts = made.filter("id % 2 = 0").select(F.shiftright("id", 1).alias("id"), "vector")
    if where is not None:
        texts = texts.join(corpus.filter(where).select("id"), "id", "left_semi")
    asked = made.filter("id % 2 <> 0").select(F.shiftright("id", 1).alias("query_id"), "vector")
    return cosine_top_k(texts, asked, k)


def stragglers(rows: DataFrame, done: str, shard: int, shards: int, key: str = "id") -> DataFrame:
    """The rows of one worker's shard that are not done yet; shards are disjoint and cover all rows."""
    return rows.filter(~F.coalesce(F.col(done), F.lit(False)) & (F.pmod(F.col(key), F.lit(shards)) == shard))


# --- caches and feedback --------------------------------------------------------------------------


def cache_lookup(cache: DataFrame, asked: DataFrame, now: str, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(answers, cache): values of the keys that are asked for, and the cache with these touched, trimmed to
    the ``most`` used last. ``cache`` (key, value, last_used), ``asked`` (key)."""
    keys = asked.select("key").distinct()
    hit = F.broadcast(keys.withColumn("_hit", F.lit(True))) if keys.isStreaming else keys.withColumn("_hit", F.lit(True))
    answers = keys.join(cache.select("key", "value"), "key", "left").withColumn("hit", F.col("value").isNotNull())
    touched = cache.join(hit, "key", "left").withColumn("last_used", F.when(F.col("_hit"), F.lit(now).cast("timestamp")).otherwise(F.col("last_used"))).drop("_hit")
    return answers, touched.orderBy(F.desc("last_used"), "key").limit(most)


# Weights of a rating, up or down, and of opening a hit.
RATING, OPENING = 3, 1


def feedback_rows(ratings: DataFrame, openings: DataFrame, seconds: int = 300, most: int = 20) -> DataFrame:
    """(turn_id, ts, weight, kind, query): rows to append for ratings (turn_id, ts, up) and openings (turn_id,
    ts, query, shown_ts). An opening tells which query it belongs to if that was shown at most ``seconds``
    before; at most ``most`` hits of a query count, the newest."""
    explicit = ratings.select("turn_id", "ts", F.when(F.col("up"), RATING).otherwise(-RATING).alias("weight"), F.lit("explicit").alias("kind"), F.lit(None).cast("string").alias("query"))
    near = openings.filter((F.col("ts") >= F.col("shown_ts")) & (F.unix_micros("ts") - F.unix_micros("shown_ts") <= seconds * 1_000_000))
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ts"), "turn_id"))
    implicit = near.withColumn("_n", n).filter(F.col("_n") <= most).select("turn_id", "ts", F.lit(OPENING).alias("weight"), F.lit("implicit").alias("kind"), "query")
    return explicit.unionByName(implicit)


def outcome_analytics(outcomes: DataFrame) -> DataFrame:
    """(strategy, verdict, n, share, domains) of logged outcomes (strategy, verdict, domain); ``share`` is that
    of the strategy's outcomes."""
    counts = outcomes.groupBy("strategy", "verdict").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("strategy")))


def training_pairs(n: int = 5000, seed: int = 42) -> Callable[[SparkSession], DataFrame]:
    """Made-up training rows for the ranker: seven features and a label drawn from a known rule, the same
    every time."""

    def make(spark: SparkSession) -> DataFrame:
        unit = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 20)) / float(1 << 20)
        rows = spark.range(n).select(
            "id", unit(0).alias("bm25"), unit(1).alias("vector"), (-F.log1p(unit(2) * 90)).alias("recency"), unit(3).alias("overlap"),
            (unit(4) < 0.4).cast("double").alias("same_project"), (unit(5) < 0.5).cast("double").alias("source"), F.log1p(unit(6) * 5).alias("popularity"),
        )
        strength = 2 * F.col("bm25") + 2 * F.col("vector") + 0.3 * F.col("recency") + 1.5 * F.col("overlap") + 0.8 * F.col("same_project") + 0.5 * F.col("popularity") - 3
        return rows.withColumn("label", (unit(7) < 1 / (1 + F.exp(-strength))).cast("double"))

    return make


def corpus_for_bench(texts: DataFrame, gold: DataFrame, most: int = 5000, least: int = 80) -> DataFrame:
    """The ``most`` longest texts (id, text) of at least ``least`` characters, and every gold row besides."""
    size = F.length("text")
    long = texts.filter(size >= least).orderBy(size.desc(), "id").limit(most)
    forced = texts.join(gold.select("id").distinct(), "id", "left_semi")
    return long.unionByName(forced).dropDuplicates(["id"])


# --- versions and repositories --------------------------------------------------------------------


def one_line(text: Column, most: int = 200) -> Column:
    """The first sentence or line of a text, without marks of lists or emphasis, in ``most`` characters."""
    tidy = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    bare = tidy(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\s*(?:[-*#>]+|\d+\.)\s*", ""), r"[*_`]", ""))
    first = tidy(F.regexp_extract(bare, r"(?s)^(.*?(?:[.!?](?=\s|$)|\n|$))", 1))
    return F.when(F.length(first) > most, F.concat(F.rtrim(F.left(first, F.lit(most - 1))), F.lit("…"))).otherwise(first)


def record_versions(known: DataFrame, new: DataFrame) -> DataFrame:
    """(version, line): known lines, and those of versions that have none. Recording again changes nothing."""
    first = latest(new.select("version", "line"), ["version"], [F.asc("line")])
    return known.unionByName(first.join(known.select("version"), "version", "left_anti"))


def what_shipped(sections: DataFrame, commits: DataFrame, newest: int = 5) -> DataFrame:
    """(version, ts, line, commits) of the ``newest`` sections (version, ts, text), newest first, with their
    release commits (version, sha), in order."""
    last = sections.orderBy(F.desc("ts"), F.desc("version")).limit(newest)
    listed = commits.groupBy("version").agg(F.array_join(F.array_sort(F.collect_set("sha")), ",").alias("commits"))
    return last.join(listed, "version", "left").select("version", "ts", one_line(F.col("text")).alias("line"), F.coalesce("commits", F.lit("")).alias("commits"))


def release_digest(files: DataFrame, most_chars: int, by: Sequence[str] = ()) -> DataFrame:
    """Version files (name, mtime, text), newest first, while their texts fit ``most_chars``; the first
    always."""
    w = Window.partitionBy(*by).orderBy(F.desc("mtime"), "name")
    run = files.withColumns({"_n": F.row_number().over(w), "_used": F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return run.filter((F.col("_n") == 1) | (F.col("_used") <= most_chars)).drop("_n", "_used")


def rebind(repos: DataFrame, moves: DataFrame) -> DataFrame:
    """Repositories (repo_id, path, last_seen) with the paths of ``moves`` (repo_id, path, ts), newest move."""
    m = latest(moves, ["repo_id"], [F.desc("ts"), F.asc("path")]).select("repo_id", F.col("path").alias("_p"), F.col("ts").alias("_t"))
    joined = repos.join(m, "repo_id", "left")
    return joined.select("repo_id", F.coalesce("_p", "path").alias("path"), F.greatest("last_seen", "_t").alias("last_seen"))


def prune(repos: DataFrame, present: DataFrame, as_of: str, days: int) -> DataFrame:
    """Repositories that are seen on disk, or were seen in the last ``days`` days."""
    old = F.col("last_seen") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    seen = present.select("path").distinct().withColumn("_on", F.lit(True))
    return repos.join(seen, "path", "left").filter(F.col("_on") | ~F.coalesce(old, F.lit(True))).select(*repos.columns)


def schema_diff(declared: DataFrame, live: DataFrame) -> DataFrame:
    """(name, status): declared tables or columns that are not there, and those there that are not declared."""
    a, b = declared.select("name").distinct(), live.select("name").distinct()
    missing = a.join(b, "name", "left_anti").withColumn("status", F.lit("missing"))
    return missing.unionByName(b.join(a, "name", "left_anti").withColumn("status", F.lit("undeclared")))


def live_tables(spark: SparkSession) -> DataFrame:
    """(name) of the session's tables and views."""
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "name string")


def lost_data(counts: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """(name, n): tables (name, n) with fewer rows than ``least`` that a source (name) could restore."""
    return counts.filter(F.col("n") < least).join(sources.select("name").distinct(), "name", "left_semi")


def browse(rows: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0, needle: str | None = None, column: str = "name", **equal: str) -> DataFrame:
    """A page of any registry: rows of equal values, with a needle in a column, case aside, in order."""
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    if needle:
        rows = rows.filter(F.contains(F.lower(column), F.lit(needle.lower())))
    return rows.orderBy(*order).offset(offset).limit(limit)


# --- style classes --------------------------------------------------------------------------------

# Utilities are a family and one of its values, or a class of its own; variants go before.
SPACED = "m mx my ms me mt mr mb ml p px py ps pe pt pr pb pl gap gap-x gap-y space-x space-y inset top right bottom left translate-x translate-y skew-x skew-y scale-x scale-y scale rotate".split()
SIZED = "w h min-w min-h max-w max-h".split()
SIZES = "0 px 0.5 1 1.5 2 2.5 3 3.5 4 5 6 7 8 9 10 11 12 14 16 20 24 28 32 36 40 44 48 52 56 60 64 72 80 96 auto full screen min max fit".split()
FRACTIONS = "1/2 1/3 2/3 1/4 2/4 3/4 1/5 2/5 3/5 4/5 1/6 2/6 3/6 4/6 5/6 1/12 2/12 11/12".split()
COLOURED = "text bg border ring fill stroke from to via outline decoration divide placeholder caret accent".split()
COLOURS = "slate gray zinc neutral stone red orange amber yellow lime green emerald teal cyan sky blue indigo violet purple fuchsia pink rose white black transparent current inherit".split()
SHADES = "50 100 200 300 400 500 600 700 800 900 950".split()
FAMILIES = {
    "text": "xs sm base lg xl 2xl 3xl 4xl 5xl 6xl 7xl 8xl 9xl left center right justify",
    "font": "sans serif mono thin extralight light normal medium semibold bold extrabold black",
    "rounded(?:-(?:t|r|b|l|tl|tr|bl|br|s|e|ss|se|es|ee))?": "none sm md lg xl 2xl 3xl full",
    "shadow": "sm md lg xl 2xl inner none",
    "opacity": "0 5 10 20 25 30 40 50 60 70 75 80 90 95 100",
    "z": "0 10 20 30 40 50 auto minus-1",
    "ring": "0 1 2 4 8 inset offset-0 offset-1 offset-2 offset-4 offset-8",
    "leading": "3 4 5 6 7 8 9 10 none tight snug normal relaxed loose",
    "tracking": "tighter tight normal wide wider widest",
    "aspect": "square video auto",
    "flex": "1 auto initial none row col wrap nowrap",
    "grid-cols": "1 2 3 4 5 6 12",
    "items": "start center end baseline stretch",
    "justify": "start center end between around evenly",
    "place": "content-center items-center",
    "self": "auto start center end stretch",
    "border": "0 2 4 8",
    "transition": "none all colors opacity shadow transform",
    "cursor": "pointer default wait text move not-allowed",
    "select": "none auto text all",
    "overflow": "hidden auto visible scroll x-auto y-auto",
    "object": "cover contain fill none",
    "pointer-events": "auto none",
    "list": "none disc decimal",
    "whitespace": "normal nowrap pre pre-wrap pre-line",
    "break": "normal words all",
    "will-change": "auto transform scroll",
    "table": "row cell caption fixed auto",
    "outline": "none dashed dotted double",
}
ALONE = (
    "uppercase lowercase capitalize normal-case rounded border shadow transition block inline-block inline flex inline-flex grid inline-grid hidden absolute relative fixed sticky static "
    "container truncate sr-only not-sr-only italic not-italic underline no-underline line-through antialiased subpixel-antialiased appearance-none isolate isolation-auto table"
).split()
VARIANTS = (
    "sm md lg xl 2xl hover focus active visited disabled checked focus-within focus-visible first last odd even empty open default indeterminate placeholder-shown "
    "group-hover group-focus group-active peer-hover peer-focus dark motion-safe motion-reduce print rtl ltr data-active data-open data-checked children first-child last-child"
).split()


def _one_of(values: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(v).replace("\\-", "-").replace("\\/", "/") for v in values) + ")"


_BASES = "|".join([
    f"{_one_of(SPACED + SIZED)}-{_one_of(SIZES + FRACTIONS)}", f"-{_one_of(SPACED)}-{_one_of(['1', '2', '4'])}", f"{_one_of(COLOURED)}-{_one_of(COLOURS)}(?:-{_one_of(SHADES)})?",
    *[f"{family}-{_one_of(values.split())}" for family, values in FAMILIES.items()], _one_of(ALONE),
])
#: Variants in brackets and custom media queries are any; so are values in brackets.
UTILITY = re.compile(rf"^(?:(?:{_one_of(VARIANTS)}|\[[^:]*\]|@[^:]*\[[^:]*):)*(?:-?[!]?(?:{_BASES})|[^:]*\[[^:]*\])$")


def is_utility_class(name: Column) -> Column:
    """Whether a class is a utility of Tailwind: known variants, then a known class or a value in brackets."""
    return F.coalesce(name.rlike(UTILITY.pattern), F.lit(False))
