"""Table maintenance: upserts, retention, snapshot diffs, fingerprints, predicates on files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Old and new rows, the highest version of each key; between equal versions the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new rows of keys that are not there."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def update_from(old: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Old rows with ``columns`` replaced by non-null values of the same key."""
    fresh = values.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(fresh, list(keys), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*old.columns)


def keep_newest(rows: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by ``order``, of all rows or of each group."""
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", digest: str = "hash") -> DataFrame:
    """(key, status): new, changed, unchanged or deleted."""
    a = before.select(F.col(key).alias("_a"), F.col(digest).alias("_ha"))
    b = after.select(F.col(key).alias("_b"), F.col(digest).alias("_hb"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_ha").eqNullSafe(F.col("_hb")), "unchanged").otherwise("changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def fingerprint(files: DataFrame) -> DataFrame:
    """(n, newest, bytes) of files (mtime, size): equal fingerprints need no new index."""
    return files.agg(F.count("*").alias("n"), F.max("mtime").alias("newest"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def drifted(indexed: Column, stored: Column) -> Column:
    """Whether two counts differ by more than 50 and more than 5 %."""
    return F.abs(indexed - stored) > F.greatest(F.lit(50.0), stored * 0.05)


def corruption(content: Column, length_before: Column, binary: Column) -> Column:
    """ZEROED, PARTIAL_ZERO, SHRUNK or OK for a file's bytes against the size it had."""
    n = F.octet_length(content)
    zeros = n - F.octet_length(F.unhex(F.regexp_replace(F.hex(content), "(?:\\G|^)((?:(?!00)..)*)00", "$1")))
    wide = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return (
        F.when((n > 0) & (zeros == n), "ZEROED")
        .when(~binary & ~wide & (zeros > n * 0.05), "PARTIAL_ZERO")
        .when(n < length_before * 0.5, "SHRUNK")
        .otherwise("OK")
    )


def truncated(live: Column, stored: Column) -> Column:
    return live < stored * 0.95


def ignore_decision(paths: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(path, rule, skipped): ignore rules in order, the last that matches decides, ``!`` takes back.

    Rules with a slash inside are anchored; a final slash matches folders, and so all below them.
    """
    choice = F.lit(None).cast("struct<rule:string,skip:boolean>")
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        test = F.col("path").rlike(ignore_regex(rule.removeprefix("!")))
        choice = F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(not negated).alias("skip"))).otherwise(choice)
    made = paths.select("path", choice.alias("c"))
    return made.select("path", "c.rule", F.coalesce("c.skip", F.lit(False)).alias("skipped"))


def ignore_regex(rule: str) -> str:
    import re

    folder, body = rule.endswith("/"), rule.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    anchored = "/" in rule.rstrip("/")
    return ("^/?" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def running_cut(rows: DataFrame, budget: int, size: Column, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows while the running size fits the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_used", F.sum(size).over(w)).filter(F.col("_used") <= budget).drop("_used")


def even_sample(rows: DataFrame, most: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """At most ``most`` rows at even distances, the first and the last included.

    Place ``i`` of k takes row ``round(i * (n - 1) / (k - 1))``, halves to the even row.
    """
    w = Window.partitionBy(*by)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    steps = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (most - 1)).cast("int"))
    return placed.filter((F.col("_n") <= most) | F.array_contains(steps, F.col("_i"))).drop("_i", "_n")
