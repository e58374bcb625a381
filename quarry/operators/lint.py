"""Grounding of names that an edit uses: issues by severity, and a verdict for each document."""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import trigram_join
from quarry.sources import code

#: Confidence that a name without any match is wrong, by domain.
UNKNOWN = {"env": 0.92, "flag": 0.92, "css": 0.85, "model": 0.92, "graphql": 0.9, "export": 0.85, "url": 0.9, "symbol": 0.9, "i18n": 0.85}
CLOSE = 0.5
SURE, FEW_EDITS = 0.7, 2


def ground(references: DataFrame, index: DataFrame, threshold: float = CLOSE) -> DataFrame:
    """(doc, domain, name, severity, candidate, confidence) of ``references`` (doc, domain, name) against
    ``index`` (domain, name).

    Names that exist are ``ok``; names like one that exists are ``low``, with their similarity; others are
    ``unknown``. A domain without any indexed name gives no issues.
    """
    known = index.select("domain", "name").distinct()
    asked = references.join(known.select("domain").distinct(), "domain", "left_semi").distinct()
    hit = known.select(F.col("domain").alias("_d"), F.col("name").alias("_n"))
    marked = asked.join(hit, (F.col("domain") == F.col("_d")) & (F.col("name") == F.col("_n")), "left")
    fine = marked.filter("_n is not null")
    open_ = marked.filter("_n is null").drop("_d", "_n")
    near = trigram_join(open_.select(F.col("name").alias("probe")), known, threshold).withColumnRenamed("name", "candidate")
    near = near.join(known.select(F.col("domain").alias("_d"), F.col("name").alias("candidate")), "candidate")
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("_d", "probe").orderBy(F.desc("sim"), "candidate"))).filter("_r = 1")
    scored = open_.join(best, (F.col("domain") == F.col("_d")) & (F.col("name") == F.col("probe")), "left")
    unknown = F.lit(0.9)
    for domain, value in UNKNOWN.items():
        unknown = F.when(F.col("domain") == domain, value).otherwise(unknown)
    ok = fine.select("doc", "domain", "name", F.lit("ok").alias("severity"), F.col("name").alias("candidate"), F.lit(1.0).alias("confidence"))
    found = F.col("candidate").isNotNull()
    return ok.unionByName(
        scored.select("doc", "domain", "name", F.when(found, "low").otherwise("unknown").alias("severity"), "candidate", F.when(found, F.col("sim")).otherwise(unknown).alias("confidence"))
    )


def verdicts(issues: DataFrame) -> DataFrame:
    """(doc, verdict, ok, low, unknown): ``block`` with an unknown name, ``warn`` with a doubtful one."""
    counts = issues.groupBy("doc").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("ok", "low", "unknown")])
    return counts.select("doc", F.when(F.col("unknown") > 0, "block").when(F.col("low") > 0, "warn").otherwise("ok").alias("verdict"), "ok", "low", "unknown")


def references(edits: DataFrame, *domains: str) -> DataFrame:
    """(doc, domain, name) of names that edits (doc, path, text) use."""
    found = code.names(edits.select(F.concat_ws("\u0000", "doc", "path").alias("path"), "text"), *(domains or ("env", "flag", "url")))
    return found.select(F.split("path", "\u0000")[0].alias("doc"), "domain", "name")


def called_names(edits: DataFrame) -> DataFrame:
    """(doc, domain, name) of functions and classes that texts call, without the language's own."""
    own = sorted(set(dir(builtins)) | set(keyword.kwlist) | {"function", "switch", "catch", "super", "require", "typeof", "console"})
    calls = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\w.])([A-Za-z_]\w{2,})\s*\("), F.lit(1)))
    kept = F.filter(calls, lambda c: ~c.isin(*own) & ~c.rlike("^__"))
    return edits.select("doc", F.lit("symbol").alias("domain"), F.explode(kept).alias("name"))


def typo_like(issues: DataFrame) -> DataFrame:
    """Doubtful names that are very close to what exists."""
    return issues.filter((F.col("severity") == "low") & (F.col("confidence") >= SURE) & (F.levenshtein("name", "candidate") <= FEW_EDITS))
