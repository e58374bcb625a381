"""Observations in assistant texts: tagged blocks, and marked lines outside of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import once

# Kinds, tags and line markers of observations.
KINDS = ("bugfix", "feature", "decision", "discovery", "change", "refactor", "question")
TAGS = ("observation", "summary", "discovery", "decision")
MARKERS = {
    "decision": r"(?:Decision|DECIDED)",
    "bugfix": r"Bug\s*fix",
    "discovery": r"(?:Discovery|Learned)",
    "refactor": r"Refactor(?:ed)?",
    "question": r"Question",
    "feature": r"Feature",
    "change": r"Change",
}
BLOCK = r"(?is)<(" + "|".join(TAGS) + r")\b[^>]*>.*?</\1>"
INNER = r"(?i)</?(?:request|investigated|completed|next_steps|notes|fact|file_(?:read|modified)|files?(?:_modified|_read)?|title|subtitle)>"
LEAST = 10


def _inner(block: Column, tag: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?is)<{tag}>(.*?)</{tag}>", 1), INNER, ""))


def _all_inner(block: Column, tag: str) -> Column:
    found = F.regexp_extract_all(block, F.lit(rf"(?is)<{tag}>(.*?)</"), F.lit(1))
    return F.slice(F.transform(found, lambda f: F.trim(F.regexp_replace(f, INNER, ""))), 1, 20)


def _tagged(block: Column) -> Column:
    tag = F.lower(F.regexp_extract(block, r"^<(\w+)", 1))
    stated = F.lower(F.regexp_extract(block, r"(?i)^<[^>]*?\btype\s*=\s*[\"']([a-z]+)", 1))
    kind = F.when(stated.isin(*KINDS), stated).when(tag == "decision", "decision").otherwise("discovery")
    body = F.trim(F.regexp_extract(block, r"(?s)^<[^>]*>(.*)</", 1))
    title = F.coalesce(F.nullif(_inner(block, "title"), F.lit("")), F.substring(F.split(body, "\n")[0], 1, 200))
    files = F.filter(F.transform(F.flatten(F.transform(_all_inner(block, "files?(?:_modified|_read)?"), lambda f: F.split(f, "[,\n]"))), lambda f: F.trim(f)), lambda f: f != "")
    return F.struct(
        kind.alias("kind"), F.substring(title, 1, 500).alias("title"), F.nullif(F.substring(_inner(block, "subtitle"), 1, 1000), F.lit("")).alias("subtitle"),
        _all_inner(block, "fact").alias("facts"), F.slice(files, 1, 20).alias("files"),
    )


def observations(texts: DataFrame, text: str = "content") -> DataFrame:
    """All columns of ``texts`` and kind, title, subtitle, facts and files of each observation."""
    source = F.coalesce(F.col(text), F.lit(""))
    blocks = F.transform(F.regexp_extract_all(source, F.lit(BLOCK), F.lit(0)), _tagged)

    def marked(rest: Column) -> Column:
        none = F.array().cast("array<string>")
        found = []
        for kind, marker in MARKERS.items():
            lines = F.regexp_extract_all(rest, F.lit(rf"(?im)^\s*\*?\*?{marker}\s*:\s*\*?\*?\s*(.+)$"), F.lit(1))
            kept = F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: F.length(s) >= LEAST)
            found.append(F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), F.substring(s, 1, 500).alias("title"), F.lit(None).cast("string").alias("subtitle"), none.alias("facts"), none.alias("files"))))  # noqa: B023
        return F.concat(*found)

    # what stands inside tags is covered by them
    every = F.concat(blocks, once(F.regexp_replace(source, BLOCK, "\n"), marked))
    return texts.select("*", F.explode(F.filter(every, lambda o: o["title"] != "")).alias("_o")).select(*texts.columns, "_o.*")
