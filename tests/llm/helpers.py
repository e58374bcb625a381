"""Documents with every awkward case, and tables made of them."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows() -> list[tuple]:
    r = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    long = " ".join(r.choice(words) for _ in range(120_000))
    same = "the same line that is surely longer than twenty characters\nanother one"
    texts = [None, "", " \n\t ", "word", long, same, same, same, "Émile ÀÉ 😀 mail a@b.co now", "x" * 60_000, "\n" * 500, "one two three four five six seven"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[5]]  # repeated rows
    rows += [(None, "a row without an id that has a line longer than twenty", "en", "s", 1), (-7, "negative id", "de", "s", 11)]
    return rows


def edge_docs(spark):
    """The rows with extra columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), SCHEMA)
    names = ["id", "fp", "row", "key", "x", "n", "score", "print", "rank", "length", "part", "size", "shard", "words", "hits", "item_id", "_salt", "_kept", "kept", "m"]
    return df.withColumns({c: F.lit(1) for c in names})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
