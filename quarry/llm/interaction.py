"""Audit of how filters interact: what each filter removes at each place of every order.

A document's failures are a mask of one bit a filter, so a table of documents becomes at most 32 cells
(mask, documents, good, toxic) a part, however many rows it has. All orders of the filters are then
visited by single swaps of neighbours: between two orders only the two steps that the swap touches
change, and only these are summed anew from the cells. What each filter removes is added up along the
walk, which after the last order is its Shapley value times the number of orders.

The last filter removes copies: a document whose text a smaller id has as well, anywhere in the table. One
text's rows may be a third of the table: smallest ids are pre-aggregated, and rows of such texts are salted
where they meet them.

Defined results: a null text is empty, a null source is the part of empty name. Rows with a null id are
documents, but neither have copies nor are ones. Repeated rows are documents of their own and no copies
of each other (equal ids are not smaller). A document is good or toxic if any of its labels says so. A long
text costs what its words take. Columns that are not named here are ignored; an empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_RUN, UPPER, Scratch, let, salted_join

#: Filters in the order of their bits; the last is the one that looks at the whole table.
NAMES = "ABCDE"
COPY = len(NAMES) - 1
FEW_WORDS, DISTINCT_SHARE, UPPER_SHARE = 200, 50, 2
MARKS = "[#$%&*|]"
SCHEMA = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def failures(text: Column) -> Column:
    """Bits of the filters that a text alone decides."""
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    by_words = let(
        words,
        lambda w: F.when(F.size(w) < FEW_WORDS, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)) < DISTINCT_SHARE * F.size(w), 2).otherwise(0),
    )
    return (
        by_words
        + F.when(100 * upper.cast("long") > UPPER_SHARE * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(MARKS), 8).otherwise(0)
    )


def masks(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, mask, good, toxic) of every row of ``docs``."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            failures(whole).cast("int").alias("mask"),
            F.unhex(F.sha2(whole, 256)).alias("print"),
        )
    )
    said = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias("good" if name == "quality" else name)
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(said("quality"), said("toxic"))
    prints = scratch.keep(rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    spread = F.xxhash64("doc_id") % 1024
    copied = salted_join(rows, prints.select("print", "first"), "print", spread, prints.select("print", "n"), rows.count())
    labelled = copied.join(marked, F.col("doc_id") == F.col("label_id"), "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << COPY).otherwise(0)
    no = F.lit(False)
    return labelled.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """(part, cells): for each part its documents by mask, as an array of at most 32."""
    counted = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def swaps(n: int) -> Iterator[int]:
    """Places i at which to swap i and i + 1, so that all orders of ``n`` things are seen once each: the
    largest thing that can still go its way moves one place, and all larger ones turn round."""
    order, way = list(range(n)), [-1] * n
    while True:
        free = [x for i, x in enumerate(order) if 0 <= i + way[x] < n and order[i + way[x]] < x]
        if not free:
            return
        mover = max(free)
        i = order.index(mover)
        j = i + way[mover]
        yield min(i, j)
        order[i], order[j] = order[j], order[i]
        for x in range(mover + 1, n):
            way[x] = -way[x]


def walk(table: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """(order, steps, total) of every order of the filters, for ``table`` (part, mask, [n, good, toxic]).

    ``steps`` is (part, step, [removed, good lost, toxic lost, redundant]) and valid until the next order;
    ``total`` (part, filter) is what each filter has removed in the orders so far.
    """
    parts, size = table.shape[:2]
    n = size.bit_length() - 1
    mask = np.arange(size)
    steps = np.zeros((parts, n, 4), dtype=np.int64)
    now = np.zeros((parts, n), dtype=np.int64)  # removed by each filter in this order
    total = np.zeros_like(now)

    def update(place: int, before: int, which: int) -> None:
        fails = (mask >> which) & 1 == 1
        steps[:, place, :3] = table[:, fails & (mask & before == 0)].sum(axis=1)
        steps[:, place, 3] = table[:, fails & (mask & before != 0), 0].sum(axis=1)
        now[:, which] = steps[:, place, 0]

    order = list(range(n))
    before = [sum(1 << f for f in order[:i]) for i in range(n)]
    for i in range(n):
        update(i, before[i], order[i])
    total += now
    yield tuple(order), steps, total
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        update(i, before[i], order[i])
        update(i + 1, before[i + 1], order[i + 1])
        total += now
        yield tuple(order), steps, total


def audit_parts(names: Sequence[str], table: np.ndarray) -> pa.RecordBatch:
    """The rows of ``SCHEMA`` for parts of the given names and cells."""
    parts, n = len(names), table.shape[1].bit_length() - 1
    orders, steps, total = [], [], np.zeros((parts, n), dtype=np.int64)
    for order, step, running in walk(table):
        orders.append(order)
        steps.append(step.copy())
        total = running
    taken = np.array(orders)  # (order, step) -> filter
    every = np.stack(steps, axis=1)  # (part, order, step, measure)
    removed = every[..., 0]
    kept = table[:, :, 0].sum(axis=1)[:, None, None] - removed.cumsum(axis=2)
    alone = table[:, 1 << np.arange(n), 0]
    rows = len(orders) * n
    labels = np.repeat(["".join(NAMES[f] for f in o) for o in orders], n)
    flat = lambda x: pa.array(x.reshape(-1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array(names, dtype=object), rows), pa.string()),
            pa.array(np.tile(labels, parts), pa.string()),
            pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), parts * len(orders))),
            flat(kept), flat(removed), flat(every[..., 3]), flat(alone[:, taken]), flat(every[..., 1]), flat(every[..., 2]), flat(total[:, taken]),
        ],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, parts_at_once: int = 64) -> DataFrame:
    """``SCHEMA``: a row for each part, order of the filters and step, zeros included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, parts_at_once):
                some = batch.slice(at, parts_at_once).to_pylist()
                table = np.zeros((len(some), 1 << len(NAMES), 3), dtype=np.int64)
                for i, row in enumerate(some):
                    for c in row["cells"]:
                        table[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                yield audit_parts([row["part"] for row in some], table)

    return cells(masks(docs, labels, scratch or Scratch(docs.sparkSession))).mapInArrow(run, SCHEMA)


def plain_orders() -> list[str]:
    """All orders of the filters, as strings."""
    return ["".join(p) for p in permutations(NAMES)]
