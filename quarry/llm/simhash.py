"""SimHash near-duplicate groups by pigeonhole blocks.

A text's fingerprint has, for each of 64 bits, the majority of that bit over the XXH64 values of its
word shingles. Fingerprints that differ in at most two bits agree on at least two of four 16-bit
blocks. Distinct fingerprints are dealt by each of the six pairs of blocks, buckets are joined, and
Hamming distance is verified.

A bucket of more than ``WIDE`` fingerprints, which only a large group of near copies makes, is not
paired off. Two fingerprints are within two bits exactly if some value is within one bit of both, so
each member emits its neighbours at one bit or less (outside the shared blocks), and members that meet
at a value are linked in a star. That is linear in the bucket, and exact.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link like
any other; fewer words than a shingle make one shingle of all words; repeated rows keep their own
output rows; a null doc_id keeps its row and never names a component unless its whole component has
none; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quarry.llm.common import Scratch, fresh, map_rows, salted_join, small_or_shuffled
from quarry.llm.components import connected_components

SEED = 42
SHINGLE = 3
BLOCK_BITS = 16
WIDE = 64
#: Shingles counted at once, so that memory does not follow a text's length.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
        h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(ones * 2 > n).tolist()))


def _make(shingle: int) -> Callable:
    def rows(ids: list, texts: list, prints: list) -> list[tuple]:
        fps = (fingerprint(t, shingle) for t in texts)
        return [(i, f - (1 << 64) if f >> 63 else f, p) for i, f, p in zip(ids, fps, prints, strict=True)]

    return lambda: rows


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, print) for every row; fp is the fingerprint's bits as a signed long, print a hash of
    the text that tells rows of one id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    return map_rows(rows, ["doc_id", "text", "print"], "doc_id bigint, fp bigint, print bigint", _make(shingle))


def _block_keys() -> list[tuple[int, int]]:
    """For each pair of the four blocks its number and the mask of its 32 bits, signed."""
    full = (1 << BLOCK_BITS) - 1
    masks = [sum(full << (BLOCK_BITS * b) for b in pair) for pair in combinations(range(64 // BLOCK_BITS), 2)]
    return list(enumerate(masks))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) + 1


def links(nodes: DataFrame, scratch: Scratch, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints linked at ``max_bits`` (1 or 2) or fewer.

    ``nodes`` has distinct ``fp``. Buckets up to ``WIDE`` give every close pair; wider ones give the
    stars described above, which connect the same fingerprints.
    """
    if max_bits != 2:
        raise ValueError("four blocks in pairs are exact for two bits")
    keyed = nodes.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for j, m in _block_keys()])
        ).alias("key"),
    )
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # most buckets have one fingerprint, so what lies in others is far less than all
    total = scratch.keep(sizes)
    rows = salted_join(keyed, total.select("key", "n"), "key", _salt("fp"), total, total.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rows = rows.filter("n is not null").select("fp", "key.j", "key.k", "n")
    tight = rows.filter(F.col("n") <= WIDE).groupBy("j", "k").agg(F.array_sort(F.collect_list("fp")).alias("m"))

    def partners(x: Column, i: Column) -> Column:
        rest = F.filter(F.col("m"), lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= max_bits))
        return F.transform(rest, lambda y: F.struct(x.alias("a"), y.alias("b")))

    pairs = tight.select(F.explode(F.flatten(F.transform("m", partners))).alias("e")).select("e.a", "e.b")
    free = {j: [_signed(1 << b) for b in range(64) if not m >> b & 1] for j, m in _block_keys()}
    flips = F.element_at(F.create_map(*[x for j, bits in free.items() for x in (F.lit(j), F.array(*map(F.lit, [0, *bits])))]), F.col("j"))
    near = rows.filter(F.col("n") > WIDE).select("j", "k", "fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("v"))
    # at most 33 fingerprints are within one bit of a value in a bucket, so the sets are small
    met = near.groupBy("j", "k", "v").agg(F.array_sort(F.collect_set("fp")).alias("m")).filter(F.size("m") > 1)
    stars = met.select(F.element_at("m", 1).alias("a"), F.explode(F.slice("m", 2, 64)).alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, print, component_id, root) for every row of ``docs``; ``root`` names the component
    even where all its ids are null."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprints(docs, shingle))
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    edges = scratch.keep(links(nodes, scratch))
    roots = connected_components(edges, scratch)
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", "n", F.coalesce("root", "fp").alias("root")
    )
    named = scratch.keep(named)
    groups = scratch.keep(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"), F.sum("n").alias("n")))
    sums = groups.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = groups.select("root", F.col("members").alias("n"))
    values = scratch.keep(salted_join(named, groups.select("root", "component_id"), "root", _salt("fp"), sizes, sums[0]))
    return salted_join(rows, values.select("fp", "component_id", "root"), "fp", _salt("doc_id", "print"), values.select("fp", "n"), sums[1])


def keep_one(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, columns unchanged.

    It is the row of the smallest id, a null id being the largest; of several texts with that id in the
    group, the one of the smallest hash; of repeated rows, any. So each group has exactly one row left,
    whatever its ids. Only ids and hashes are compared; texts stay where they are, unless rows that
    leave are too many to be sent to all executors.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kinds = scratch.keep(near_duplicates(docs, scratch).groupBy("root", "doc_id", "print").agg(F.count("*").alias("n")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    first = scratch.keep(kinds.groupBy("root").agg(F.min(key).alias("first"), F.count("*").alias("kinds")))
    total = first.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    sizes = first.select("root", F.col("kinds").alias("n"))
    marked = salted_join(kinds, first.select("root", "first"), "root", _salt("doc_id", "print"), sizes, total)
    marked = scratch.keep(marked.select("doc_id", "print", (key == F.col("first")).alias("stays"), (F.col("n") > 1).alias("many")))
    id_, print_ = fresh(docs, "id"), fresh(docs, "print")

    def keys(which: str) -> DataFrame:
        return small_or_shuffled(marked.filter(which).select(F.col("doc_id").alias(id_), F.col("print").alias(print_)))

    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(print_))
    left = docs.join(keys("not stays"), same, "left_anti")
    if not marked.filter("stays and many").limit(1).count():
        return left
    many = keys("stays and many")
    once = left.join(many, same, "left_anti")
    row = fresh(docs, "row")
    again = left.join(many, same).groupBy(id_, print_).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    return once.unionByName(again.select(f"{row}.*"))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
