"""Benchmark decontamination: size-partitioned MinHash containment search, then an exact check.

An item is contained in a document that holds at least ``CONTAINMENT`` of the item's distinct word
shingles; an item of fewer words than a shingle has one shingle of all its words. A short item's MinHash
is its shingles of smallest hash. Of n shingles a document may miss fewer than the
``n - ceil(c * n) + 1`` smallest, so a document that holds none of these cannot contain the item: the
search loses nothing. Items are partitioned by the power of two of the shingles that they need: the
sketch length follows the size, and a document meets the partitions that are not too large for it.

Each text is scanned once. A Bloom filter over the items' shingles keeps the few windows that can
matter; those meet the sketches, and candidates are verified on all shingles. A shingle is known by 128
bits of hash. All of it is built-in functions and joins.

Sizes: a filter of up to ``FILTER_KEYS`` shingles (4 MB) is a constant of the plan; a larger one is cut
into shards of ``SHARD_KEYS``, and windows go to their shard's. Item tables of up to
``BROADCAST_SHINGLES`` (some 8 MB) are broadcast; larger ones are joined by shuffles in which shingles of
very many documents are salted.

Defined results: null and empty texts and items match nothing; repeated rows of a doc_id give a pair
once, with their largest overlap; items that repeat an id give one row with their largest containment; a
null doc_id or item_id is carried as null; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, at_shards, fresh, hot_of, let, long_array, salted_join, small_or_shuffled, words_of

SHINGLE = 5
CONTAINMENT = 0.8
FILTER_KEYS = 1_000_000
SHARD_KEYS = 50_000
BITS_A_KEY = 32
PROBES = 3
BROADCAST_SHINGLES = 200_000


def _hash(words: Column, i: Column, size: int, seed: int) -> Column:
    """Hash of the window at ``i``; it runs over the words, without joining them."""
    return F.xxhash64(*([F.lit(seed)] if seed else []), *[F.get(words, i + j) for j in range(size)])


def _windows(words: Column, size: int) -> Column:
    """(i, size, a) of every window of ``size`` words: its start and the first half of its hash."""
    heads = F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))
    return F.transform(heads, lambda _, i: F.struct(i.alias("i"), F.lit(size).alias("size"), _hash(words, i, size, 0).alias("a")))


def _keys(words: Column, windows: Column, sizes: list[int]) -> Column:
    """(a, b) of windows, each once; b is the hash's other half, made only for these."""

    def half(x: Column) -> Column:
        b = _hash(words, x["i"], sizes[0], 1)
        for size in sizes[1:]:
            b = F.when(x["size"] == size, _hash(words, x["i"], size, 1)).otherwise(b)
        return F.struct(x["a"].alias("a"), b.alias("b"))

    return F.array_distinct(F.transform(windows, half))


def prepare(items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, item, words, shingles, n, need, sketch) of distinct items that have a word; ``words`` is the
    size of the item's shingles."""

    def of(w: Column) -> Column:
        windows = _windows(w, shingle)
        for size in range(1, shingle):
            windows = F.when(F.size(w) == size, _windows(w, size)).otherwise(windows)
        return F.struct(F.least(F.size(w), F.lit(shingle)).alias("words"), let(windows, lambda x: _keys(w, x, list(range(1, shingle + 1)))).alias("shingles"))

    ids = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    rows = ids.select("item_id", F.xxhash64("item_id", "text").alias("item"), let(words_of(F.col("text")), of).alias("x"))
    rows = rows.select("item_id", "item", "x.words", "x.shingles").withColumn("n", F.size("shingles")).filter("n > 0")
    rows = rows.withColumn("need", F.ceil(F.col("n") * F.lit(containment) - 1e-9).cast("int"))
    ordered = F.array_sort(F.transform("shingles", lambda s: F.struct(s["b"].alias("b"), s["a"].alias("a"))))
    sketch = F.slice(ordered, 1, F.col("n") - F.col("need") + 1)
    return rows.withColumn("sketch", F.transform(sketch, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))


def _positions(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, 20 * j).bitwiseAND(F.lit(bits - 1).cast("long")) for j in range(PROBES)]


def _shard(a: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), a), F.lit(shards)).cast("int")


def _filters(items: DataFrame, bits: int, shards: int) -> DataFrame:
    """(shard, words): Bloom filters of the items' shingles, as bits."""
    keys = items.select(F.explode("shingles").alias("s")).select(F.col("s.a").alias("a"), _shard(F.col("s.a"), shards).alias("shard"))
    spots = keys.select("shard", F.explode(F.array(*_positions(F.col("a"), bits))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    spots = spots.select("shard", F.shiftright("p", 6).cast("int").alias("w"), bit.alias("b"))
    blank = items.sparkSession.range(shards).select(
        F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(bits // 64 - 1))).alias("w"), F.lit(0).cast("long").alias("b")
    )
    words = spots.unionByName(blank).groupBy("shard", "w").agg(F.bit_or("b").alias("b"))
    return words.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("w", "b")))["b"].alias("words"))


def _may_hold(words: Column, a: Column, bits: int) -> Column:
    found = [F.call_function("getbit", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in _positions(a, bits)]
    return functools.reduce(Column.__and__, found)


def _hits(docs: DataFrame, items: DataFrame, keys: int, sizes: list[int], scratch: Scratch) -> DataFrame:
    """(doc_id, print, room, s) of the windows that are probably shingles of an item, each once; ``room`` is
    how many windows of that size the document has."""
    constant = keys <= FILTER_KEYS
    shards = 1 if constant else -(-keys // SHARD_KEYS)
    bits = 1 << max(10, (-(-keys // shards) * BITS_A_KEY - 1).bit_length())
    filters = scratch.keep(_filters(items, bits, shards))
    words = long_array(filters.first()["words"]) if constant else None

    def matches(w: Column) -> Column:
        windows = F.concat(*[_windows(w, size) for size in sizes])
        if words is not None:
            windows = F.filter(windows, lambda x: _may_hold(words, x["a"], bits))
        room = F.size(w)
        # a shingle's size is not kept: by the hash, windows of another size do not meet it
        return let(windows, lambda x: F.transform(_keys(w, x, sizes), lambda s: F.struct(room.alias("room"), s.alias("s"))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), F.explode(let(words_of(F.col("text")), matches)).alias("x"))
    rows = rows.select("doc_id", "print", "x.room", "x.s")
    if not constant:
        rows = scratch.keep(rows)
        shard = _shard(F.col("s.a"), shards)
        counts = scratch.keep(rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")))
        hot = hot_of(counts, "shard", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        salt = F.pmod(F.xxhash64("doc_id", "print"), F.lit(1 << 20)) + 1
        rows = at_shards(rows, shard, filters, lambda words: _may_hold(words, F.col("s.a"), bits), hot, salt, "may").filter("may").drop("may")
    return scratch.keep(rows.distinct())


def _meet(rows: DataFrame, values: DataFrame, key: str, send: bool, scratch: Scratch) -> DataFrame:
    """Inner join of ``rows`` to ``values`` (several rows a key)."""
    if send:
        return rows.join(F.broadcast(values), key)
    names = [c for c in values.columns if c != key]
    lists = scratch.keep(values.groupBy(key).agg(F.collect_list(F.struct(*names)).alias("_all")))
    counts = scratch.keep(rows.groupBy(key).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = salted_join(rows, lists, key, F.pmod(F.xxhash64("doc_id", "print"), F.lit(1 << 20)) + 1, counts, total)
    return met.withColumn("_one", F.explode("_all")).select(*rows.columns, "_one.*")


def contaminated(
    docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every document that contains an item."""
    scratch = scratch or Scratch(docs.sparkSession)
    known = scratch.keep(prepare(items, shingle, containment).withColumn("class", F.log2("need").cast("int")))
    # the item table is small beside the corpus; its size decides how it is joined
    stats = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_set("words"), F.collect_set("class")).first()
    keys, sizes, classes = int(stats[0]), sorted(stats[1]) or [shingle], sorted(stats[2])
    send = keys <= BROADCAST_SHINGLES
    hits = _hits(docs, known, keys, sizes, scratch)
    # a document meets the partitions of items that need no more shingles than it has
    own = F.filter(F.array(*map(F.lit, classes)).cast("array<int>"), lambda c: c <= F.log2("room").cast("int"))
    dealt = hits.withColumn("class", F.explode(own)).withColumn("key", F.struct("class", "s"))
    sketch = known.select("item", "need", "class", F.explode("sketch").alias("s")).select(F.struct("class", "s").alias("key"), "item", "need")
    met = _meet(dealt, sketch, "key", send, scratch).filter(F.col("room") >= F.col("need"))
    found = met.select(F.col("doc_id").alias("doc2"), F.col("print").alias("print2"), "item").distinct()
    pairs = hits.join(found, F.col("doc_id").eqNullSafe(F.col("doc2")) & (F.col("print") == F.col("print2"))).withColumn("key", F.struct("item", "s"))
    parts = known.select("item_id", "item", "n", "need", F.explode("shingles").alias("s")).select(F.struct("item", "s").alias("key"), "item_id", "n", "need")
    shared = _meet(pairs.select("doc_id", "print", "item", "s", "key"), parts, "key", send, scratch)
    counts = shared.groupBy("doc_id", "print", "item_id", "item", "n", "need").agg(F.count("*").alias("n_shared"))
    counts = counts.filter(F.col("n_shared") >= F.col("need"))
    best = counts.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("n_shared") / F.col("n")).alias("containment"), "n_shared", F.col("n").cast("long").alias("n_item"))).alias("m")
    )
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item", "m.containment")


def remove(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that contain no item, columns unchanged. Rows with a null id stay or go
    together."""
    scratch = scratch or Scratch(docs.sparkSession)
    own = fresh(docs, "bad")
    bad = scratch.keep(contaminated(docs, items, scratch=scratch).select(F.col("doc_id").alias(own)).distinct())
    return docs.join(small_or_shuffled(bad), docs["doc_id"].cast("long").eqNullSafe(F.col(own)), "left_anti")
