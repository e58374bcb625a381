"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts.

``LineIndex`` keeps which document refers to which line key. Counts of references decide; they live in
tables, exact, so deleting a document restores every line that only its presence removed. Over the keys
that enough documents share, each shard keeps a cuckoo filter, which supports deletion. Scanning a
text, the filter rules out nearly all lines where they stand; only the rest meet the exact table.

A key is a 128-bit hash of the line, stripped of ASCII white space at both ends and with A-Z
lower-cased. Keys shorter than ``LEAST_CHARS`` code points are never counted or dropped.

Skew: references are counted by partial aggregates, first by (key, document), then by key. Rows of
keys that hold more than a two-hundredth of the candidates are salted (see ``salted_join``).

Defined results: a null or empty text is one empty line and comes back as the empty text; a row with a
null doc_id is no document, so it neither counts nor loses lines; repeated rows of an id are one
document, each row is returned; other columns come back unchanged; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, ascii_lower, at_shards, hot_of, let, long_array, salted_join
from quarry.llm.cuckoo import CuckooFilter, may_contain

LEAST_CHARS = 20
LEAST_DOCS = 3
STRIP = " \t\n\x0b\x0c\r"
#: Keys of one shard's filter, in expectation.
SHARD_KEYS = 50_000
#: Keys that all filters together may hold to be a constant of the plan (about 5 MB) and be probed where
#: a text is read; with more keys, lines go to their shard's filter.
FILTER_KEYS = 1_000_000
#: Changes after which the references are written anew as one table.
COMPACT = 8


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    """The line's two-part key, or null for a line that is too short."""
    pair = lambda k: F.when(F.length(k) >= LEAST_CHARS, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))
    return let(ascii_lower(F.btrim(line, F.lit(STRIP))), pair)


def references(docs: DataFrame) -> DataFrame:
    """(key, doc_id), once for each pair."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), key_of), lambda k: k.isNotNull()))
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(keys).alias("key"))
    return rows.distinct()


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(key["a"], F.lit(shards)).cast("int")


def build_filters(common: DataFrame, shards: int) -> DataFrame:
    """(shard, words) for the keys of ``common`` (key)."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": part["shard"].iloc[:1].tolist(), "words": [CuckooFilter.of(part["b"].tolist()).words()]})

    rows = common.select(_shard(F.col("key"), shards).alias("shard"), F.col("key.b").alias("b"))
    return rows.groupBy("shard").applyInPandas(build, "shard int, words array<bigint>")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, shards: int) -> DataFrame:
    """Filters after keys became common or stopped being so; ``words`` is null where there was no room."""

    def merge(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else change)["shard"].iloc[0])
        made = CuckooFilter.from_words(old["words"].iloc[0].tolist()) if len(old) else CuckooFilter(1)
        for key in change.loc[~change["add"], "b"].tolist():
            made.delete(key)
        fits = all(made.insert(key) for key in change.loc[change["add"], "b"].tolist())
        return pd.DataFrame({"shard": [shard], "words": [made.words() if fits else None]})

    changes = added.select("key", F.lit(True).alias("add")).union(removed.select("key", F.lit(False).alias("add")))
    changes = changes.select(_shard(F.col("key"), shards).alias("shard"), F.col("key.b").alias("b"), "add")
    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(merge, "shard int, words array<bigint>")


def _common(refs: DataFrame) -> DataFrame:
    """(key, n, last) of the keys that enough documents refer to."""
    counts = refs.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    return counts.filter(F.col("n") >= LEAST_DOCS)


class LineIndex:
    """References, exact counts and filters of a collection, open to insertions and deletions.

    A change reads the references once, but counts anew and shuffles only those of the keys that it
    concerns, and touches only their shards' filters. Filters that are full are built anew, all of them
    once there are twice the keys that they were made for.
    """

    def __init__(self, refs: DataFrame, common: DataFrame, scratch: Scratch, before: LineIndex | None = None, keys: DataFrame | None = None) -> None:
        self.refs, self.common, self.scratch = refs, common, scratch
        stats = common.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.n_common, self.n_rows = stats[0], stats[1]
        self.changes = before.changes + 1 if before else 0
        self.shards = max(1, -(-self.n_common // SHARD_KEYS))
        if before is None or keys is None or self.shards > 2 * before.shards:
            self.filters = scratch.keep(build_filters(common, self.shards))
        else:
            self.shards = before.shards
            self.filters = self._updated(before, keys)

    @classmethod
    def of(cls, docs: DataFrame, scratch: Scratch | None = None) -> LineIndex:
        scratch = scratch or Scratch(docs.sparkSession)
        refs = scratch.keep(references(docs))
        return cls(refs, scratch.keep(_common(refs)), scratch)

    def _updated(self, before: LineIndex, keys: DataFrame) -> DataFrame:
        now, was = self.common.join(keys, "key", "left_semi"), before.common.join(keys, "key", "left_semi")
        made = self.scratch.keep(update_filters(before.filters, now.join(was, "key", "left_anti"), was.join(now, "key", "left_anti"), self.shards))
        full = [r["shard"] for r in made.filter("words is null").select("shard").collect()]  # numbers of shards
        if not full:
            return made
        anew = self.common.filter(_shard(F.col("key"), self.shards).isin(full))
        return self.scratch.keep(made.filter("words is not null").unionByName(build_filters(anew, self.shards)))

    def _changed(self, refs: DataFrame, keys: DataFrame) -> LineIndex:
        """The index of ``refs``, which differ from the present ones in references to ``keys`` only."""
        keys = self.scratch.keep(keys.distinct())
        again = _common(refs.join(keys, "key", "left_semi"))
        common = self.scratch.keep(self.common.join(keys, "key", "left_anti").unionByName(again))
        if (self.changes + 1) % COMPACT == 0:
            refs = self.scratch.keep(refs)
        return LineIndex(refs, common, self.scratch, self, keys)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with more documents; an id that is present gains the new lines."""
        new = self.scratch.keep(references(docs))
        present = self.refs.join(new, ["key", "doc_id"], "left_semi")
        added = self.scratch.keep(new.join(present, ["key", "doc_id"], "left_anti"))
        return self._changed(self.refs.unionByName(added), added.select("key"))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ``ids`` (doc_id), as if they had never been there."""
        gone = self.scratch.keep(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
        keys = self.refs.join(gone, "doc_id", "left_semi").select("key")
        return self._changed(self.refs.join(gone, "doc_id", "left_anti"), keys)

    def _maybe(self, lines: Column, rows: DataFrame) -> DataFrame:
        """(id, print, i, key) of the lines of ``rows`` that the filters let through."""
        shard = lambda key: _shard(key, self.shards)
        holds = lambda words, start, size, key: may_contain(words, start, size, key["b"])
        if self.n_common <= FILTER_KEYS:
            made = {r["shard"]: r["words"] for r in self.filters.collect()}  # FILTER_KEYS keys at most
            parts = [made.get(s, [0]) for s in range(self.shards)]
            words, sizes = long_array(w for p in parts for w in p), long_array(map(len, parts))
            starts = long_array(accumulate(map(len, parts[:-1]), initial=0))
            lines = F.filter(lines, lambda x: holds(words, F.get(starts, shard(x["key"])), F.get(sizes, shard(x["key"])), x["key"]))
        every = rows.filter("id is not null").select("id", "print", F.explode(lines).alias("x")).select("id", "print", "x.i", "x.key")
        if self.n_common <= FILTER_KEYS:
            return every
        # lines of a key that most documents have make a hot shard; others spread evenly
        counts = self.common.groupBy(shard(F.col("key")).alias("shard")).agg(F.sum("n").alias("n"))
        test = lambda words: holds(words, F.lit(0), F.size(words), F.col("key"))
        salt = F.pmod(F.xxhash64("id", "i"), F.lit(1 << 20)) + 1
        return at_shards(every, shard(F.col("key")), self.filters, test, hot_of(counts, "shard", self.n_rows), salt, "maybe").filter("maybe").drop("maybe")

    def apply(self, docs: DataFrame) -> DataFrame:
        """(row, text, n_lines, n_dropped): ``row`` is the struct of all columns of ``docs``.

        ``text`` has the lines that stay: common keys lose their lines in all documents but the
        largest id that holds them.
        """
        numbered = F.transform(lines_of(F.col("row.text")), lambda line, i: F.struct(i.alias("i"), key_of(line).alias("key")))
        rows = docs.select(F.struct("*").alias("row")).withColumns(
            {"id": F.col("row.doc_id").cast("long"), "print": F.xxhash64("row.text")}
        )
        some = self._maybe(F.filter(numbered, lambda x: x["key"].isNotNull()), rows)
        salt = F.pmod(F.xxhash64("id", "i"), F.lit(1 << 20)) + 1
        met = salted_join(some, self.common.select("key", "last"), "key", salt, self.common.select("key", "n"), self.n_rows)
        lost = met.filter(F.col("id") < F.col("last"))
        # a mask of 64 lines a word: repeated rows of a document set the same bits
        word = F.floor(F.col("i") / 64).cast("int")
        masks = lost.groupBy("id", "print", word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % 64)).alias("bits"))
        masks = masks.groupBy("id", "print").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
        joined = rows.join(masks.withColumnsRenamed({"id": "id2", "print": "print2"}), (F.col("id") == F.col("id2")) & (F.col("print") == F.col("print2")), "left")
        lines = lines_of(F.col("row.text"))
        top = F.greatest(F.floor((F.size(lines) - 1) / 64).cast("int"), F.lit(0))
        dense = F.transform(F.sequence(F.lit(0), top), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long")))
        def kept(masks: Column) -> Column:
            gone = lambda i: F.call_function("getbit", F.get(masks, F.floor(i / 64).cast("int")), i % 64)
            return F.filter(lines, lambda _, i: gone(i) == 0)

        out = joined.select(
            "row", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("m").isNull(), lines).otherwise(let(dense, kept)).alias("kept")
        )
        return out.select(
            "row",
            F.array_join("kept", "\n").alias("text"),
            "n_lines",
            (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        )


def dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with repeated lines dropped; ``n_chars``, where it exists, follows the text."""
    made = LineIndex.of(docs, scratch).apply(docs)
    columns: Iterator[Column] = (
        F.col("text") if c == "text"
        else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    )
    return made.select(*columns)
