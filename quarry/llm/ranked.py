"""Ranked lexical search: weak-AND (WAND) in shards of documents, shards' best merged.

Documents are cut into terms once. What is kept of one is its length and the counts of those terms that
some item has, by the number of the term, so the stored table follows the terms of the items and not the
texts. Corpus counts (documents, terms, documents of each term) come from that table.

A task is a shard. It inverts its documents into a list for each term, some documents at a time, and knows
each term's greatest share of a score there. For each item the lists stand sorted by the document that
they have reached; the first prefix of them whose greatest shares could reach the worst of the best
``k`` names the pivot, and all lists before it leap to that document. Documents that are leapt over are not
scored. What is best goes on from one part of a shard to the next, so the bar is high from its start;
each task gives out ``k`` rows an item at most, and these are ranked together.

Defined results: a null or termless text is no document and has no score. Repeated documents are documents
of their own. Rows with a null id count in all statistics and are never returned, as nothing could be
told of them. Repeated items count once; an item without terms, or whose terms no document has, returns no
row. A long text is a slice of its own and costs what its terms take. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.batches import give_back, large_texts, map_batches, word_codes
from quarry.llm.common import LOWER, UPPER, Scratch

#: Terms are runs of ASCII letters and digits and of all that is beyond ASCII; only A-Z is lower-cased.
_BYTES = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)
_BYTES[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
#: Items that one pass over the documents answers, and postings that a task inverts at a time.
ITEM_BLOCK = 1024
PART_POSTINGS = 1 << 21
#: Score of one term: weight * (SCALE * tf) div (1000 * tf + 12 * m), m = 75 + (25 * n * N) div L.
SCALE = 1_000_000_000
END = 1 << 62


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, number of each occurrence's term, ends of texts among occurrences)."""
    whole = large_texts(texts)
    at = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    plain = pa.Array.from_buffers(pa.large_string(), len(whole), [None, pa.py_buffer(at - at[0]), pa.py_buffer(_BYTES[data])])
    return word_codes(pc.split_pattern(plain, " "))


def terms_of_item(text: str | None) -> Counter:
    words, codes, _ = terms_of(pa.array([text], pa.large_string()))
    names = words.to_pylist()
    return Counter(names[c] for c in codes.tolist())


def postings(docs: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document that has a term: how many it has, and how often those of
    ``names`` by their number."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known = pa.array(names, pa.large_string())

        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            words, codes, ends = terms_of(part.column(1))
            size = np.diff(ends, prepend=0).astype(np.int64)
            term = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            doc = np.repeat(np.arange(len(size)), size)[term >= 0]
            pairs, tf = np.unique(doc * max(1, len(names)) + term[term >= 0], return_counts=True)
            of_doc = np.bincount(pairs // max(1, len(names)), minlength=len(size))
            starts = pa.array(np.append(0, np.cumsum(of_doc)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(names)), tf)]
            whole = pa.RecordBatch.from_arrays([part.column(0), pa.array(size), *lists], names=["doc_id", "n", "terms", "tfs"])
            return whole.filter(pa.array(size > 0))

        return of

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, ["doc_id", "text"], "doc_id bigint, n bigint, terms array<int>, tfs array<int>", make, slice_bytes=4 << 20)


def corpus_counts(table: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents, their terms, documents of each of ``size`` terms): counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            df += np.bincount(pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False), minlength=size)
            docs, total = docs + batch.num_rows, total + (pc.sum(batch.column(0)).as_py() or 0)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(df[used], [docs, total]))], names=["term", "n"])

    counted = table.select("n", "terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # a row a term of a block of items
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(size)], dtype=np.int64)


class Inverted:
    """Some documents of a shard by term: for each term its documents in order, what it adds to their
    scores, and the most that it adds."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, docs: int, total: int) -> None:
        m = 75 + (25 * n * docs) // total
        doc = np.repeat(np.arange(len(n)), sizes)
        tf = tf.astype(np.int64)
        share = weights[terms] * ((SCALE * tf) // (1000 * tf + 12 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.docs = array("q", doc[order].astype(np.int64).tobytes())
        self.shares = array("q", share[order].tobytes())
        self.lists: dict[int, tuple[int, int, int]] = {}
        if not len(terms):
            return
        present, first = np.unique(terms[order], return_index=True)
        most = np.maximum.reduceat(share[order], first)
        ends = np.append(first[1:], len(terms))
        self.lists = {t: (a, b, c) for t, a, b, c in zip(present.tolist(), first.tolist(), ends.tolist(), most.tolist(), strict=True)}


def weak_and(part: Inverted, asked: list[tuple[int, int]], ids: list[int], best: list[tuple[int, int]], k: int) -> int:
    """Bring ``best``, a heap of (score, -id), up to date with the documents of ``part``; how many were scored.

    ``asked`` is (term, times) of one item. A document can be left out only if the most that its terms add
    is below the worst of ``k``; at the same score the id decides, so that one is scored.
    """
    docs, shares, scored = part.docs, part.shares, 0
    # [document reached, place, end of the list, most it adds, times asked]
    lists = [[docs[a], a, b, most * times, times] for term, times in asked if term in part.lists for a, b, most in (part.lists[term],) if most > 0]
    bar = best[0][0] if len(best) == k else 1
    first = itemgetter(0)
    while True:
        lists.sort(key=first)
        reach = pivot = 0
        for pivot, one in enumerate(lists):
            reach += one[3]
            if reach >= bar:
                break
        else:
            return scored
        at = one[0]
        if at == END:
            return scored
        if lists[0][0] == at:
            score = 0
            for one in lists:
                if one[0] != at:
                    break
                place = one[1]
                score += shares[place] * one[4]
                one[1] = place = place + 1
                one[0] = docs[place] if place < one[2] else END
            scored += 1
            if score >= bar:
                hit = (score, -ids[at])
                if len(best) < k:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)
                if len(best) == k:
                    bar = best[0][0]
        else:
            for one in islice(lists, pivot):
                if one[0] < at:
                    one[1] = place = bisect_left(docs, at, one[1], one[2])
                    one[0] = docs[place] if place < one[2] else END


def best_of_shards(table: DataFrame, asked: list[list[tuple[int, int]]], weights: np.ndarray, docs: int, total: int, k: int, part_postings: int = PART_POSTINGS) -> DataFrame:
    """(item, doc_id, score): the ``k`` best documents of each shard for each of ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in asked]

        def search(some: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(some).combine_chunks()
            if not whole.num_rows:
                return
            column = lambda name: whole.column(name).combine_chunks()
            terms, tfs = column("terms"), column("tfs")
            flat = [pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (terms, tfs)]
            sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            part = Inverted(column("n").to_numpy(zero_copy_only=False), sizes, *flat, weights, docs, total)
            ids = column("doc_id").to_pylist()
            for one, heap in zip(asked, best, strict=True):
                weak_and(part, one, ids, heap, k)

        try:
            some, size = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    size += len(pc.list_flatten(piece.column(2)))
                    some.append(piece)
                    if size >= part_postings:
                        search(some)
                        some, size = [], 0
            if some:
                search(some)
            hits = [(item, -number, score) for item, heap in enumerate(best) for score, number in heap]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in range(3)], names=["item", "doc_id", "score"])
        finally:
            give_back()

    return table.filter("doc_id is not null").select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, scratch: Scratch | None = None, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best of ``docs`` (doc_id, text) for each of ``items``
    (item_id, text); the query set is taken ``item_block`` at a time against all documents."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows, parts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().toLocalIterator(), []
    while block := list(islice(rows, item_block)):
        counts = [terms_of_item(r["text"]) for r in block]
        names = sorted(set().union(*counts))
        number = {t: i for i, t in enumerate(names)}
        table = scratch.keep(postings(docs, names))
        n, total, df = corpus_counts(table, len(names))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in df.tolist()], dtype=np.int64)
        asked = [sorted((number[t], times) for t, times in c.items()) for c in counts]
        found = best_of_shards(table, asked, weights, n, max(1, total), k)
        named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "item bigint, item_id bigint")
        ranked = found.selectExpr("item", "doc_id", "score", "row_number() over (partition by item order by score desc, doc_id) as rank")
        # a row an item of the block
        parts.append(ranked.filter(F.col("rank") <= k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, parts)
