"""Ranked retrieval: BM25, vectors, fusion of rankings, budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.batches import large_texts, map_batches, slices, word_codes
from quarry.functions.text import SEPARATORS, STOPWORDS, content_words, once, tokens

K1, B = 1.2, 0.75
#: Queries that one pass over the rows answers.
QUERY_BLOCK = 1024
RRF_K = 60


def bm25(corpus: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of every text of ``corpus`` (id, text) that has a term of one of ``queries``
    (query_id, text); ``bm25_top_k`` is the way to the best alone.

    Statistics are those of the whole corpus; filters belong after ranking. Scores are rounded to nine
    places, so that equal texts tie whatever the order of summation. Only occurrences of query
    terms are shuffled: a text is cut into words once, and words outside the queries go at once.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    size = corpus.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # the length goes with each word; a column beside the array would carry the array along
    words = once(tokens(F.col("text")), lambda t: F.transform(t, lambda w: F.struct(w.alias("term"), F.size(t).alias("dl"))))
    found = corpus.select("id", F.explode(words).alias("x")).select("id", "x.term", "x.dl").join(wanted, "term", "left_semi")
    tf = found.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # asks for tf, so that both uses share one shuffle
    n, avgdl = F.col("n"), F.col("avgdl")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    # one row of statistics and as many rows as there are query terms
    stats = df.crossJoin(F.broadcast(size))
    return tf.join(stats, "term").join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), 9).alias("score"))


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group. Spark turns the filter on the rank into a limit before the
    shuffle, so a large group sends ``k`` rows from each task."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zeros stay."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Best:
    """The ``k`` best (score, id) of each of ``n`` queries so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.full((0, n), -np.inf), np.zeros((0, n), dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` is (rows, queries); a score of minus infinity is no hit."""
        every = np.concatenate([self.scores, scores])
        whose = np.concatenate([self.ids, np.broadcast_to(ids[:, None], scores.shape)])
        hit = np.isfinite(every)
        if len(every) > self.k:  # no hit below the k-th score can stay
            hit &= every >= np.partition(every, len(every) - self.k, axis=0)[len(every) - self.k]
        row, query = np.nonzero(hit)
        order = np.lexsort((whose[row, query], -every[row, query], query))
        row, query = row[order], query[order]
        place = np.arange(len(query)) - np.searchsorted(query, np.arange(every.shape[1]))[query]
        row, query, place = row[place < self.k], query[place < self.k], place[place < self.k]
        self.scores, self.ids = np.full((self.k, every.shape[1]), -np.inf), np.zeros((self.k, every.shape[1]), dtype=np.int64)
        self.scores[place, query], self.ids[place, query] = every[row, query], whose[row, query]

    def rows(self, queries: np.ndarray) -> pa.RecordBatch:
        hit = np.isfinite(self.scores)
        asked = np.broadcast_to(queries[None, :], self.scores.shape)
        return pa.RecordBatch.from_arrays([pa.array(asked[hit]), pa.array(self.ids[hit]), pa.array(self.scores[hit])], names=["query_id", "id", "score"])


HITS = "query_id bigint, id bigint, score double"


def _in_blocks(queries: DataFrame, search: Callable[[list], DataFrame], size: int = QUERY_BLOCK, schema: str = HITS) -> DataFrame:
    """Search results of all queries, a block of them at a time, so that neither the driver nor a task
    holds more than a block."""
    rows, parts = queries.toLocalIterator(), []
    while block := list(islice(rows, size)):
        parts.append(search(block))
    if not parts:
        return queries.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of the ``k`` nearest of ``vectors`` (id, vector) to each of ``queries``
    (query_id, vector), by blocks of matrix products; scores are rounded to nine places, ties go to the
    smaller id.

    A task keeps its ``k`` best of each query, so what is shuffled follows tasks, not rows.
    """

    def search(block: list) -> DataFrame:
        asked = np.array([r["query_id"] for r in block], dtype=np.int64)
        matrix = unit_rows(np.array([r["vector"] for r in block], dtype=np.float64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(asked), k)
            for batch in batches:
                for part in slices(batch, 2048, 8 << 20):
                    best.add(np.round(unit_rows(matrix_of(part.column(1))) @ matrix.T, 9), part.column(0).to_numpy(zero_copy_only=False))
            yield best.rows(asked)

        return vectors.select(F.col("id").cast("long").alias("id"), "vector").filter("vector is not null").mapInArrow(run, HITS)

    return top_k(_in_blocks(queries.select("query_id", "vector"), search), ["query_id"], [F.desc("score"), F.asc("id")], k)


def bm25_top_k(corpus: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The ``k`` best of ``bm25`` for each query, by two passes over the texts in Arrow batches.

    The first counts documents with each query term; the second multiplies term weights of some texts
    with the terms of all queries and keeps the ``k`` best in each task, so that nothing but these
    and the counts is shuffled.
    """
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("terms"))
    rows = corpus.select(F.col("id").cast("long").alias("id"), "text")

    def search(block: list) -> DataFrame:
        terms = sorted({t for r in block for t in r["terms"]})
        place = {t: i for i, t in enumerate(terms)}
        names = pa.array(terms, pa.large_string())
        ids = np.array([r["query_id"] for r in block], dtype=np.int64)
        wanted = np.zeros((len(terms), len(block)))
        for j, r in enumerate(block):
            wanted[[place[t] for t in r["terms"]], j] = 1.0

        def cut(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(text, term) of the occurrences of query terms, and the words of each text."""
            words, codes, ends = word_codes(pc.split_pattern_regex(pc.utf8_lower(large_texts(text)), SEPARATORS))
            size = np.diff(ends, prepend=0)
            term = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy(zero_copy_only=False)[codes]
            return np.repeat(np.arange(len(text)), size)[term >= 0], term[term >= 0], size

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n, total = np.zeros(len(terms), dtype=np.int64), 0, 0
            for batch in batches:
                for part in slices(batch, 512, 2 << 20):
                    doc, term, size = cut(part.column(1))
                    df += np.bincount(np.unique(doc * max(1, len(terms)) + term) % max(1, len(terms)), minlength=len(terms))[: len(terms)]
                    n, total = n + len(size), total + int(size.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(terms)), [-1, -2])), pa.array(np.append(df, [n, total]))], names=["term", "n"])

        counts = {r["term"]: r["n"] for r in rows.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, total = counts.get(-1) or 0, counts.get(-2) or 0
        df = np.array([counts.get(i, 0) for i in range(len(terms))], dtype=np.float64)
        idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / max(1, n)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(ids), k)
            for batch in batches:
                for part in slices(batch, 128, 2 << 20):
                    doc, term, size = cut(part.column(1))
                    tf = np.bincount(doc * len(terms) + term, minlength=len(size) * len(terms)).reshape(len(size), len(terms)) if terms else np.zeros((len(size), 0))
                    weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[:, None] / max(mean, 1e-300)))
                    scores = np.round(weight @ wanted, 9)
                    best.add(np.where(scores > 0, scores, -np.inf), part.column(0).to_numpy(zero_copy_only=False))
            yield best.rows(ids)

        return rows.mapInArrow(score, HITS)

    return top_k(_in_blocks(asked, search), ["query_id"], [F.desc("score"), F.asc("id")], k)


def frequent_words(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, words): the ``n`` most frequent content words of each text, as ``functions.text.top_words`` has
    them, counted over Arrow batches: for whole corpora, where sorting each text's words costs too much."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        idle = pa.array(STOPWORDS, pa.large_string())

        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            # the one letter that Java's lower case makes two of
            whole = pc.replace_substring(large_texts(part.column(1)), "\u0130", "i\u0307")
            runs, codes, ends = word_codes(pc.split_pattern_regex(pc.utf8_lower(whole), "[^a-z0-9_]+"))
            # a word begins with the first letter of its run
            words = pc.utf8_ltrim(runs, characters="0123456789_").dictionary_encode()
            names = words.dictionary
            good = pc.and_(pc.greater_equal(pc.utf8_length(names), 3), pc.invert(pc.is_in(names, value_set=idle))).to_numpy(zero_copy_only=False)
            codes = words.indices.to_numpy(zero_copy_only=False)[codes].astype(np.int64) if len(codes) else codes.astype(np.int64)
            doc = np.repeat(np.arange(part.num_rows), np.diff(ends, prepend=0))
            kept = good[codes] if len(codes) else np.zeros(0, dtype=bool)
            pairs, first, count = np.unique(doc[kept] * max(1, len(names)) + codes[kept], return_index=True, return_counts=True)
            owner = pairs // max(1, len(names))
            order = np.lexsort((first, -count, owner))
            start = np.searchsorted(owner, np.arange(part.num_rows))
            chosen = order[np.arange(len(order)) - start[owner] < n]
            sizes = np.minimum(np.bincount(owner, minlength=part.num_rows), n)
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), names.take(pa.array(pairs[chosen] % max(1, len(names)))).cast(pa.string()))
            return pa.RecordBatch.from_arrays([part.column(0), listed], names=[key, "words"])

        return of

    return map_batches(rows, [key, "text"], f"{key} {rows.schema[key].dataType.simpleString()}, words array<string>", make, slice_bytes=4 << 20)


def contains_all(corpus: DataFrame, query: str) -> DataFrame:
    """(id) of texts that have every token of the query, newest first, as a boolean search."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    return corpus.filter(once(tokens(F.col("text")), lambda t: F.size(F.array_except(wanted, t)) == 0) & (F.size(wanted) > 0)).select("id")


def substring_search(corpus: DataFrame, needles: Sequence[str]) -> DataFrame:
    """(id, needle) of the first of the needles that a text contains, letters' case aside. Needles are
    literal: ``%`` and ``_`` mean themselves."""
    low = F.lower("text")
    hit = F.coalesce(*[F.when(F.contains(low, F.lower(F.lit(n))), n) for n in needles])
    return corpus.select("id", hit.alias("needle")).filter("needle is not null")


def rank_of(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rank`` from 0 by score, then id."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w) - 1)


def reciprocal_rank_fusion(ranked: Sequence[DataFrame], k: int = RRF_K, by: Sequence[str] = ()) -> DataFrame:
    """(by..., id, rrf_score, source_score) of rankings (by..., id, rank, score): sums of 1 / (k + rank + 1).

    Ties go to the smaller id. The best source score is kept beside, and the fused score orders.
    """
    if not ranked:
        raise ValueError("nothing to fuse")
    every = reduce(DataFrame.union, [one.select(*by, "id", "score", (F.lit(1.0) / (k + 1 + F.col("rank"))).alias("share")) for one in ranked])
    return every.groupBy(*by, "id").agg(F.sum("share").alias("rrf_score"), F.max("score").alias("source_score"))


def interleave(branches: Sequence[DataFrame], limit: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., id, branch, rank): branches in order, each hit where it first appears, ``limit`` hits of each
    query."""
    if not branches:
        raise ValueError("nothing to merge")
    every = reduce(DataFrame.union, [one.select(*by, "id", F.lit(number).alias("branch"), "rank") for number, one in enumerate(branches)])
    first = every.groupBy(*by, "id").agg(F.min(F.struct("branch", "rank")).alias("m")).select(*by, "id", "m.branch", "m.rank")
    return best_of(first, [F.asc("branch"), F.asc("rank"), F.asc("id")], limit, by)


def best_of(rows: DataFrame, order: Sequence[Column], limit: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` rows by ``order``, of all rows or of each query."""
    return top_k(rows, by, order, limit) if by else rows.orderBy(*order).limit(limit)


def disclose(hits: DataFrame, budget: int, order: Sequence[Column], size: Column, by: Sequence[str] = ()) -> DataFrame:
    """The longest prefix of hits whose sizes fit the budget, and always the first hit."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = hits.withColumns({"_n": F.row_number().over(w), "cumulative": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return run.filter((F.col("_n") == 1) | (F.col("cumulative") <= budget)).drop("_n")


def any_token_matches(rows: DataFrame, query: str, text: Column) -> DataFrame:
    """Rows with ``match_count`` of the query's content words that occur in a text; without words, all."""
    wanted = F.array_distinct(content_words(F.lit(query)))
    counted = rows.withColumn("match_count", once(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.size(F.filter(wanted, lambda w: F.contains(t, w)))))
    return counted.filter((F.col("match_count") > 0) | (F.size(wanted) == 0))


def best_per_session(hits: DataFrame) -> DataFrame:
    """(session_id, best_id, best_score, match_count) of hits (session_id, id, score)."""
    best = F.max_by("id", F.struct("score", -F.col("id")))
    return hits.groupBy("session_id").agg(best.alias("best_id"), F.max("score").alias("best_score"), F.count("*").alias("match_count"))


@dataclass(frozen=True)
class Preset:
    """Cells of an index, as a share of the root of its rows, and the share of cells that a query visits."""

    cells: float
    visits: float


#: Presets by name. Their recall of the ten nearest is measured in the tests.
PRESETS = {"balanced": Preset(1.5, 0.7), "high-recall": Preset(1.5, 0.85), "low-memory": Preset(0.7, 0.7)}
#: Rows of a bounded sample from which an index's centres are fitted, by a hash of the id.
INDEX_SAMPLE = 20_000


@dataclass(frozen=True)
class CellIndex:
    """Vectors by the nearest of some centres; a query visits the cells whose centres are nearest to it.

    Centres come from a sample of ``INDEX_SAMPLE`` rows; every row is in a cell. ``rows`` is (id, vector,
    cell); written with ``partitionBy("cell")``, a search reads the cells that its queries visit.
    """

    centres: np.ndarray
    rows: DataFrame
    preset: Preset

    @classmethod
    def build(cls, vectors: DataFrame, preset: str = "balanced", rounds: int = 8) -> CellIndex:
        kind = PRESETS[preset]
        n = vectors.count()
        key = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        some = vectors.filter(key < int(min(1.0, INDEX_SAMPLE / max(1, n)) * (1 << 30))).orderBy(key, "id").limit(2 * INDEX_SAMPLE).select("vector").collect()
        if not some:
            return cls(np.zeros((0, 0)), vectors.withColumn("cell", F.lit(None).cast("int")), kind)
        sample = unit_rows(np.array([r["vector"] for r in some], dtype=np.float64))
        centres = sample[: max(1, min(len(sample), round(kind.cells * np.sqrt(n))))].copy()
        for _ in range(rounds):
            own = (sample @ centres.T).argmax(axis=1)
            for j in np.unique(own):
                centres[j] = sample[own == j].mean(axis=0)
            centres = unit_rows(centres)
        return cls(centres, cls.placed(vectors, centres), kind)

    @staticmethod
    def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = (matrix_of(batch.column(1)) @ centres.T).argmax(axis=1) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["id", "vector", "cell"])

        kind = vectors.schema["vector"].dataType.simpleString()
        return vectors.select(F.col("id").cast("long").alias("id"), "vector").filter("vector is not null").mapInArrow(run, f"id bigint, vector {kind}, cell int")

    def append(self, new: DataFrame) -> CellIndex:
        """The index with rows of ids that it lacks."""
        return CellIndex(self.centres, self.rows.unionByName(self.placed(new.join(self.rows.select("id"), "id", "left_anti"), self.centres)), self.preset)

    def remove(self, ids: DataFrame) -> CellIndex:
        return CellIndex(self.centres, self.rows.join(ids.select("id"), "id", "left_anti"), self.preset)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score): the nearest by cosine among the rows of the visited cells."""
        visits = max(1, int(np.ceil(self.preset.visits * len(self.centres))))

        def block_of(block: list) -> DataFrame:
            asked = np.array([r["query_id"] for r in block], dtype=np.int64)
            matrix = unit_rows(np.array([r["vector"] for r in block], dtype=np.float64))
            near = np.argsort(-(matrix @ self.centres.T), axis=1, kind="stable")[:, :visits]
            visited = np.zeros((len(asked), len(self.centres)), dtype=bool)
            np.put_along_axis(visited, near, True, axis=1)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = Best(len(asked), k)
                for batch in batches:
                    for part in slices(batch, 2048, 8 << 20):
                        ids, cells = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                        rows = unit_rows(matrix_of(part.column(1)))
                        scores = np.full((len(rows), len(asked)), -np.inf)
                        for cell in np.unique(cells):
                            mine, who = np.flatnonzero(cells == cell), np.flatnonzero(visited[:, cell])
                            scores[np.ix_(mine, who)] = np.round(rows[mine] @ matrix[who].T, 9)
                        best.add(scores, ids)
                yield best.rows(asked)

            used = np.flatnonzero(visited.any(axis=0)).tolist()
            return self.rows.select("id", "vector", "cell").filter(F.col("cell").isin(used)).mapInArrow(run, HITS)

        if not len(self.centres):
            return queries.sparkSession.createDataFrame([], HITS)
        return top_k(_in_blocks(queries.select("query_id", "vector"), block_of), ["query_id"], [F.desc("score"), F.asc("id")], k)
