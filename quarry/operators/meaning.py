"""Vectors of texts learned from a corpus: words that stand with the same words are near each other.

Texts are rows of a matrix, words its columns, weighed by rarity and the root of their count. Its main
directions are found by a randomised factorisation: random vectors over words are multiplied with the
matrix and its transpose a few times, each time in one pass over the texts, whose tasks add up their part of
the product; between passes the driver makes the result orthogonal. What the driver and each task hold
is a table of ``vocabulary`` words by ``dims`` and a few numbers, whatever the corpus.

A text's vector is the sum of its words' directions, each as long as it is strong, scaled to length one; two texts without a common word
are near if their words have stood with the same ones. Words outside the vocabulary (the most frequent
of those that at least two texts have) add nothing; a text without known words has a zero vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.batches import map_batches
from quarry.operators.retrieval import unit_rows
from quarry.operators.textindex import TEXTS, word_counts
from quarry.session import kept

DIMS, VOCABULARY, PASSES, MORE = 64, 20_000, 3, 8
#: Words of one row of a partial product.
STRIPE = 256


def _weighted(part: pa.RecordBatch, known: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, weight) of the known words of texts, each text's weights of length one."""
    terms, tfs = part.column("terms"), part.column("tfs")
    word = pc.fill_null(pc.index_in(pc.list_flatten(terms), value_set=known), -1).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    has = word >= 0
    word, text = word[has], text[has]
    weight = idf[word] * np.sqrt(pc.list_flatten(tfs).to_numpy(zero_copy_only=False)[has])
    norm = np.sqrt(np.bincount(text, weights=weight**2, minlength=len(terms)))
    return text, word, weight / np.maximum(norm[text], 1e-300)


def _times(text: np.ndarray, word: np.ndarray, weight: np.ndarray, texts: int, matrix: np.ndarray) -> np.ndarray:
    """The weighed rows of ``matrix`` (word, ...) summed by text."""
    out = np.zeros((texts, matrix.shape[1]))
    if len(text):
        first = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[first]] = np.add.reduceat(weight[:, None] * matrix[word], first)
    return out


@dataclass(frozen=True)
class LearnedVectors:
    words: list[str]
    idf: np.ndarray
    directions: np.ndarray

    @classmethod
    def fit(cls, corpus: DataFrame, dims: int = DIMS, vocabulary: int = VOCABULARY, passes: int = PASSES, seed: int = 1) -> LearnedVectors:
        """From ``corpus`` (id, text)."""
        texts = kept(word_counts(corpus))
        counts = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter("df > 1")
        rows = counts.orderBy(F.desc("df"), "term").limit(vocabulary).collect()  # at most ``vocabulary``
        words, df = [r["term"] for r in rows], np.array([r["df"] for r in rows], dtype=np.float64)
        idf = np.log1p(texts.count() / np.maximum(df, 1.0))
        if not words:
            return cls([], idf, np.zeros((0, dims)))
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(words), min(len(words), dims + MORE))))[0]
        for _ in range(passes):
            basis = np.linalg.qr(cls._product(texts, words, idf, basis))[0]
        # the directions within the basis, strongest first, and longer the stronger: what words have in common with
        # the same neighbours counts for more than what tells single words apart
        strength, turn = np.linalg.eigh(basis.T @ cls._product(texts, words, idf, basis))
        order = np.argsort(-strength)[:dims]
        return cls(words, idf, basis @ turn[:, order] * (np.maximum(strength[order], 0) / max(strength.max(), 1e-300)))

    @staticmethod
    def _product(texts: DataFrame, words: list[str], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """The matrix's transpose times the matrix times ``basis``."""
        shape, names = basis.shape, pa.array(words, pa.string())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    text, word, weight = _weighted(part, names, idf)
                    seen = _times(text, word, weight, part.num_rows, basis)
                    order = np.argsort(word, kind="stable")
                    total += _times(word[order], text[order], weight[order], shape[0], seen)
            firsts = list(range(0, shape[0], STRIPE))
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int32()), pa.array([total[a : a + STRIPE].reshape(-1) for a in firsts], pa.list_(pa.float64()))], names=["first", "part"])

        def add(table: pa.Table) -> pa.Table:
            parts = table.column("part").combine_chunks()
            summed = pc.list_flatten(parts).to_numpy(zero_copy_only=False).reshape(len(parts), -1).sum(axis=0)
            return pa.table({"first": table.column("first")[:1], "part": pa.array([summed], pa.list_(pa.float64()))})

        schema = "first int, part array<double>"
        found = texts.select("terms", "tfs").mapInArrow(run, schema).groupBy("first").applyInArrow(add, schema)
        return np.concatenate([np.array(r["part"]) for r in sorted(found.collect(), key=lambda r: r["first"])]).reshape(shape)

    def embed(self, texts: DataFrame) -> DataFrame:
        """(id, vector) of texts (id, text)."""
        names, idf, directions = pa.array(self.words, pa.string()), self.idf, self.directions

        def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            def of(part: pa.RecordBatch) -> pa.RecordBatch:
                vectors = unit_rows(_times(*_weighted(part, names, idf), part.num_rows, directions))
                return pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], names=["id", "vector"])

            return of

        counted = word_counts(texts)
        return map_batches(counted, [c.split()[0] for c in TEXTS.split(", ")], "id bigint, vector array<double>", make, slice_rows=128)
