"""Language identification, words first and character n-grams for unseen words.

A known word scores by its log frequency in each language. An unseen word falls back to its n-grams of
five characters; if none of them is known, to those of four, and so on to single characters. Words and
n-grams are known if the sample has them ``LEAST`` times; rarer words still teach their n-grams.

Learning reads about ``SAMPLE`` documents of each language, chosen by a hash of the id at a share that
follows from how many ids there are, never from the held-out fold. Spark counts words; the driver gets
the counts, which the sample bounds. Scoring is one pass that looks up each distinct word of a slice
once.

The score is the share that the best language has of the languages' mean likelihoods a word.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is everything if
nothing could be learned; equal scores go to the first language in order; repeated rows get equal
results; rows without a language are not learned from; of texts that share an id and a language the
smallest is learned from; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.batches import large_texts, map_batches, word_codes
from quarry.llm.common import fold

SAMPLE = 1000
#: Times that the sample must have a word or n-gram for it to be known.
LEAST = 2
GRAM = 5
UNKNOWN = "und"
NOT_LETTERS = r"[^\p{L}]+"
#: Odd multiplier of the n-grams' hash.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Table:
    """Log frequencies of keys (a row each) in all languages."""

    keys: pa.Array | np.ndarray  # words, or sorted hashes of n-grams
    scores: np.ndarray


@dataclass(frozen=True)
class Model:
    languages: list[str]
    words: Table
    grams: list[Table]  # by length, from 1

    def scores(self, words: pa.Array) -> np.ndarray:
        """A row of scores for each word; zeros where not even a character is known."""
        out = np.zeros((len(words), len(self.languages)))
        found = pc.fill_null(pc.index_in(words, value_set=self.words.keys), -1).to_numpy(zero_copy_only=False)
        out[found >= 0] = self.words.scores[found[found >= 0]]
        open_ = np.flatnonzero(found < 0)
        for n in range(GRAM, 0, -1):
            if not len(open_):
                break
            table = self.grams[n - 1]
            h, owner = gram_hashes(words.take(pa.array(open_)), n)
            at = np.minimum(np.searchsorted(table.keys, h), max(0, len(table.keys) - 1))
            known = table.keys[at] == h if len(table.keys) else np.zeros(len(h), dtype=bool)
            at, owner = at[known], owner[known]
            times = np.bincount(owner, minlength=len(open_))
            for j in range(len(self.languages)):
                out[open_, j] = np.bincount(owner, table.scores[at, j], len(open_)) / np.maximum(1, times)
            open_ = open_[times == 0]
        return out


def gram_hashes(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the word) of the n-grams of all words, each word framed by ``^`` and ``$``."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    letters = np.frombuffer("".join(f"^{w}$" for w in words.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(np.arange(len(letters)) + n <= ends[owner]) if len(letters) else np.zeros(0, dtype=np.int64)
    h = np.zeros(len(start), dtype=np.uint64)
    for j in range(n):
        h = (h ^ letters[start + j]) * SPREAD
        h ^= h >> np.uint64(29)
    return h, owner[start]


def _logs(raw: np.ndarray) -> np.ndarray:
    """Log frequencies by column, add-half smoothed, from the counts of all keys."""
    return np.log((raw + 0.5) / (raw.sum(axis=0) + 0.5 * (len(raw) + 1))).astype(np.float32)


def build(langs: pa.Array, words: pa.Array, counts: np.ndarray) -> Model:
    """The model of (language, word, count) rows, each pair once."""
    languages = sorted(set(langs.to_pylist()))
    of = pc.index_in(langs, value_set=pa.array(languages, langs.type)).to_numpy(zero_copy_only=False) if languages else np.zeros(0, dtype=np.int64)

    def table(row: np.ndarray, col: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.bincount(row * len(languages) + col, n, rows * len(languages)).reshape(rows, len(languages)) if rows else np.zeros((0, len(languages)))
        known = raw.sum(axis=1) >= LEAST
        return known, _logs(raw)[known]

    coded = words.dictionary_encode()
    known, scores = table(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), of, counts, len(coded.dictionary))
    grams = []
    for n in range(1, GRAM + 1):
        h, owner = gram_hashes(words, n)
        keys, row = np.unique(h, return_inverse=True)
        kept, logs = table(row, of[owner], counts[owner], len(keys))
        grams.append(Table(keys[kept], logs))
    return Model(languages, Table(coded.dictionary.filter(pa.array(known)), scores), grams)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / max(1, n))).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(1 << 30)) < share * (1 << 30))
    chosen = chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), NOT_LETTERS)).alias("word")).filter("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow().combine_chunks()
    column = lambda name, kind: pa.concat_arrays(counts.column(name).chunks).cast(kind) if counts.num_rows else pa.array([], kind)
    return build(column("lang", pa.string()), column("word", pa.large_string()), column("n", pa.float64()).to_numpy())


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text, as two columns."""
    words, codes, ends = word_codes(pc.split_pattern_regex(pc.utf8_lower(large_texts(texts)), NOT_LETTERS))
    size = np.diff(ends, prepend=0)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    doc = np.repeat(np.arange(len(texts)), size)
    by_word = model.scores(words)
    total = np.stack([np.bincount(doc, by_word[codes, j], len(texts)) for j in range(len(model.languages))], axis=1)
    best = total.argmax(axis=1)
    loss = (total - total[np.arange(len(texts)), best][:, None]) / np.maximum(1, size)[:, None]
    score = np.where(size > 0, 1 / np.exp(loss).sum(axis=1), 0.0)
    return [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), size.tolist(), strict=True)], score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""

    def make() -> Callable:
        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            langs, score = predict(model, b.column(1))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

        return of

    schema = "doc_id bigint, lang_pred string, score double"
    return map_batches(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], schema, make)
