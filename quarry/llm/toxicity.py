"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned, not shipped: words and word beginnings whose document frequency among toxic
training rows is far above that among the others. Features are lexicon densities (overall and in the
densest window), second-person words near lexicon words, capitals, punctuation and obfuscation rates.

Learning reads at most about ``SAMPLE`` labelled ids of each class, chosen by a hash of the id so that
the share kept depends only on how many there are. Rows whose id falls in the held-out fold are never
read. Lexicon counts are Spark aggregates; the driver gets the lexicon and one feature row for each
sampled id, both bounded by the sample. Scoring is one pass without a shuffle; what depends on a word
alone is computed once for each distinct word of a slice.

Defined results: null and empty texts get features of zero and so a score like any other; repeated
rows score alike; without toxic labels every score is the same and below 0.5, without others it is the
smoothed base rate; where too few rows are left to calibrate on, scores are the trees' own probabilities;
labels repeated or in conflict for an id count as toxic if any says so; null labels are ignored; of texts
that share a labelled id the smallest is learned from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.batches import large_texts, map_batches, word_codes
from quarry.llm import gbt
from quarry.llm.common import Scratch, fold

#: Ids of each class that fitting reads at most, in expectation.
SAMPLE = 4000
#: A stem enters the lexicon at this many toxic documents, this log-odds, and this log-odds times the
#: root of the documents, which chance does not reach in small samples.
LEAST_DOCS = 4
LEAST_ODDS = 2.0
LEAST_WEIGHT = 7.0
#: The lexicon is learned from all but one of so many parts of the sample.
FOLDS = 5
STEMS = (4, 5, 6, 7)
WINDOW = 40

#: Second-person words of the corpus languages, and look-alike characters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre ti tus usted vosotros".split())
LOOKALIKE = str.maketrans("013457@$!|+", "oieastasiit")
STRETCHED = re.compile(r"([^\W_])\1{2,}")
EDGE = "\"'.,;:!?()[]{}<>*_~#%&$-"


class Lexicon:
    """Words, and beginnings of longer words. Nearly all words are ruled out by their first letters."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]) -> None:
        self.words, self.stems = words, stems
        self.heads = frozenset(w[: STEMS[0]] for w in (*words, *stems))

    def has(self, word: str) -> bool:
        if word[: STEMS[0]] not in self.heads:
            return False
        return word in self.words or any(word[:n] in self.stems for n in STEMS if len(word) > n)


def _plain(raw: str) -> str:
    """A word freed of look-alike characters, inner punctuation and stretched letters."""
    inner = raw.lower().translate(LOOKALIKE)
    return STRETCHED.sub(r"\1", "".join(c for c in inner if c.isalpha()))


FEATURES = (
    "log_words", "log_hits", "hit_rate", "distinct_hits", "window_hits", "near_second", "second_rate", "hidden_hits", "hidden_rate",
    "capital_rate", "shouted_rate", "shouted_hits", "exclaim_rate", "question_rate", "punct_rate", "mixed_rate", "stretched_rate",
)
#: What is known of a word alone, as bits.
HIT, VEILED, SECOND, LOUD, MIXED, LONG = (1 << i for i in range(6))


def _known(raw: str, lexicon: Lexicon) -> tuple[int, str]:
    """(bits, the form that is in the lexicon) of a word, ``LONG`` aside."""
    simple = raw.isalpha()
    bare = raw.lower() if simple else raw.strip(EDGE).lower()
    flags, form = SECOND * (bare in SECOND_PERSON), ""
    if lexicon.has(bare):
        flags, form = flags | HIT, bare
    elif not simple and not bare.isalpha():
        plain = _plain(raw.strip(".,;:!?\"'()"))
        if len(plain) > 2 and plain != bare and lexicon.has(plain):
            flags, form = flags | HIT | VEILED, plain
    if not simple and any(map(str.isdigit, bare)) and any(map(str.isalpha, bare)):
        flags |= MIXED
    if not raw.islower() and not raw[1:].islower():  # else at most the first letter is a capital
        up = sum(map(str.isupper, raw))
        flags |= LOUD * (up > 1 and up >= 0.7 * len(bare or "x"))
    return flags, form


def _stretched(names: list[str]) -> np.ndarray:
    """Which words have a letter or digit three times in a row, in one search over all."""
    joined = "\n".join(names)
    low = joined.lower()
    if len(low) != len(joined):  # a letter that becomes two
        return np.array([bool(STRETCHED.search(w.lower())) for w in names], dtype=bool)
    ends = np.cumsum([len(w) + 1 for w in names])
    out = np.zeros(len(names), dtype=bool)
    out[np.searchsorted(ends, [m.start() for m in STRETCHED.finditer(low)], side="right")] = True
    return out


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """The dense features of whole texts, a row each."""
    whole = large_texts(texts)
    words, codes, ends = word_codes(pc.utf8_split_whitespace(whole))
    n_docs, names = len(texts), words.to_pylist()
    known = [_known(w, lexicon) for w in names]
    about = np.array([k for k, _ in known], dtype=np.int64) | LONG * _stretched(names)
    forms_of = np.array([zlib.crc32(f.encode("utf-8", "replace")) if f else 0 for _, f in known], dtype=np.int64)
    size = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(n_docs), size)
    flags = about[codes]

    def total(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(whole, pattern).to_numpy(zero_copy_only=False)

    def count(flag: int) -> np.ndarray:
        return np.bincount(doc[(flags & flag) == flag], minlength=n_docs)

    # places such that those of different texts are far apart
    place = np.arange(len(codes)) + doc * (2 * WINDOW)
    at = np.flatnonzero(flags & HIT)
    of, spot, you = doc[at], place[at], place[np.flatnonzero(flags & SECOND)]
    hits = np.bincount(of, minlength=n_docs)
    dense, near, forms = np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs)
    if len(at):
        np.maximum.at(dense, of, np.searchsorted(spot, spot + WINDOW) - np.arange(len(spot)))
        forms = np.bincount(np.unique((of << 32) | forms_of[codes[at]]) >> 32, minlength=n_docs)
        if len(you):
            i = np.searchsorted(you, spot)
            gap = np.minimum(abs(spot - you[np.maximum(i - 1, 0)]), abs(spot - you[np.minimum(i, len(you) - 1)]))
            near = np.bincount(of[gap <= 4], minlength=n_docs)
    n = np.maximum(1, size)
    chars = np.maximum(1, pc.utf8_length(whole).to_numpy(zero_copy_only=False))
    hidden, shouted = count(VEILED), count(LOUD)
    return np.stack(
        [
            np.log1p(size), np.log1p(hits), hits / n, forms, dense, near, count(SECOND) / n, hidden, hidden / n,
            total(r"\p{Lu}") / chars, shouted / n, count(HIT | LOUD), total("!") / n, total(r"\?") / n,
            total(r"[*#$%&@~^]") / chars, count(MIXED) / n, count(LONG) / n,
        ],
        axis=1,
    ).astype(np.float64)


#: The trees' own probabilities, where there is too little to calibrate on.
LOGISTIC = gbt.Isotonic(np.linspace(-12, 12, 97), 1 / (1 + np.exp(-np.linspace(-12, 12, 97))))


@dataclass(frozen=True)
class Scorer:
    lexicon: Lexicon
    model: gbt.Model
    scale: gbt.Isotonic

    def of(self, texts: pa.Array) -> np.ndarray:
        return self.scores(features(texts, self.lexicon))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw probability keeps the order within flat steps."""
        margin = self.model.margin(x)
        raw = 1 / (1 + np.exp(-margin))
        flat = self.scale(margin)
        mixed = 0.999 * flat + 0.001 * raw
        return np.clip(np.where((flat >= 0.5) == (mixed >= 0.5), mixed, flat), 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, text, y) of about ``sample`` ids a class, outside the held-out fold, one row an id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")).filter(F.col("y").isin(0, 1))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """The words and stems that mark label 1, counted over all ``rows``; the sample bounds how many."""
    bare = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)
    keys = F.array_distinct(
        F.flatten(
            F.transform(
                F.array_distinct(bare),
                lambda w: F.array(F.concat(F.lit("="), w), *[F.concat(F.lit("<"), F.when(F.length(w) > n, F.left(w, F.lit(n)))) for n in STEMS]),
            )
        )
    )
    sums = rows.agg(F.sum("y"), F.count("*")).first()
    toxic, n = sums[0] or 0, sums[1]
    counts = rows.select("y", F.explode(keys).alias("stem")).filter("stem is not null")
    counts = counts.groupBy("stem").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).filter(F.col("p") >= LEAST_DOCS)
    odds = F.log((F.col("p") + 0.25) / (toxic + 0.5)) - F.log((F.col("q") + 0.25) / (n - toxic + 0.5))
    weighed = counts.withColumn("odds", odds).withColumn("weight", F.col("odds") * F.sqrt("p"))
    strong = weighed.filter((F.col("odds") >= LEAST_ODDS) & (F.col("weight") >= LEAST_WEIGHT))
    stems = [r["stem"] for r in strong.select("stem").collect()]
    return Lexicon(frozenset(s[1:] for s in stems if s[0] == "="), frozenset(s[1:] for s in stems if s[0] == "<"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, scratch: Scratch | None = None) -> Scorer:
    """Fit lexicon, trees and calibration.

    Lexicon and calibration must not see the same rows, or learned words look better than they are: two
    thirds of the rows give the lexicon that serves, the others its check, on which trees are calibrated.
    """
    rows = (scratch or Scratch(docs.sparkSession)).keep(training_rows(docs, labels, label, sample))
    part = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(FOLDS))
    lexicon = learn_lexicon(rows.filter(part != 0))

    def make() -> Callable:
        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            x = features(b.column("text"), lexicon)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64())), b.column("y")], names=["doc_id", "x", "y"])

        return of

    table = map_batches(rows, ["doc_id", "text", "y"], "doc_id bigint, x array<double>, y int", make)
    got = sorted((r["doc_id"], r["p"] == 0, r["x"], r["y"]) for r in table.withColumn("p", part).collect())  # an id once: about 2 * sample
    x = np.array([r[2] for r in got]).reshape(-1, len(FEATURES))
    y = np.array([r[3] for r in got], dtype=float)
    unseen = np.array([r[1] for r in got], dtype=bool)
    # rows that the lexicon was not learned from: half to fit trees with the rest, half to calibrate
    held = unseen & (np.arange(len(y)) % 2 == 0)
    fit_on = ~held & (unseen | (np.arange(len(y)) % 2 == 0))
    if not y.sum():  # nothing speaks for toxicity
        p = 0.5 / (len(y) + 2)
        return Scorer(lexicon, gbt.Model(float(np.log(p / (1 - p))), ()), LOGISTIC)
    model = gbt.fit(x[fit_on], y[fit_on])
    known = len(set(y[held].tolist())) == 2  # one class alone does not calibrate
    return Scorer(lexicon, model, gbt.fit_isotonic(model.margin(x[held]), y[held]) if known else LOGISTIC)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) for every row of ``docs``, in one pass."""

    def make() -> Callable:
        def of(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.of(b.column(1)))], names=["doc_id", "score"])

        return of

    return map_batches(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], "doc_id bigint, score double", make)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` whose calibrated score is below ``threshold``, columns unchanged."""
    scorer = train(docs, labels, scratch=scratch)

    def make() -> Callable:
        return lambda b: b.filter(pa.array(scorer.of(b.column("text")) < threshold))

    return map_batches(docs, docs.columns, docs.schema, make)
