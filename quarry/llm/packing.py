"""Best-fit sequence packing by bin completion with branch and bound.

Piece lengths are integers from 1 to the capacity, so a whole corpus is a histogram of at most
``capacity`` counts. The driver packs the histogram (see ``quarry.llm.bins``); each filling serves as many
sequences as its lengths allow, so the plan has a few thousand runs, whatever the number of documents.

Executors then place pieces: rank among pieces of the same length = rank within the tokenising task +
an offset by (task, length); the rank falls into one run of the plan. No task ever holds all pieces
of a length.

Defined results: null and empty texts are one piece of the end id; repeated rows are packed as rows of
their own; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import bins
from quarry.llm.common import Scratch, map_rows

CAPACITY = 2048
END_ID = 0
#: Bytes of words and ids that a worker remembers, from task to task, and words that are encoded at once.
CACHE_BYTES = 32 << 20
LEARN = 1 << 14
assert sys.byteorder == "little" and array("I").itemsize == 4, "ids are stored as little-endian 32-bit numbers"
#: Rows of the (task, length) offsets that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Characters that normalization may change otherwise than letter by letter.
BEYOND = re.compile("[\u0130\u0250-\U0010ffff]")
#: A control character between words that are encoded together.
MARK = "\x01"

#: (length, first rank, pieces, pieces a sequence, first sequence, offset of the first piece)
Run = tuple[int, int, int, int, int, int]


def runs_of(plan: list[tuple[bins.Items, int]]) -> list[Run]:
    """The plan as runs of ranks, lengths descending within a sequence."""
    given: dict[int, int] = defaultdict(int)
    out: list[Run] = []
    sequence = 0
    for items, times in plan:
        at = 0
        for k, c in sorted(items, reverse=True):
            out.append((k, given[k], c * times, c, sequence, at))
            given[k] += c * times
            at += c * k
        sequence += times
    return out


# --- tokenising and placing -----------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tokenizers(path: str) -> tuple:
    """The tokenizer, the same without normalization, and the id of ``MARK``; a worker loads them once."""
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    lean = Tokenizer.from_str(json.dumps(json.loads(full.to_str()) | {"normalizer": None, "added_tokens": []}))
    (mark,) = full.encode(MARK, add_special_tokens=False).ids
    return full, lean, mark


class Words:
    """Token ids of white-space separated words; those seen are remembered as two Arrow columns.

    The tokenizer breaks at white space, so a word's ids do not depend on its neighbours. Unseen words
    are encoded many at a time with a mark between them, a control character that is a token of its own,
    and cut at the mark. Words that the tokenizer's normalization leaves alone skip it.
    """

    def __init__(self, path: str) -> None:
        self.full, self.lean, self.mark = _tokenizers(path)
        self.forget()

    def forget(self) -> None:
        self.names = pa.array([""], pa.large_string())
        self.ids = pa.array([b""], pa.large_binary())

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of words, some thousands at a time: encodings take much more room than ids."""
        made: dict[str, bytes] = {}
        for at in range(0, len(words), LEARN):
            self._learn(words[at : at + LEARN], made)
        return [made[w] for w in words]

    def _learn(self, words: list[str], made: dict[str, bytes]) -> None:
        every = "".join(words)
        if MARK in every:
            self._single([w for w in words if MARK in w], made)
            words = [w for w in words if MARK not in w]
        if _plain(every):
            self._marked(self.lean, words, made)
        else:
            self._marked(self.lean, [w for w in words if _plain(w)], made)
            self._marked(self.full, [w for w in words if not _plain(w)], made)

    def _single(self, words: list[str], made: dict[str, bytes]) -> None:
        for word, e in zip(words, self.full.encode_batch_fast(words, add_special_tokens=False), strict=True):
            made[word] = array("I", e.ids).tobytes()

    def _marked(self, tokenizer: object, words: list[str], made: dict[str, bytes]) -> None:
        groups = [words[i : i + 512] for i in range(0, len(words), 512)]
        joint = f" {MARK} "
        for group, e in zip(groups, tokenizer.encode_batch_fast([joint.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cuts = (np.flatnonzero(ids == self.mark) * 4).tolist()
            if len(cuts) != len(group) - 1:  # cannot be, as no word has the mark
                self._single(group, made)
                continue
            whole = ids.tobytes()
            ends = [*cuts, len(whole)]
            made.update(zip(group, [whole[i:j] for i, j in zip([0, *[c + 4 for c in cuts]], ends, strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers.

        Arrow cuts texts into words, looks the distinct ones up and lays out the ids of all occurrences in
        one buffer; Python handles words that are new only.
        """
        odd = [bool(t) and not _splits_alike(t) for t in texts]
        split = pc.utf8_split_whitespace(pa.array([_lowered(t) if t and not o else "" for t, o in zip(texts, odd, strict=True)], pa.large_string()))
        words = pc.list_flatten(split).dictionary_encode()
        at = pc.index_in(words.dictionary, value_set=self.names)
        new = words.dictionary.filter(pc.is_null(at))
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[pc.is_null(at).to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, pa.array(self.learn(new.to_pylist()), pa.large_binary())])
        laid = ids.take(pa.array(place[words.indices.to_numpy(zero_copy_only=False)]))
        self.names, self.ids = pa.concat_arrays([self.names, new]), ids
        if self.names.nbytes + self.ids.nbytes > CACHE_BYTES:
            self.forget()
        ends = np.append(0, np.cumsum(pc.binary_length(laid).to_numpy())) if len(laid) else np.zeros(1, dtype=np.int64)
        at = ends[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))].tolist()
        buffer = memoryview(laid.buffers()[2] or b"")
        for k, (text, o) in enumerate(zip(texts, odd, strict=True)):
            yield array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes() if o else bytes(buffer[at[k] : at[k + 1]])


@lru_cache(maxsize=1)
def _worker_words(path: str) -> Words:
    """The words that this worker knows, from task to task."""
    return Words(path)


def _plain(text: str) -> bool:
    """Whether normalization would change nothing: Latin letters to U+024F in lower case, and no
    special token."""
    return (text.isascii() or not BEYOND.search(text)) and "<|" not in text and text == text.lower()


def _lowered(text: str) -> str:
    """The text in lower case where that goes letter by letter, or as it is."""
    return text.lower() if (text.isascii() or not BEYOND.search(text)) and "<|" not in text else text


def _splits_alike(text: str) -> bool:
    """Whether Arrow breaks the text where the tokenizer does: it takes four controls for white space."""
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


def _tokenise(path: str, capacity: int) -> Callable:
    def make() -> Callable:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _worker_words(path)
        ranks: dict[int, int] = defaultdict(int)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        end = array("I", [END_ID]).tobytes()

        def rows(docs: list, texts: list) -> Iterator[tuple]:
            for doc, ids in zip(docs, words.encode(texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    yield part, doc, piece, at // 4, n, ranks[n], cut
                    ranks[n] += 1

        return rows

    return make


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(part, doc_id, piece, start, length, rank, ids) of every row; ids are little-endian 32-bit.

    ``rank`` counts the pieces of a length within the task ``part``: write the table before use, so
    that both stay what they are.
    """
    schema = "part int, doc_id bigint, piece int, start bigint, length bigint, rank bigint, ids binary"
    return map_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], schema, _tokenise(tokenizer_path, capacity), slice_rows=1024, slice_bytes=4 << 20)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, steps: int = bins.STEPS, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset, sequences, least_sequences) of every piece.

    The last two are the same in all rows: how many sequences there are, and how many there must be in
    any packing. They are equal unless the search ended after ``steps`` steps.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    table = scratch.keep(pieces(docs, tokenizer_path, capacity), codec="snappy")
    sizes = scratch.keep(table.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    packed = bins.pack(counts, capacity, steps)
    runs = runs_of(packed.bins)
    plan = spark.createDataFrame(runs, "run_length bigint, first bigint, n bigint, per bigint, sequence bigint, at bigint")
    offsets = sizes.selectExpr(
        "part",
        "length",
        "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as before",
    )
    if sizes.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = table.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    inside = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    place = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(plan), inside).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("sequence") + F.floor(place / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("per")) * F.col("length")).cast("long").alias("offset"),
        F.lit(packed.size).cast("long").alias("sequences"),
        F.lit(packed.bound).cast("long").alias("least_sequences"),
    )
