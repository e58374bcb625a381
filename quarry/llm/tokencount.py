"""Token counts of a byte-level BPE, huge texts by overlapping chunks that resynchronise.

A text of ordinary length is cut where white space follows another character, which is always a boundary,
and distinct parts are encoded once (``Parts``). A huge one is cut into chunks of ``CHUNK`` characters that run
``OVERLAP`` characters into the next; chunks are spread over tasks and encoded with offsets. Two
neighbours are spliced at the first boundary that both have, with the same token before it, and that is
proven to be one of the whole text (``stable``). The count of the text is then the sum, over neighbours, of
the tokens that the left one has before the splice less those that the right one has, and the tokens
of the last chunk. Where two neighbours have no such boundary, the text is cut anew with chunks and
overlaps twice as long, until it fits in one.

Why a boundary holds. The tokenizer first cuts a text into pieces (a word with the space before it, a run
of digits, of other signs, of white space, an English contraction), then merges within pieces.

* No piece goes on from a sign, digit or letter into another class or into white space, so such a place is
  a boundary whatever stands around it; only an apostrophe before a letter may be a contraction.
* Within a piece, tokens are right if every two neighbours are what the merges make of the two alone
  (the first merge across a boundary would be one of theirs). Two chunks that share a token, within a run of
  one class that began three characters before the right chunk, agree on the piece, and every two
  neighbours of the splice are neighbours in one of the chunks.

Classes are told for characters whose class no version of Unicode has changed; others give no boundary, and
cost wider overlaps at most. A special string, such as the end of text, is one token as the library has it:
the left chunk holds every special string that begins before a splice, so no splice falls into one.

Defined results: a null text is empty, with no byte and no token. Repeated rows are counted each; copies of a
huge text have one key, and are put together before they are joined. Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.batches import large_texts, map_batches
from quarry.llm.common import BROADCAST_ROWS, Scratch, map_rows, salted_join, small_or_shuffled

CHUNK, OVERLAP = 32_768, 512
#: Bytes of parts that a worker remembers, and parts that are encoded at once.
CACHE_BYTES, LEARN = 24 << 20, 1 << 13
#: Characters that a rule looks at on either side of a boundary.
BEFORE, AFTER = 3, 2
LETTER, DIGIT, SIGN, SPACE = 1, 2, 3, 4
#: Ranges of characters, each of one class.
RANGES = [
    (LETTER, [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3C9), (0x400, 0x481), (0x48A, 0x4FF)]),
    (LETTER, [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]),
    (DIGIT, [(0x30, 0x39)]),
    (SIGN, [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0xAB, 0xAB), (0xBB, 0xBB), (0x2010, 0x2027), (0x3001, 0x3003), (0x3008, 0x3011), (0xFF01, 0xFF0F)]),
    (SPACE, [(0x09, 0x0D), (0x20, 0x20)]),
]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x10000, dtype=np.int8)
    for kind, ranges in RANGES:
        for first, last in ranges:
            table[first : last + 1] = kind
    return table


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 0x10000, _classes()[np.minimum(codes, 0xFFFF)], 0)


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> tuple:
    """The tokenizer and the length of its longest special string; a worker loads it once."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(path)
    said = json.loads(found.to_str())
    cut, model, special = said["pre_tokenizer"] or {}, said["model"], said["added_tokens"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not said["normalizer"]
    merged = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    if not (plain and merged) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
        raise ValueError("splices are proven for byte-level BPE without normalization only")
    found.no_truncation()
    found.no_padding()
    return found, max([len(t["content"]) for t in special], default=0)


def margin(path: str) -> int:
    """Characters that a chunk has beyond its overlap: a special string, and what a rule looks at."""
    return _tokenizer(path)[1] + AFTER


def stable(text: str, start: int, overlap: int) -> np.ndarray:
    """Whether a boundary at each of ``start`` to ``start + overlap`` is proven (the first never is)."""
    kind = classes_of(text[start - BEFORE : start + overlap + AFTER])
    here = np.arange(BEFORE, BEFORE + overlap + 1)
    left, right = kind[here - 1], kind[here]
    apostrophe = np.array([c == "'" for c in text[start - 1 : start + overlap]])
    between = (left > 0) & (left != SPACE) & (right > 0) & (left != right) & ~(apostrophe & (right == LETTER))
    # one class from BEFORE characters before the start up to AFTER characters after the boundary
    same = np.logical_and.accumulate((kind == kind[0]) & (kind[0] > 0))
    out = between | same[here + AFTER - 1]
    out[0] = False
    return out


def shared_boundaries(spans: list[tuple[int, int]], start: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries p in (start, start + overlap] whose token begins at s >= start, as numbers that a left
    and a right chunk have in common ((p - start) * (overlap + 1) + s - start), and the tokens before."""
    if not spans:
        return [], []
    first, last = np.array(spans, dtype=np.int64).T
    whole = np.append(first[1:] >= last[:-1], True)  # characters of several tokens are no place to cut
    starts_whole = np.append(True, whole[:-1])
    good = np.flatnonzero(whole & starts_whole & (first >= start) & (last > first) & (last <= start + overlap))
    return ((last[good] - start) * (overlap + 1) + first[good] - start).tolist(), (good + 1).tolist()


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def part_starts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where ASCII white space follows a printable ASCII character or one of two bytes
    from U+00C0 on: no piece of the tokenizer and no special string goes on over such a place."""
    before = np.zeros(len(data), dtype=bool)
    before[1:] = (data[:-1] > 32) & (data[:-1] < 127)
    before[2:] |= (data[1:-1] >= 128) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    return np.flatnonzero(_WHITE[data] & before)


class Parts:
    """Token counts of the parts of texts between white space; those seen are remembered as Arrow columns."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)[0]
        self.forget()

    def forget(self) -> None:
        self.names, self.counts = pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text; ``texts`` are large strings without nulls."""
        if not len(texts):
            return np.zeros(0, dtype=np.int64)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        cuts = np.unique(np.concatenate([part_starts(data), ends]))
        parts = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.names)
        new = coded.dictionary.filter(pc.is_null(at))
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[pc.is_null(at).to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(len(new))
        made = [len(e.ids) for first in range(0, len(new), LEARN) for e in self.tokenizer.encode_batch_fast(new[first : first + LEARN].to_pylist(), add_special_tokens=False)]
        self.names, self.counts = pa.concat_arrays([self.names, new]), np.append(self.counts, np.array(made, dtype=np.int64))
        each = self.counts[place[coded.indices.to_numpy(zero_copy_only=False)]]
        if self.names.nbytes > CACHE_BYTES:
            self.forget()
        sums = np.append(0, np.cumsum(each))
        return np.diff(sums[np.searchsorted(cuts, ends)])


@lru_cache(maxsize=1)
def _worker_parts(path: str) -> Parts:
    """The parts that this worker knows, from task to task."""
    return Parts(path)


def text_key(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def chunks(huge: DataFrame, chunk: int, overlap: int, beyond: int) -> DataFrame:
    """(key, no, last, text) of every chunk of the texts of ``huge``."""

    def make() -> Callable[[list], Iterator[tuple]]:
        def rows(texts: list) -> Iterator[tuple]:
            for text in texts:
                key = text_key(text)
                n = max(1, -(-(len(text) - overlap - beyond) // chunk))
                for no in range(n):
                    yield key, no, no == n - 1, text[no * chunk :] if no == n - 1 else text[no * chunk : (no + 1) * chunk + overlap + beyond]

        return rows

    return map_rows(huge, ["text"], "key string, no int, last boolean, text string", make, slice_rows=1)


EDGE = "key string, edge int, total bigint, tail array<bigint>, tail_n array<int>, head array<bigint>, head_n array<int>"


def edges(parts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``EDGE``: what a chunk says of its end (edge ``no``) and of its begin (edge ``no`` - 1); the tokens of a
    last chunk are the total of edge -1."""

    def make() -> Callable[..., Iterator[tuple]]:
        tokenizer = _tokenizer(path)[0]

        def rows(keys: list, nos: list, lasts: list, texts: list) -> Iterator[tuple]:
            for key, no, last, text in zip(keys, nos, lasts, texts, strict=True):
                spans = tokenizer.encode(text, add_special_tokens=False).offsets
                if no:
                    yield key, no - 1, None, None, None, *shared_boundaries(spans, 0, overlap)
                if last:
                    yield key, -1, len(spans), None, None, None, None
                else:
                    proven = stable(text, chunk, overlap)
                    found = [(b, n) for b, n in zip(*shared_boundaries(spans, chunk, overlap), strict=True) if proven[b // (overlap + 1)]]
                    yield key, no, None, [b for b, _ in found], [n for _, n in found], None, None

        return rows

    return map_rows(parts, ["key", "no", "last", "text"], EDGE, make, slice_rows=8)


def spliced(said: DataFrame) -> DataFrame:
    """(key, n_tokens) of each huge text; null where two neighbours share no proven boundary."""
    some = lambda c: F.first(c, ignorenulls=True).alias(c)  # noqa: E731  copies of a text say the same
    both = said.groupBy("key", "edge").agg(*[some(c) for c in ("total", "tail", "tail_n", "head", "head_n")])
    common = F.array_min(F.array_intersect("tail", "head"))
    at = lambda side: F.element_at(f"{side}_n", F.array_position(side, F.col("common")).cast("int")).cast("long")
    share = F.when(F.col("edge") < 0, F.col("total")).otherwise(at("tail") - at("head"))
    cut = both.withColumn("common", common).select("key", F.when((F.col("edge") < 0) | F.col("common").isNotNull(), share).alias("share"))
    return cut.groupBy("key").agg(F.when(F.count_if(F.col("share").isNull()) == 0, F.sum("share")).alias("n_tokens"))


def huge_counts(huge: DataFrame, path: str, scratch: Scratch, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of the distinct texts of ``huge``, with wider overlaps for those that need them."""
    done, beyond = None, margin(path)
    keyed = huge.select("text", F.sha2("text", 256).alias("key"))
    todo = keyed
    while True:
        parts = chunks(todo, chunk, overlap, beyond)
        # a huge text's chunks go to many tasks, and so do the chunks of its copies
        spread = parts.repartition(F.xxhash64("key", "no", F.monotonically_increasing_id()))
        found = scratch.keep(spliced(edges(spread, path, chunk, overlap)))
        right, open_keys = found.filter("n_tokens is not null"), found.filter("n_tokens is null").select("key")
        done = right if done is None else done.unionByName(right)
        if open_keys.isEmpty():
            return done
        todo = keyed.join(small_or_shuffled(open_keys), "key", "left_semi")
        chunk, overlap = 2 * chunk, 2 * overlap


def count(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs`` (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_huge = F.length("text") > chunk + overlap + margin(path)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        parts = _worker_parts(path)

        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = large_texts(part.column(1))
            return pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(parts.count(texts))], names=["doc_id", "n_bytes", "n_tokens"])

        return of

    kind = rows.schema["doc_id"].dataType.simpleString()
    short = map_batches(rows.filter(~is_huge), ["doc_id", "text"], f"doc_id {kind}, n_bytes bigint, n_tokens bigint", make, slice_bytes=4 << 20)
    huge = rows.filter(is_huge)
    counted = huge_counts(huge, path, scratch, chunk, overlap)
    named = huge.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("key"))
    if counted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = named.join(F.broadcast(counted), "key")
    else:
        named = scratch.keep(named)
        copies = named.groupBy("key").agg(F.count("*").alias("n"))
        joined = salted_join(named, counted, "key", F.xxhash64("doc_id") % 1024, copies, named.count())
    return short.unionByName(joined.select("doc_id", "n_bytes", "n_tokens"))
