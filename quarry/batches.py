"""Arrow batches in Python workers: slices, words as codes, memory given back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Arrow batches end at ``size`` where the session leaves Spark's 64 MB, which JVM and Python hold
    several times over in each task. A session that sets a bound of its own keeps it."""
    if spark.conf.get(BATCH_BYTES, "67108864b") in ("67108864b", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, size)


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and ``size`` bytes of strings; a longer row is a part of its own."""
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(total), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, side="right")) - at))
        yield batch.slice(at, n)
        at += n


def give_back() -> None:
    """Return freed memory to the system; Python workers outlive their tasks and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def map_batches(
    df: DataFrame,
    columns: Sequence[str],
    schema: str | StructType,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    slice_rows: int = 512,
    slice_bytes: int = 2 << 20,
) -> DataFrame:
    """Apply a function of Arrow batches to slices of rows.

    ``make()`` runs once in each task. Slices bound what one call holds, so that memory follows neither
    the partition nor the batch; when a task ends, its worker gives back what it took.
    """

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        try:
            for batch in batches:
                for part in slices(batch, slice_rows, slice_bytes):
                    out = f(part)
                    if out.num_rows:
                        yield out
        finally:
            del f
            give_back()

    return df.select(*columns).mapInArrow(run, schema)


def word_codes(split: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each occurrence's word, ends of texts among the occurrences) of
    texts split into words; empty words do not count.

    Work on words is then work on distinct words, and occurrences are taken from its results.
    """
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(split).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        full = codes != empty
        ends = np.append(0, np.cumsum(full))[ends]
        codes = codes[full]
    return coded.dictionary, codes, ends


def large_texts(column: pa.Array) -> pa.Array:
    """A column of strings without nulls whose offsets do not overflow."""
    return pc.fill_null(column.cast(pa.large_string()), "")
