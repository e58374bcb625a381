"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.batches import map_batches

#: Pattern of a run of ASCII white space, as Java and Python regular expressions.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Rows of ids and hashes (about 60 bytes each as a hash table) that may be broadcast.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may name none: a temporary folder is made and kept in its settings. On a
    cluster driver and executors would not share such a folder, so that is an error.
    """
    key = "spark.checkpoint.dir"
    root = spark.sparkContext.getConf().get(key) or spark.sparkContext.getCheckpointDir() or spark.conf.get("quarry.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {key} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.scratch.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage, so that lost executors cost no rework.

    ``drop()`` deletes what this object wrote; call it once nothing reads the tables any more. What is
    not dropped goes when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{scratch_root(spark)}/quarry-{uuid.uuid4().hex}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        self._files = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._n = 0

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self._n += 1
        path = f"{self.base}/t{self._n}"
        df.write.option("compression", codec).parquet(path)
        if self._n == 1:
            self._files.deleteOnExit(self._path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self._files.delete(self._path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the white-space separated words of a text, A-Z lower-cased; null gives no words."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE_RUN), lambda w: w != "")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 5; 0 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fold_py(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once for a row.

    A plain column would be inlined where a later lambda uses it, and so be evaluated for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def long_array(values: Iterable[int]) -> Column:
    """A constant array of longs, which Catalyst folds into one literal before the query runs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def map_rows(
    df: DataFrame,
    columns: Sequence[str],
    schema: str,
    make: Callable[[], Callable[..., Iterator[tuple] | list[tuple]]],
    slice_rows: int = 512,
    slice_bytes: int = 2 << 20,
) -> DataFrame:
    """``map_batches`` for ``f(*columns_as_lists) -> rows``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def wrapped() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        f = make()

        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(f(*(part.column(i).to_pylist() for i in range(len(columns)))))
            cols = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, type=a.type) for c, a in zip(cols, arrow, strict=True)], schema=arrow)

        return of

    return map_batches(df, columns, schema, wrapped, slice_rows, slice_bytes)


def small_or_shuffled(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of keys, read from where it is kept, to be sent to all executors if it has at most
    ``most`` rows; a join with a longer one shuffles."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def hot_of(counts: DataFrame, key: str, total: int, parts: int = 200) -> list:
    """The keys of ``counts`` (key, n) that hold more than ``1/parts`` of ``total`` rows: fewer than
    ``parts`` by arithmetic."""
    return [r[0] for r in counts.filter(F.col("n") > total // parts).select(key).collect()]


def at_shards(
    rows: DataFrame, shard: Column, filters: DataFrame, use: Callable[[Column], Column], hot: list[int], salt: Column, out: str
) -> DataFrame:
    """``rows`` with ``out`` = ``use(words)`` of the row's shard, null where ``filters`` (shard, words) has none.

    The words of a shard are some 100 KB and never pass a shuffle beside rows: those of ``hot`` shards
    (fewer than 200) are broadcast, and their rows spread by ``salt`` where all others meet their
    shard's words.
    """
    is_hot = F.col("shard").isin(hot)
    first = F.broadcast(filters.filter(is_hot).select(F.col("shard").alias("_shard1"), F.col("words").alias("_words1")))
    rest = filters.filter(~is_hot).select(F.col("shard").cast("long").alias("_shard2"), F.col("words").alias("_words2"))
    found = lambda words: F.when(words.isNotNull(), use(words))
    one = rows.withColumn("_shard", shard.cast("long")).join(first, F.col("_shard") == F.col("_shard1"), "left")
    one = one.select(*rows.columns, F.when(F.col("_shard").isin(hot), -salt.cast("long")).otherwise(F.col("_shard")).alias("_shard"), found(F.col("_words1")).alias("_out1"))
    two = one.join(rest, F.col("_shard") == F.col("_shard2"), "left")
    return two.select(*rows.columns, F.coalesce("_out1", found(F.col("_words2"))).alias(out))


def salted_join(
    rows: DataFrame, values: DataFrame, key: str, row_salt: Column, counts: DataFrame, total: int, parts: int = 200
) -> DataFrame:
    """Left join of ``rows`` to ``values`` (one row a key) that no single key can overload.

    ``counts`` has (key, n). Keys that hold more than ``1/parts`` of all rows are fewer than ``parts``
    by arithmetic, whatever the data, so their values are broadcast; their rows get a salt as the
    second join key and so spread over all tasks. All other keys join by a plain shuffle.
    """
    limit = max(1, total // parts)
    hot = values.join(F.broadcast(counts.filter(F.col("n") > limit).select(key)), key)
    names = [c for c in values.columns if c != key]
    hot = F.broadcast(hot.select(F.col(key).alias("_hot_key"), F.struct(*names).alias("_hot")))
    left = rows.join(hot, rows[key].eqNullSafe(F.col("_hot_key")), "left")
    left = left.withColumn("_salt", F.when(F.col("_hot").isNotNull(), row_salt.cast("long")))
    cold = values.select(F.col(key).alias("_cold_key"), F.struct(*names).alias("_cold"))
    # always 0, but not a constant that the optimizer would take out of the join's keys
    cold = cold.withColumn("_cold_salt", F.pmod(F.xxhash64("_cold_key"), F.lit(1)).cast("long"))
    on = (F.col(key) == F.col("_cold_key")) & (F.coalesce(F.col("_salt"), F.lit(0)) == F.col("_cold_salt"))
    out = left.join(cold, on, "left")
    picked = [F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in names]
    return out.select(*rows.columns, *picked)
