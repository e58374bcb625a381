"""Structured Streaming: incremental ingest, attribution, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quarry.session import kept
from quarry.sources import growing, transcripts


def numbered(batch: DataFrame, known: DataFrame) -> DataFrame:
    """(path, line_no, fresh, value) of lines by range: numbers go on from ``known`` (path, lines) where a file
    goes on, and over the ranges of a file by how many lines each has."""
    counts = batch.groupBy("path", "fresh", "first").agg((F.max("n") + 1).alias("lines"))
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    # a row a range, so a file's rows here are few
    base = counts.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))).join(known.withColumnRenamed("lines", "read"), "path", "left")
    base = base.select("path", "first", (F.col("before") + F.when(F.col("fresh"), 0).otherwise(F.coalesce("read", F.lit(0)))).alias("base"))
    return batch.join(base, ["path", "first"]).select("path", (F.col("base") + F.col("n")).cast("int").alias("line_no"), "fresh", "value")


TURN_KEY = ["session_id", "line_no", "block_no"]
BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _line_counts(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """(path, lines) as of the last batch before ``batch_id``."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "path string, lines bigint")
    every = spark.read.schema("path string, lines bigint, batch bigint").parquet(folder)
    last = every.filter(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]
    return every.filter(F.col("batch") == F.lit(-1 if last is None else last)).select("path", "lines")


def ingest_stream(spark: SparkSession, source: str, out: str, checkpoint: str, range_bytes: int = growing.RANGE_BYTES) -> DataStreamWriter:
    """What transcripts have gained, into the table of turns at ``out`` (by ``bucket`` of the session).

    The checkpoint has the cursor: bytes of each file, and its lines by batch. A batch that is delivered
    again, also by another checkpoint, finds its keys present and adds nothing; for that, keys of the
    batch's buckets are read. A file that was written anew replaces its session's rows: the buckets of such
    sessions are written again. ``stored_turns`` reads the table with ``idx``, as of the whole session.
    """
    growing.register(spark)
    files = spark.readStream.format("growing_lines").option("path", source).option("rangeBytes", range_bytes).load()
    counts_at = f"{checkpoint.rstrip('/')}/line_counts"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = _line_counts(session, counts_at, batch_id)
        lines = kept(numbered(batch, known))
        now = lines.groupBy("path").agg((F.max("line_no") + 1).cast("long").alias("lines"))
        kept(now.unionByName(known.join(now, "path", "left_anti"))).coalesce(1).write.mode("overwrite").parquet(f"{counts_at}/batch={batch_id}")
        parsed = transcripts.parse_lines(lines.filter(F.trim("value") != ""))
        bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        new = transcripts.turns(transcripts.blocks(parsed)).drop("idx").select("*", bucket)
        if not _exists(session, out):
            new.write.partitionBy("bucket").parquet(out)
            return
        named = lines.select(transcripts.session_of(F.col("path")).alias("session_id"), "fresh").distinct().select("*", bucket)
        used = [r["bucket"] for r in named.select("bucket").distinct().collect()]  # at most BUCKETS
        old = session.read.schema(new.schema).parquet(out).filter(F.col("bucket").isin(used))
        again = kept(old.join(named.filter("fresh").select("session_id"), "session_id", "left_semi").select(*TURN_KEY, F.xxhash64("role", "content").alias("h"), "bucket"))
        # a session that is read from its begin is replaced if it differs from what is there
        fresh = new.join(named.filter("fresh").select("session_id"), "session_id", "left_semi").select(*TURN_KEY, F.xxhash64("role", "content").alias("h"), "bucket")
        changed = kept(again.exceptAll(fresh).select("session_id", "bucket").distinct())
        if changed.isEmpty():
            new.join(old.select(*TURN_KEY), TURN_KEY, "left_anti").write.mode("append").partitionBy("bucket").parquet(out)
            return
        touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]
        stay = old.join(changed.select("session_id"), "session_id", "left_anti")
        added = new.join(stay.select(*TURN_KEY), TURN_KEY, "left_anti")
        whole = kept(stay.filter(F.col("bucket").isin(touched)).unionByName(added.filter(F.col("bucket").isin(touched))))
        rest = kept(added.filter(~F.col("bucket").isin(touched)))
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)
        rest.write.mode("append").partitionBy("bucket").parquet(out)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stored_turns(spark: SparkSession, out: str) -> DataFrame:
    """The turns that ``ingest_stream`` has stored, with ``idx`` over each session."""
    order = Window.partitionBy("session_id").orderBy("line_no", "block_no")
    return spark.read.parquet(out).drop("bucket").withColumn("idx", F.row_number().over(order) - 1)


def attribute(shown: DataFrame, used: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """(key, used_ts, shown_ts): each use with the newest showing of at most ``seconds`` before it.

    ``shown`` and ``used`` have (key, ts). A range of an equi-join, in batch or between two streams with
    watermarks on their ``ts``; on streams a use is given out once the watermark has passed it.
    """
    a = shown.select(F.col(key).alias("_k"), F.col("ts").alias("shown_ts"))
    b = used.select(F.col(key), F.col("ts").alias("used_ts"))
    near = (F.col(key) == F.col("_k")) & (F.col("used_ts") >= F.col("shown_ts")) & (F.col("used_ts") <= F.col("shown_ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    joined = b.join(a, near).drop("_k")
    return joined.groupBy(key, "used_ts").agg(F.max("shown_ts").alias("shown_ts"))


def tumbling(events: DataFrame, width: str, *by: str, late: str | None = None) -> DataFrame:
    """Counts by event-time window; ``late`` is the watermark for streams."""
    rows = events.withWatermark("ts", late) if late else events
    counted = rows.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "n")


def session_windows(events: DataFrame, gap: str, by: str, late: str | None = None) -> DataFrame:
    """(by, session_start, session_end, n): runs of events no further apart than ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    counted = rows.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def dedupe_stream(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)

