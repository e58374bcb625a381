"""Session builder, table loading and shared folders for queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(cpus: int | None = None, app: str = "quarry", **extra: str) -> SparkSession:
    """A session with the settings that the engine expects: UTC, AQE on, Arrow on.

    Given ``cpus``, it is local with so many threads and shuffle partitions; otherwise master and
    partitions are left to the cluster's own settings.
    """
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if cpus:
        builder = builder.master(f"local[{cpus}]")
        conf |= {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g"}
    conf |= extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table; zone-less timestamps become UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; only a local session
    may name none. It goes when the driver ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
    folder = f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """The table, written to a shared folder: for results that are used more than once."""
    path = f"{work_folder(df.sparkSession)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
