"""The folder that all machines of a cluster share, and tables of one session in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of a narrow table, and the most bytes of its texts, that are ever broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; in local mode a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp(prefix="spark-lodestar-")).rstrip("/")


def session_folder(spark: SparkSession, name: str) -> str:
    """A new folder that goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, at: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before
        pass


def spread(df: DataFrame, key: str) -> DataFrame:
    """Dealt by a key where a table lies in fewer partitions than there are cores, which are small then; else as it lies."""
    return df.repartition(key) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back, so that later steps don't compute it again."""
    path = session_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, *texts: str) -> bool:
    """Whether a table has few enough rows, and few enough bytes in the columns named, to be broadcast."""
    found = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), *[F.sum(F.octet_length(c)) for c in texts]).first()
    return found[0] <= BROADCAST_ROWS and sum(x or 0 for x in found[1:]) <= BROADCAST_BYTES


def few(df: DataFrame, *texts: str) -> DataFrame:
    """To broadcast if the table is counted to fit; else a join shuffles. Texts of unbounded length are to be named."""
    return F.broadcast(df) if fits(df, *texts) else df
