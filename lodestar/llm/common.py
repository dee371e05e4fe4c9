"""What several operators of this subpackage share: staged tables, joins with checked sizes, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The most rows of a narrow table (at most three numbers a row) that are ever broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_lodestar_scratch", None) or tempfile.mkdtemp(prefix="spark-lodestar-")
        spark.sparkContext._lodestar_scratch = found
    return found.rstrip("/")


class Stage:
    """Writes tables of one job below the shared folder, so that later steps survive lost executors and repeat nothing.

    A table stays until :meth:`drop` or, as the frames returned to the caller read some, the end of the session.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths = spark, {}
        self.path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{len(self.paths)}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = found
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Deletes staged tables that nothing will read again."""
        for path, df in self.paths.items():
            if any(df is x for x in tables):
                self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the session may have ended before
            pass

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A hint to broadcast a narrow staged table if it is counted to have at most so many rows; else a join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A node of more edges is a hub, if there are few edges; of many edges the bound rises, so that hubs stay few. So many edges fit one task, so among these none is a hub.
HUB = 1000
ALL = 100_000


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node of an edge, component the least node.

    Large-star and small-star steps in turn; repeated edges go at the end of each turn. Up to ALL edges a window finds each
    node's least neighbour, as they fit one task; beyond, an aggregate does, which combines before it shuffles, and the edges
    of hubs aren't gathered: they meet their hub's least neighbour by a broadcast. Of e edges at most
    2 * e / max(HUB, 2 * e / BROADCAST_ROWS) nodes are hubs, so at most BROADCAST_ROWS. Edges with a null end or between a
    node and itself count for nothing. No edges give no rows.
    """
    star = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    count, seen = star.count(), None
    while True:
        hub = max(HUB, -(-2 * count // BROADCAST_ROWS)) if count > ALL else None
        before, star = star, stage(_small_star(_large_star(star, hub), hub))
        stage.drop(before)
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        count, seen = now[0], now
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(star.select("b", "b").distinct())


def _with_least(rows: DataFrame, hub: int | None) -> DataFrame:
    """The rows (a, b) with the least b of their a as ``m``."""
    if hub is None:
        return rows.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    hubs = F.broadcast(least.where(F.col("degree") > hub).drop("degree"))
    others = rows.join(hubs, "a", "left_anti").join(least.where(F.col("degree") <= hub).drop("degree"), "a")
    return rows.join(hubs, "a").select("a", "b", "m").union(others.select("a", "b", "m"))


def _large_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """Every neighbour larger than a node goes to the least of the node and its neighbours: one row (a, b), a > b, for each edge."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return _with_least(both, hub).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """Every neighbour smaller than a node, and the node itself, goes to the node's least neighbour; edges are (a, b), a > b."""
    ends = F.explode(F.expr("case when b = m then array(a) else array(a, b) end"))
    return _with_least(edges, hub).select(ends.alias("a"), F.col("m").alias("b")).distinct()
