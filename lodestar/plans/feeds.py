"""Queries of event feeds: progress in batch form, and streams run over the stored events until they are read up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import cte, table, view
from ..sources.shared import session_folder
from ..streaming import feeds as L
from .registry import query


_PROGRESS = f"""WITH {cte("crawl_events")}, p AS (SELECT university, max(value) AS most, arg_max(type, epoch_us(ts) * 1000 + event_id % 1000) AS last_type, arg_max(message, epoch_us(ts) * 1000 + event_id % 1000) AS message,
CAST(floor(epoch(max(ts))) - floor(epoch(min(ts) FILTER (type = 'scrape-start'))) AS BIGINT) AS elapsed FROM crawl_events WHERE type <> 'heartbeat' GROUP BY university)
SELECT university, most, last_type, last_type IN ('scrape-start', 'scrape-progress') AS active, last_type = 'scrape-done' AS done, elapsed,
CASE WHEN last_type IN ('scrape-done', 'scrape-error') THEN CAST(elapsed AS DOUBLE) END AS duration, CASE WHEN last_type = 'scrape-error' THEN message END AS reason FROM p"""


@query(_PROGRESS)
def progress(spark, sf_dir):
    return L.crawl_progress(view(spark, sf_dir, "crawl_events").withColumn("ts", F.col("ts").cast("timestamp")))


@query(_PROGRESS)
def stream_progress(spark, sf_dir):
    """The same from a stream: events arrive in parts by day, and each batch updates the universities it says something about."""
    folder = session_folder(spark, "progress")
    events = view(spark, sf_dir, "crawl_events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.withColumn("part", F.pmod(F.dayofyear("ts"), F.lit(4))).repartition("part").write.partitionBy("part").parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    step = lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/rows/batch={i}")
    L.crawl_progress(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(step).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    names = [c for c in rows.columns if c not in ("university", "batch")]
    return rows.groupBy("university").agg(F.max_by(F.struct(*names), "batch").alias("x")).select("university", "x.*")


@query(f"WITH {cte('crawl_events')}, l AS (SELECT event_id, ts FROM crawl_events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM l")
def stream_feed(spark, sf_dir):
    folder = session_folder(spark, "feed")
    schema = table(spark, sf_dir, "events").schema
    stream = L.timed(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    run = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(L.event_feed(f"{folder}/rows")).start()
    run.awaitTermination()
    return L.replay(spark, f"{folder}/rows", 100).select("event_id", "seq")
