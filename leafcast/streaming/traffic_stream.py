"""Structured Streaming form of the traffic classes (L1): counts of requests that arrive, and arrive twice.

Requests land as files. Each counts once (by ``event_id``, within the watermark), in a window of its time and its class
(agent, language, output mode). Every micro-batch writes the counts it changed into a folder of its own, which a batch that is
repeated after a failure replaces; ``traffic_counts`` reads the last count of each window and class. State is kept for as long as
the watermark allows late requests; later ones are left out. Progress is kept under the session's ``spark.checkpoint.dir``.

Cases: a null event id is an id; a null time is left out by the watermark; an empty folder gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafcast.functions import clients
from leafcast.session import checkpoint_dir

ACCESS_SCHEMA = "event_id bigint, ts timestamp, user_agent string, accept_language string, raw boolean, html boolean"
CLASSES = ("is_agent", "lang", "mode")


def classified(access: DataFrame) -> DataFrame:
    """Requests with their class."""
    return access.select(
        "event_id", "ts", clients.is_agent(F.col("user_agent")).alias("is_agent"), clients.negotiate_lang(F.col("accept_language")).alias("lang"),
        clients.render_mode(F.col("raw"), F.col("html"), F.col("user_agent")).alias("mode"),
    )


def start_traffic_stream(spark: SparkSession, source_dir: str, out_dir: str, lateness: str = "1 day", window: str = "1 hour",
                         name: str = "traffic", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Counts what has arrived in ``source_dir`` since the last run and stops (``availableNow``)."""
    reader = spark.readStream.schema(ACCESS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    once = classified(reader.parquet(source_dir)).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    counts = once.groupBy(F.window("ts", window).alias("window"), *CLASSES).agg(F.count(F.lit(1)).alias("requests"))
    rows = counts.select(F.col("window.start").alias("start"), *CLASSES, "requests")

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_dir))

    # Progress belongs to one source and one output, whatever the query's name.
    place = sha256("\n".join((source_dir, out_dir, lateness, window)).encode()).hexdigest()[:16]
    return (rows.writeStream.outputMode("update").foreachBatch(write).queryName(name)
            .option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/leafcast-streams/{name}-{place}").trigger(availableNow=True).start())


def traffic_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Requests per window start and class, as of the last batch that changed them."""
    rows = spark.read.schema("start timestamp, is_agent boolean, lang string, mode string, requests bigint, batch bigint").parquet(out_dir)
    return rows.groupBy("start", *CLASSES).agg(F.max_by("requests", "batch").alias("requests"))
