"""Streamed traffic counts equal the batch ones, with duplicates and restarts."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from leafcast import queries
from leafcast.sources import adapters
from leafcast.sources.tables import read_table
from leafcast.streaming.traffic_stream import CLASSES, start_traffic_stream, traffic_counts


def test_streamed_counts_equal_the_batch(spark):
    root = tempfile.mkdtemp(prefix="leafcast-traffic-", dir="/tmp")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    times = read_table(spark, SMALL, "events", "event_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    log = adapters.access_v(spark, SMALL).join(times, "event_id").select("event_id", "ts", "user_agent", "accept_language", "raw", "html")
    third = lambda n: log.where(F.col("event_id") % 3 == n).coalesce(1)

    def run():
        q = start_traffic_stream(spark, src, out, lateness="4000 days", window="30 days", name="traffic_" + os.path.basename(root), max_files_per_trigger=1)
        q.awaitTermination(300)
        assert q.exception() is None

    def now():
        return {tuple(r) for r in traffic_counts(spark, out).groupBy(*CLASSES).agg(F.sum("requests")).collect()}

    third(0).write.mode("append").parquet(src)
    run()
    first = now()
    # A second file repeats some requests of the first; the stream is started again over it, and once more over nothing new.
    third(1).union(third(0).where("event_id % 2 = 0")).coalesce(1).write.mode("append").parquet(src)
    run()
    third(2).write.mode("append").parquet(src)
    run()
    run()
    want = {tuple(r) for r in queries.q_traffic_classes(spark, SMALL).select(*CLASSES, "requests").collect()}
    assert now() == want and first != want
    assert sum(r.requests for r in traffic_counts(spark, out).collect()) == log.count()
