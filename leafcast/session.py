"""Spark session helpers.

The library never creates its own cluster settings beyond what a job needs to be
correct (UTC session zone, AQE on). Checkpoint storage is read from the session's
``spark.checkpoint.dir``; only a local test session gets a scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_TEST_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "leafcast") -> SparkSession:
    """Local session for tests and the bench (cluster jobs get their session from the launcher)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _TEST_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LEAFCAST_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_scratch_dir: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session names none (a local test session) is a scratch folder used,
    one per process (the setting itself cannot be changed on a running session).
    """
    global _scratch_dir
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _scratch_dir is None:
        _scratch_dir = tempfile.mkdtemp(prefix="leafcast-ckpt-", dir=os.environ.get("LEAFCAST_SCRATCH", "/tmp"))
    return _scratch_dir


#: Rows of a batch that goes to Python, at most: a row here is a document, and Spark's own bound is 10,000.
BATCH_ROWS = 512
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(df, rows: int = BATCH_ROWS):
    """``df`` as it is, its session's Arrow batches held to ``rows`` (a smaller setting stays).

    Jobs call it on what they hand to Python, so that a task's memory does not depend on who
    made the session.
    """
    conf = df.sparkSession.conf
    now = int(conf.get(_BATCHES))
    if now <= 0 or now > rows:
        conf.set(_BATCHES, str(rows))
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that Spark reads it from."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def materialize(df, name: str = "stage"):
    """Write a bounded intermediate result as a table in the checkpoint folder and read it back.

    Cuts the lineage (a lost executor does not recompute the upstream stages), runs the
    upstream plan once, and lets several downstream branches share the result. The
    folder is the shared one the cluster names in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/leafcast/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reuse(df):
    """Keep a small derived result for reuse across branches of one plan.

    For results derived cheaply from a materialized table: a lost block is recomputed
    from that table, so no lineage needs cutting and no extra write job is spent.
    """
    _reused.append(df.cache())
    return df


_reused: list = []


def release(spark: SparkSession) -> None:
    """Frees what ``reuse`` has kept; call it when a job's outputs are written."""
    while _reused:
        _reused.pop().unpersist()
