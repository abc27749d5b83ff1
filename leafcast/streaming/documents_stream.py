"""Structured Streaming form of the document job (Entry B over arriving captures).

Captured single-post responses land as parquet files in a folder; the stream parses
them (S4), converts them with exactly the batch code (``build_documents``: native
passes plus one Arrow pass, all stateless, so no watermark or state store is needed)
and appends documents to a parquet sink. Progress is kept in a checkpoint folder under
the session's ``spark.checkpoint.dir``, so a restarted query resumes where it stopped.
``availableNow`` processes what is there and stops, which suits scheduled runs.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafcast import schemas
from leafcast.operators.documents import build_documents
from leafcast.options import Options
from leafcast.session import checkpoint_dir
from leafcast.sources.captures import full_post

# Columns of a captured single-post response file.
CAPTURE_SCHEMA = schemas.POST_CAPTURE


def start_document_stream(spark: SparkSession, source_dir: str, out_dir: str, opts: Options,
                          mode: str = "markdown", name: str = "documents", available_now: bool = True,
                          max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(CAPTURE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    captures = reader.parquet(source_dir)
    docs = build_documents(full_post(captures), opts, mode)
    # Progress belongs to one source and one output, whatever the query's name.
    place = sha256("\n".join((source_dir, out_dir, mode)).encode()).hexdigest()[:16]
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/leafcast-streams/{name}-{place}"
    writer = (docs.writeStream.format("parquet").outputMode("append")
              .option("path", out_dir).option("checkpointLocation", ckpt).queryName(name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
