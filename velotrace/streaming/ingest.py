"""New activity files as a stream: the same readers on a streaming scan, exactly once by the checkpoint."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import files, fit


def ingest_fit(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Appends the messages of new FIT files below folder to a Parquet table, and stops when all are read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    new = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    msgs = fit.read_messages(files.accepted(new, ".fit"))
    return msgs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
