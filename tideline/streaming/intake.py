"""Incremental intake: new history files become typed observations exactly once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.sources import history


def incoming(spark: SparkSession, directory: str, *, country: str, shop_id: int, since: str,
             max_files_per_trigger: int | None = None, fields: Mapping[str, str] = history.COMPACT, **checks) -> DataFrame:
    """Streaming DataFrame of typed observations from one-document JSON files, laid out as ``fields`` says."""
    reader = spark.readStream.option("wholetext", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.text(directory).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return history.typed_observations(history.document_status(history.parse_documents(docs, fields), country, shop_id, since, **checks))


def run_intake(spark: SparkSession, directory: str, output: str, checkpoint: str, **config) -> StreamingQuery:
    """Process every file that is new since the last run and stop.

    The checkpoint folder remembers finished files, and the parquet sink commits each batch
    atomically, so a restart after a lost driver or executor neither skips nor repeats a file.
    Both folders belong on storage shared by the cluster.
    """
    query = incoming(spark, directory, **config).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint).option("path", output).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
