"""Session helpers: sensible defaults and reliable lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Recording a Python stack for every column costs seconds on wide plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "tideline", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, read from the session.

    Only a local master without that setting (tests) falls back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tideline-")
        sc.setCheckpointDir(named)
    return named


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more.

    Spark does so when the driver's JVM collects those plans, which a driver with memory to spare may put off for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def folders(table: DataFrame) -> list:
    """Folders that ``durable`` wrote and ``table`` reads, as Hadoop paths."""
    jvm = table.sparkSession._jvm
    found = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent().toString() for file in table.inputFiles()}
    return [jvm.org.apache.hadoop.fs.Path(f) for f in sorted(found) if f.rsplit("/", 1)[-1].startswith("tideline-")]


def together(*tables: DataFrame) -> DataFrame:
    """Tables of one schema that ``durable`` wrote, as one scan: plans that read them several times stay small."""
    spark = tables[0].sparkSession
    return spark.read.schema(tables[0].schema).parquet(*[str(f.toString()) for t in tables for f in folders(t)])


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote, once their last reader is written, and old shuffle files; other tables are left alone."""
    for table in tables:
        for folder in folders(table):
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    if tables:
        release_shuffles(tables[0].sparkSession)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared folder.

    A lost executor re-reads the table instead of recomputing its history, and later readers
    still get column pruning and compressed, splittable files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tideline-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
