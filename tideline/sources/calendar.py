"""Sale calendars from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.operators.windows import Calendar, Window, verify_calendar_rows

EVENTS = ("timezone string, events array<struct<sale_year:int,sale_start_pacific:string,sale_end_pacific:string,"
          "sale_start_utc:string,sale_end_utc:string,verification_status:string,source_url:string>>")


def calendar_rows(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(EVENTS).option("multiLine", True).json(path)
    return doc.select("timezone", F.explode("events").alias("e")).select(
        F.col("e.sale_year").alias("window_year"), F.col("timezone").alias("zone"),
        F.col("e.sale_start_pacific").alias("start_local"), F.col("e.sale_end_pacific").alias("end_local"),
        F.col("e.sale_start_utc").alias("start_utc"), F.col("e.sale_end_utc").alias("end_utc"),
        (F.col("e.verification_status") == "verified").alias("verified"), F.col("e.source_url").alias("source_url"))


def load_calendar(spark: SparkSession, path: str) -> Calendar:
    """Verified calendar; any unverified or inconsistent row is refused.

    The calendar is configuration (one row per sale window), read to the driver whole and turned into plan literals.
    """
    rows = verify_calendar_rows(calendar_rows(spark, path)).orderBy("window_year").collect()
    bad = [(r["window_year"], r["problems"]) for r in rows if r["problems"] or not r["verified"] or not r["source_url"]]
    if bad or not rows:
        raise ValueError(f"calendar rows refused: {bad}")
    from datetime import date
    return Calendar.of([Window(r["window_year"], date.fromisoformat(r["start_local"][:10]), date.fromisoformat(r["end_local"][:10]),
                               r["window_start"], r["window_end"]) for r in rows])
