"""Strict CSV and parquet tables: corrected headers, width checks, write-once sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

# The raw catalog's columns in file order. Its published header runs the two
# columns at CATALOG_MERGED together, so it has one name less than every record has fields.
CATALOG_COLUMNS = (
    "AppID", "Name", "Release date", "Estimated owners", "Peak CCU", "Required age", "Price", "Discount",
    "DLC count", "About the game", "Supported languages", "Full audio languages", "Reviews", "Header image",
    "Website", "Support url", "Support email", "Windows", "Mac", "Linux", "Metacritic score", "Metacritic url",
    "User score", "Positive", "Negative", "Score rank", "Achievements", "Recommendations", "Notes",
    "Average playtime forever", "Average playtime two weeks", "Median playtime forever",
    "Median playtime two weeks", "Developers", "Publishers", "Categories", "Genres", "Tags", "Screenshots", "Movies")
CATALOG_MERGED = 7
CATALOG_DROPPED = ("About the game", "Reviews", "Header image", "Website", "Support url", "Support email",
                   "Metacritic url", "Score rank", "Notes", "Screenshots", "Movies")

CORRUPT = "_corrupt_record"


CSV = {"quote": '"', "escape": '"', "multiLine": "true"}  # quotes are doubled inside quoted fields; records may span lines


def _csv(spark: SparkSession, **options):
    return spark.read.options(**{"header": True, "encoding": "UTF-8", **CSV, **options})


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, header): the records of UTF-8 CSV files, each as its text; one file is read by many tasks.

    A line ends a record if an even number of quotes stands before its end. Lines are read in parallel by byte ranges; the quotes of each range
    are counted, running sums over a file's ranges (one row for each) give the parity at their starts, and running sums inside
    a range give it for each line. Most records are one line and stay where they are; only the lines of
    longer ones are brought together, across ranges too. A record is held in memory as a whole; line breaks inside it stay as they are. A quote may not stand inside an unquoted field.
    ``header`` marks the first record of each file; blank lines are left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    earlier = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "at").agg(F.sum("quotes").alias("_q")).select(
        "file", "at", F.coalesce(F.sum("_q").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("file", "at").orderBy("seq")
    through = F.col("_before") + F.sum("quotes").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = lines.join(ranges, ["file", "at"]).withColumn("_through", through).withColumn("_r", F.row_number().over(inside)).select(
        "file", "at", "seq", "line", ((F.col("at") == 0) & (F.col("_r") == 1)).alias("header"),
        ((F.col("_through") - F.col("quotes")) % 2 == 0).alias("opens"), (F.col("_through") % 2 == 0).alias("closes"))
    begins = F.when(F.col("opens"), F.struct("at", "seq"))
    # The start of a long record: the last opening line so far in the range, or in the ranges before it.
    long = placed.where(~(F.col("opens") & F.col("closes"))).withColumn(
        "_own", F.last(begins, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    left = long.groupBy("file", "at").agg(F.max(begins).alias("_last")).select(
        "file", "at", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    joined = long.join(left, ["file", "at"]).groupBy("file", F.coalesce("_own", "_carried").alias("_start")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", "line"))), lambda x: x["line"]), "\n").alias("record"),
        F.max("header").alias("header"))
    records = placed.where(F.col("opens") & F.col("closes")).select("file", F.col("line").alias("record"), "header").unionByName(
        joined.select("file", "record", "header"))
    text = F.regexp_replace("record", "^\ufeff|\r$", "")
    return records.withColumn("record", text).where(F.col("header") | (F.trim("record") != ""))


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Names in the header record (read as data, so repeated names are seen as they are)."""
    first = _csv(spark, header=False).csv(path).limit(1).first()
    return [] if first is None else ["" if v is None else v for v in first]


def _checked_header(names: Sequence[str], columns: Sequence[str], merged: int | None) -> None:
    columns = list(columns)
    accepted = [columns]
    if merged is not None:
        accepted.append(columns[:merged] + [columns[merged] + columns[merged + 1]] + columns[merged + 2:])
    if list(names) not in accepted:
        raise ValueError("unexpected header; review the schema before continuing")


def _parsed(spark: SparkSession, path: str, names: Sequence[str], schema: T.StructType, **options) -> DataFrame:
    """Records of all files by the schema; a file whose header has other names fails the job."""
    same = F.replace("record", F.lit('"'), F.lit("")) == ",".join(names)
    wrong = F.raise_error(F.concat(F.lit("unexpected header in "), "file")).cast("boolean")
    body = csv_records(spark, path).where(F.when(F.col("header"), F.when(same, False).otherwise(wrong)).otherwise(True))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return body.select("file", "record", F.from_csv("record", ddl, {**CSV, **options}).alias("r")).select("file", "record", "r.*")


def _with_corrupt(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])
    return _parsed(spark, path, header_names(spark, path), schema, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def read_corrected_csv(spark: SparkSession, path: str, columns: Sequence[str] = CATALOG_COLUMNS,
                       merged: int | None = CATALOG_MERGED) -> DataFrame:
    """CSV with a known or known-broken header; a record of the wrong width fails the job.

    Text such as "NA" stays text; only empty fields are null.
    """
    _checked_header(header_names(spark, path), columns, merged)
    rows = _with_corrupt(spark, path, columns)
    guard = F.when(F.col(CORRUPT).isNotNull(), F.raise_error(F.concat(
        F.lit("record of unexpected width in "), "file", F.lit(": "), CORRUPT)).cast("boolean")).otherwise(True)
    return rows.where(guard).select(*[F.col(f"`{c}`") for c in columns])


def fields_in_text(record: Column) -> Column:
    """Number of CSV fields in one raw record, quoted separators not counted."""
    return F.size(F.split(F.regexp_replace(record, '"([^"]|"")*"', "q"), ",", -1))


def field_counts(spark: SparkSession, path: str, columns: Sequence[str] = CATALOG_COLUMNS) -> DataFrame:
    """Records per width, and how many of them have a non-empty first field."""
    rows = _with_corrupt(spark, path, columns)
    width = F.when(F.col(CORRUPT).isNull(), len(columns)).otherwise(fields_in_text(F.col(CORRUPT)))
    return rows.groupBy(width.alias("fields")).agg(
        F.count("*").alias("records"), F.count(f"`{columns[0]}`").alias("with_first_field"))


def bad_record_sample(spark: SparkSession, path: str, columns: Sequence[str] = CATALOG_COLUMNS, limit: int = 50) -> DataFrame:
    """The first records of a wrong width, in the order of their text."""
    rows = _with_corrupt(spark, path, columns).where(F.col(CORRUPT).isNotNull())
    return rows.select(F.col(f"`{columns[0]}`").alias("first_field"), fields_in_text(F.col(CORRUPT)).alias("fields"),
                       F.col(CORRUPT).alias("record")).orderBy("record", "first_field").limit(limit)


def read_strict_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """CSV whose header is unique, complete and in schema order; ragged or mistyped rows fail."""
    names = header_names(spark, path)
    if not names or "" in names or len(names) != len(set(names)):
        raise ValueError("empty or repeated column names")
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    if names != schema.fieldNames():
        raise ValueError(f"header differs from the declared schema: {names}")
    return _parsed(spark, path, names, schema, mode="FAILFAST").select(*[F.col(f"`{c}`") for c in names])


def catalog_identity(spark: SparkSession, path: str, columns: Sequence[str] = ("AppID", "release_date", "release_year")) -> DataFrame:
    """Only the identity columns of a wide parquet or corrected catalog table."""
    return spark.read.parquet(path).select(*columns)


def write_table(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet") -> None:
    """Fixed column order, nulls as blanks in CSV, never overwriting an existing table."""
    missing = [c for c in columns if c not in df.columns]
    if missing or len(columns) != len(df.columns):
        raise ValueError(f"columns do not match the table: {missing or df.columns}")
    writer = df.select(*columns).write.mode("errorifexists")
    if fmt == "csv":
        # A quoted empty string stays apart from a blank null.
        writer = writer.options(**CSV, header=True, nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)


def round_trip_differences(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Rows that differ between a table and its saved copy, both ways, as multiset counts."""
    from tideline.operators.reconcile import multiset_diff

    reader = df.sparkSession.read.schema(df.schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return multiset_diff(df, reader.format(fmt).load(path))
