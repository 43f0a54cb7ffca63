"""Queries that write the driver tables as files of each kind and read them back with the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from tideline.operators import intake
from tideline.plans import bindings as b
from tideline.plans.registry import query
from tideline.session import shared_folder
from tideline.sources import history, tables


def fresh(spark, kind):
    return f"{shared_folder(spark)}/tideline-{kind}-{uuid.uuid4().hex}"


def with_header(rows, header):
    """One text line for each row; the first line of every part carries the header before it."""
    parts = rows.withColumn("_part", F.spark_partition_id()).withColumn("_order", F.monotonically_increasing_id())
    first = F.row_number().over(W.partitionBy("_part").orderBy("_order")) == 1
    return parts.select("_part", "line", first.alias("first")).select(F.when(F.col("first"), F.concat(F.lit(header + "\n"), F.col("line"))).otherwise(F.col("line")))


@query("csv_round_trip", "S3 S10 S11", """
SELECT doc_id, lang, source, n_chars, text IS NULL AS no_text, sha256(text) AS digest FROM documents""")
def csv_round_trip(spark, d):
    """Texts with quotes, commas and line breaks, written as CSV and read by byte ranges."""
    docs = b.table(spark, d, "documents")
    path = fresh(spark, "csv")
    tables.write_table(docs, path, docs.columns, "csv")
    back = tables.read_strict_csv(spark, path, docs.schema, ["doc_id", "text"])
    return back.select("doc_id", "lang", "source", "n_chars", F.col("text").isNull().alias("no_text"), F.sha2("text", 256).alias("digest"))


@query("saved_table_differences", "S11", """
SELECT count(*) AS old_rows, count(*) AS new_rows, CAST(0 AS BIGINT) AS removed_rows, CAST(0 AS BIGINT) AS added_rows, true AS identical FROM customer""")
def saved_table_differences(spark, d):
    cust = b.table(spark, d, "customer")
    path = fresh(spark, "csv")
    tables.write_table(cust, path, cust.columns, "csv")
    return tables.round_trip_differences(cust, path, "csv")


CATALOG = ["key", "name", "brand", "kind", "size"]


def catalog_lines(spark, d, defects):
    """The part table as catalog lines, some names with quoted quotes, commas and line breaks; defects change the width."""
    k = F.col("p_partkey")
    name = F.concat(F.lit('"'), "p_name", F.when(k % 7 == 1, '\n""new"", line').when(k % 7 == 2, ',""').otherwise(""), F.lit('"'))
    fields = [k.cast("string"), name, F.col("p_brand"), F.when(k % 5 == 0, "").otherwise(F.when(k % 5 == 1, "NA").otherwise(F.col("p_type"))), F.col("p_size").cast("string")]
    whole = F.concat_ws(",", *fields)
    if defects:
        whole = F.when(k % 13 == 3, F.concat_ws(",", *fields[:4])).when(k % 17 == 4, F.concat(whole, F.lit(',extra,"x,y"'))).otherwise(whole)
    return b.table(spark, d, "part").select(whole.alias("line"))


@query("corrected_catalog", "S1", r"""
SELECT CAST(p_partkey AS VARCHAR) AS "key", p_name || CASE p_partkey % 7 WHEN 1 THEN chr(10) || '"new", line' WHEN 2 THEN ',"' ELSE '' END AS name, p_brand AS brand,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NA' ELSE p_type END AS kind, CAST(p_size AS VARCHAR) AS size FROM part""")
def corrected_catalog(spark, d):
    """A catalog whose published header runs two names together."""
    path = fresh(spark, "catalog")
    with_header(catalog_lines(spark, d, False), "key,name,brandkind,size").write.text(path)
    return tables.read_corrected_csv(spark, path, CATALOG, 2)


@query("catalog_field_counts", "S2", """
SELECT CAST(CASE WHEN p_partkey % 13 = 3 THEN 4 WHEN p_partkey % 17 = 4 THEN 7 ELSE 5 END AS INTEGER) AS fields, count(*) AS records, count(*) AS with_first_field FROM part GROUP BY 1""")
def catalog_field_counts(spark, d):
    """Records of each width in a catalog with short and long records."""
    path = fresh(spark, "catalog")
    with_header(catalog_lines(spark, d, True), ",".join(CATALOG)).write.text(path)
    return tables.field_counts(spark, path, CATALOG)


@query("catalog_identity", "S4", "SELECT p_partkey, p_name FROM part")
def catalog_identity(spark, d):
    return tables.catalog_identity(spark, f"{d}/part.parquet", ("p_partkey", "p_name"))


@query("journal_file_counts", "S9 A31", """
SELECT count(*) FILTER (WHERE event_type IN ('click', 'view')) AS attempts, count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'signup') AND event_id % 3 = 0) AS successful,
  count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'signup') AND event_id % 3 <> 0) AS failed,
  count(*) FILTER (WHERE event_type IN ('click', 'view')) - count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'signup')) AS unknown_outcome FROM events""")
def journal_file_counts(spark, d):
    """The events as JSON lines of an attempt journal, read back by the journal source."""
    e, path = b.table(spark, d, "events"), fresh(spark, "journal")
    kind = F.when(F.col("event_type").isin("click", "view"), "attempt").when(F.col("event_type") == "signup", "round").otherwise("result")
    line = F.to_json(F.struct(kind.alias("kind"), F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("appid"),
                              F.when((kind == "result") & (F.col("event_id") % 3 == 0), 200).when((kind == "result") & (F.col("event_id") % 3 == 1), 500).alias("http_status")))
    e.select(line).write.text(path)
    return intake.journal_counts(history.read_journal(spark, path))
