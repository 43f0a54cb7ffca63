"""Every registered query against its SQL twin, on the given tables and on a skewed copy."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
SKEWED = ["label_distribution", "window_evidence_counts", "range_join_sides", "nearest_context", "nearest_tied_records", "side_summary",
          "interpretation_cues", "prior_price_features", "timestamp_conflicts", "state_transitions", "shared_state_groups", "newest_first_check",
          "event_sequence", "grouped_gap_statistics", "feature_lineage", "boundary_version_balance", "discount_exclusions", "identical_duplicates",
          "journal_integrity", "attempt_usage", "canonical_order", "history_coverage_summary"]


def connect(directory):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{directory}/{t}.parquet{'/*.parquet' if directory != SF else ''}')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def assert_same(df, sql, con):
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    assert len(got) == len(want)
    assert got == want


@pytest.fixture(scope="module")
def plain():
    return connect(SF)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A third of all observations and events belong to one entity, a tenth to one instant."""
    d = str(tmp_path_factory.mktemp("skew"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "lineitem":
            k = F.col("l_orderkey")
            df = df.withColumn("l_partkey", F.when(k % 3 == 0, F.lit(11).cast("bigint")).otherwise(F.col("l_partkey"))) \
                .withColumn("l_shipdate", F.when(k % 30 == 0, F.lit("1998-11-25").cast("timestamp_ntz")).otherwise(F.col("l_shipdate")))
        if t == "events":
            df = df.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("user_id")))
        df.write.parquet(f"{d}/{t}.parquet")
    return d, connect(d)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, plain, name):
    assert_same(queries()[name](spark, SF), oracle_sql()[name], plain)


@pytest.mark.parametrize("name", SKEWED)
def test_matches_sql_under_skew(spark, skewed, name):
    directory, con = skewed
    assert_same(queries()[name](spark, directory), oracle_sql()[name], con)


def test_record_positions_are_unique(spark):
    from tideline.plans import bindings
    o = bindings.all_observations(spark, "/root/testdata/sf0.01")
    assert o.groupBy("entity_id", "record_index").count().where("count > 1").count() == 0
