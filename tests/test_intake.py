from datetime import datetime

from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import intake

JOURNAL = "pos bigint, kind string, sequence bigint, entity_id bigint, endpoint string, round bigint, http_status int"


def violations(spark, rows):
    return {r["rule"]: r["violations"] for r in intake.journal_violations(spark.createDataFrame(rows, JOURNAL)).collect() if r["violations"]}


GOOD = [(1, "attempt", 1, 7, "lookup", 0, None), (2, "result", 1, None, None, None, 200), (3, "round", None, 7, None, 1, None),
        (4, "attempt", 2, 7, "history", 1, None), (5, "result", 2, None, None, None, None)]


def test_journal_rules(spark):
    assert violations(spark, GOOD) == {}
    assert violations(spark, [(1, "attempt", 2, 7, "lookup", 0, None)]) == {"attempt_sequence": 1}
    assert violations(spark, [*GOOD, (6, "result", 2, None, None, None, 200)]) == {"repeated_result": 1}
    assert violations(spark, [(1, "result", 1, None, None, None, 200), (2, "attempt", 1, 7, "lookup", 0, None)]) == {"result_without_earlier_attempt": 1}
    assert violations(spark, [(1, "round", None, 7, None, 2, None)]) == {"round_sequence": 1}
    assert violations(spark, [(1, "attempt", 1, 7, "lookup", 3, None), (2, "result", 1, None, None, None, 99)]) == {"attempt_round": 1, "http_status": 1}


def test_counts_and_caps(spark):
    j = spark.createDataFrame(GOOD, JOURNAL)
    r = intake.journal_counts(j).first()
    assert (r["attempts"], r["successful"], r["failed"], r["unknown_outcome"]) == (2, 1, 1, 0)
    many = spark.createDataFrame([(i, "attempt", i, 7, "lookup", 0, None) for i in range(1, 7)], JOURNAL)
    got = intake.attempt_usage(many, 3, 5).orderBy("pos").collect()
    assert [x["use"] for x in got] == [1, 2, 3, 4, 5, 6] and [x["over_cap"] for x in got] == [False] * 3 + [True] * 3


def test_work_plan(spark):
    rows = [(1, 10, "valid", None, None, False), (2, 20, "invalid", None, None, False), (3, 30, "absent", None, None, False),
            (4, 40, "incomplete", "matched", "not_requested", False), (5, 50, "incomplete", "matched", "request_failed", False),
            (6, 60, "valid", "matched", "history_received", True)]
    cohort = spark.createDataFrame(rows, "position int, entity_id int, status string, lookup_status string, history_status string, stale boolean")
    plan = lambda **kw: [(r["entity_id"], r["requests"], r["new_round"]) for r in intake.plan_work(cohort, **kw).orderBy("position").collect()]
    assert plan(retry_failed=False) == [(30, 2, False), (40, 1, False), (60, 2, True)]
    assert plan(retry_failed=True) == [(30, 2, False), (40, 1, False), (50, 1, True), (60, 2, True)]
    assert plan(retry_failed=True, limit=2) == [(30, 2, False), (40, 1, False)]


def test_receipts_and_http_dates(spark):
    df = spark.createDataFrame([("Tue, 13 Oct 2026 15:36:29 GMT",), ("13 Oct 2026",), (None,)], "v string").select(rules.http_date(F.col("v")).alias("t"))
    assert [r["t"] for r in df.collect()] == [datetime(2026, 10, 13, 15, 36, 29), None, None]
    got = intake.receipt_evidence(df, "t", F.lit("2026-10-12 15:36:29").cast("timestamp_ntz")).first()
    assert got["received_before_cutoff"] is False and got["days_after_cutoff"] == 1.0
