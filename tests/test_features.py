from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import CAL, entities, obs, one, row
from tideline.operators import features

OLD = date(2020, 1, 1)


def feats(spark, rows, ents=((1, OLD),), **kw):
    return features.features(entities(spark, ents), obs(spark, rows), CAL, **kw)


def test_golden_row(spark):
    rows = [row(1, 0, "2023-11-18T18:00:00", "full_price", regular=10.0), row(1, 1, "2023-11-19T18:00:00", price=5.0, cut=50.0),
            row(1, 2, "2023-11-20T18:00:00", price=2.0, cut=80.0)]
    r = one(feats(spark, rows), window_year=2023)
    assert (r["prior_price_record_count"], r["prior_discount_count"], r["max_prior_discount_pct"], r["mean_prior_discount_pct"],
            r["days_since_last_price_record"], r["last_observed_price"], r["last_observed_discount_pct"]) == (3, 2, 80.0, 65.0, 1.0, 2.0, 80.0)
    assert r["prior_discount_rate"] == pytest.approx(2 / 3)


def test_no_history_stays_null(spark):
    r = one(feats(spark, [row(9, 0, "2023-01-01T00:00:00")]), window_year=2023)
    nullable = [f for f in features.PREDICTORS if f not in features.NEVER_NULL]
    assert all(r[f] is None for f in nullable) and r["has_prior_price_history"] == 0 and r["prior_price_record_count"] == 0


def test_no_discount_keeps_discount_fields_null(spark):
    r = one(feats(spark, [row(1, 0, "2023-11-01T00:00:00", "full_price")]), window_year=2023)
    assert r["prior_discount_rate"] == 0.0 and r["days_since_last_discount"] is None and r["mean_prior_discount_pct"] is None


@pytest.mark.parametrize("rows,issue,price,cut", [
    ([("2023-11-01T00:00:00", {}), ("2023-11-02T00:00:00", {"currency": "EUR"})], "mixed_prior_currencies", None, 50.0),
    ([("2023-11-02T00:00:00", {"currency": "EUR"})], "non_home_prior_currency", None, 50.0),
    ([("2023-11-02T00:00:00", {}), ("2023-11-02T00:00:00", {"price": 4.0, "cut": 60.0})], "conflicting_latest_timestamp", None, None),
    ([("2023-11-02T00:00:00", {}), ("2023-11-02T00:00:00", {})], None, 5.0, 50.0),
    ([("2023-11-02T00:00:00", {}), ("2023-11-05T00:00:00", {"kind": "null"})], None, 5.0, 50.0),
    ([("2023-11-05T00:00:00", {}), ("2023-11-05T00:00:00", {"kind": "null"})], None, 5.0, 50.0)])
def test_withholding(spark, rows, issue, price, cut):
    data = [row(1, i, ts, **kw) for i, (ts, kw) in enumerate(rows)]
    r = one(feats(spark, data, with_diagnostics=True), window_year=2023)
    assert (r["money_issue"], r["last_observed_price"], r["last_observed_discount_pct"]) == (issue, price, cut)


def test_static_features_and_eligibility(spark):
    got = feats(spark, [row(1, 0, "2023-01-01T00:00:00")], [(1, date(2023, 11, 21)), (2, date(2023, 11, 22))])
    r = one(got, entity_id=1, window_year=2023)
    assert (r["game_age_days"], r["release_year"], r["release_month"], r["release_quarter"], r["audit_release_hour_uncertain"]) == (0, 2023, 11, 4, 1)
    assert not [x for x in got.collect() if x["entity_id"] == 2 and x["window_year"] == 2023]


def test_strictly_before_cutoff_and_order_free(spark):
    w = CAL.window(2023).start
    rows = [row(1, 0, w - timedelta(microseconds=1), price=3.0, cut=70.0), row(1, 1, w, price=1.0, cut=90.0), row(1, 2, w + timedelta(days=1), price=1.0, cut=90.0)]
    assert one(feats(spark, rows), window_year=2023)["prior_price_record_count"] == 1
    a = feats(spark, rows).orderBy("window_year").collect()
    assert a == feats(spark, rows[::-1]).orderBy("window_year").collect()
    assert {r["changed_rows"] for r in features.future_removal_differences(entities(spark, [(1, OLD)]), obs(spark, rows), CAL).collect()} == {0}
    got = features.boundary_insertion_differences(entities(spark, [(1, OLD)]), obs(spark, rows), CAL, 61).collect()
    assert {(r["window_year"], r["compared_rows"], r["changed_rows"]) for r in got} == {(y, 1, 0) for y in (2023, 2024, 2025)}


def test_version_comparison_sees_changes(spark):
    a = feats(spark, [row(1, 0, "2023-01-01T00:00:00")])
    b = feats(spark, [row(1, 0, "2023-01-01T00:00:00", price=4.0)])
    assert features.differing_rows(a, b).count() == 3


def test_contract_catches_broken_rows(spark):
    good = feats(spark, [row(1, 0, "2023-01-01T00:00:00")])
    assert {r["violations"] for r in features.contract_violations(good).collect()} == {0}
    bad = good.withColumn("prior_discount_count", F.lit(5)).withColumn("days_since_last_discount", F.lit(-1.0)).withColumn("max_prior_discount_pct", F.lit(150.0))
    got = {r["rule"]: r["violations"] for r in features.contract_violations(bad).collect()}
    assert got["discounts_exceed_records"] == got["percent_range"] == got["recency_not_prior"] == 3


def test_allowlist_rejects_missing_and_prohibited(spark):
    f = feats(spark, [row(1, 0, "2023-01-01T00:00:00")])
    assert features.select_predictors(f).columns == ["entity_id", "window_year", *features.PREDICTORS]
    with pytest.raises(ValueError):
        features.select_predictors(f.drop("release_year"))
    with pytest.raises(ValueError):
        features.select_predictors(f.withColumn("category", F.lit("A")), ["category"])


def test_currency_codes_round_trip(spark):
    from tideline.functions import rules
    df = spark.createDataFrame([("USD",), ("EUR",), ("usd",), ("US",), (None,)], "c string")
    assert [r[0] for r in df.select(rules.currency_text(rules.currency_code(F.col("c")))).collect()] == ["USD", "EUR", None, None, None]
