from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import CAL, entities, obs, one, row
from tideline.operators import evidence, labels, observations as obs_ops
from tideline.operators.windows import Calendar, Window

OLD = date(2020, 1, 1)


def ev(spark, rows, ents=((1, OLD),)):
    return evidence.direct_evidence(entities(spark, ents), obs(spark, rows), CAL)


def test_local_windows_follow_zone_rules():
    assert CAL.window(2023).start == datetime(2023, 11, 21, 18)
    assert CAL.window(2025).start == datetime(2025, 9, 29, 17)


def test_half_open_edges(spark):
    w = CAL.window(2023)
    micro = timedelta(microseconds=1)
    rows = [row(1, 0, w.start), row(2, 0, w.start - micro), row(3, 0, w.end), row(4, 0, w.end - micro)]
    got = ev(spark, rows, [(i, OLD) for i in (1, 2, 3, 4)]).where("window_year = 2023")
    assert {r["entity_id"]: r["records"] for r in got.collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


@pytest.mark.parametrize("kinds,category", [
    ([], "D"), (["null"], "C"), (["null", "full_price"], "C"), (["null", "discount"], "A"),
    (["full_price"], "B"), (["full_price", "full_price"], "B"), (["full_price", "discount"], "A"), (["ambiguous"], "C")])
def test_categories(spark, kinds, category):
    rows = [row(1, i, f"2023-11-22T0{i}:00:00", k) for i, k in enumerate(kinds)] + [row(1, 99, "2022-01-01T00:00:00")]
    assert one(ev(spark, rows), window_year=2023)["category"] == category


def test_ineligible_pair_is_blank_and_same_day_is_uncertain(spark):
    got = ev(spark, [row(1, 0, "2023-11-22T00:00:00")], [(1, date(2023, 11, 22)), (2, date(2023, 11, 21))])
    late, same = one(got, entity_id=1, window_year=2023), one(got, entity_id=2, window_year=2023)
    assert late["category"] is None and late["records"] is None and late["eligible"] is False
    assert same["eligibility_status"] == "uncertain_release_hour" and same["category"] == "D"


def test_entity_without_history_is_d_with_missing_states(spark):
    ctx = evidence.pair_context(entities(spark, [(7, OLD)]), obs(spark, [row(1, 0, "2023-01-01T00:00:00")]), CAL)
    r = one(ctx, entity_id=7, window_year=2024)
    assert (r["category"], r["pre_observed_state"], r["post_observed_state"], r["pre_gap_days"]) == ("D", "missing", "missing", None)
    assert {x["entity_id"] for x in ctx.collect()} == {7}


def test_gaps_and_states(spark):
    ctx = evidence.pair_context(entities(spark, [(1, OLD)]), obs(spark, [
        row(1, 0, "2023-11-15T06:00:00", "full_price"), row(1, 1, "2023-12-03T06:00:00", "discount")]), CAL)
    r = one(ctx, window_year=2023)
    assert (r["pre_gap_days"], r["post_gap_days"], r["surrounding_days"]) == (6.5, 4.5, 18.0)
    assert (r["pre_observed_state"], r["post_observed_state"]) == ("full_price", "discount")


def test_newer_ambiguous_is_never_skipped_and_ties_conflict(spark):
    rows = [row(1, 0, "2023-11-10T00:00:00", "discount"), row(1, 1, "2023-11-12T00:00:00", "null"),
            row(2, 5, "2023-11-12T00:00:00", "discount", price=5.0), row(2, 3, "2023-11-12T00:00:00", "discount", price=4.0),
            row(3, 5, "2023-11-12T00:00:00", "discount"), row(3, 3, "2023-11-12T00:00:00", "discount")]
    o = obs(spark, rows)
    ctx = evidence.pair_context(entities(spark, [(i, OLD) for i in (1, 2, 3)]), o, CAL).where("window_year = 2023")
    states = {r["entity_id"]: (r["pre_observed_state"], r["pre_ties"], r["pre_index"]) for r in ctx.collect()}
    assert states == {1: ("ambiguous", 1, 1), 2: ("ambiguous", 2, 3), 3: ("discount", 2, 3)}
    near = evidence.nearest_records(o, ctx).where("entity_id = 2")
    assert {(r["record_index"], r["representative"]) for r in near.collect()} == {(3, True), (5, False)}
    assert [r["entity_id"] for r in evidence.conflicts(o).collect()] == [2]


def test_null_fields_are_values_in_signatures(spark):
    a = row(1, 0, "2023-01-01T00:00:00")
    b = tuple(None if i == 9 else v for i, v in enumerate(a))
    b = (1, 1, *b[2:])
    assert evidence.conflicts(obs(spark, [a, b])).count() == 1


def test_cues_compare_conflicting_sets_exactly(spark):
    before, after = "2023-11-10T00:00:00", "2023-12-10T00:00:00"
    same = [row(1, 0, before, price=5.0), row(1, 1, before, price=4.0), row(1, 2, after, price=4.0), row(1, 3, after, price=5.0)]
    diff = [row(2, 0, before, price=5.0), row(2, 1, before, price=4.0), row(2, 2, after, price=4.0), row(2, 3, after, price=3.0)]
    o = obs(spark, same + diff)
    ctx = evidence.pair_context(entities(spark, [(1, OLD), (2, OLD)]), o, CAL).where("window_year = 2023")
    hist = evidence.conflicts(o).groupBy("entity_id").agg(F.count("*").alias("history_conflicts"))
    cues = {r["entity_id"]: r["cues"] for r in evidence.interpretation_cues(o, ctx, hist).collect()}
    assert "surrounding_observed_values_differ" not in cues[1] and "surrounding_observed_values_differ" in cues[2]


def test_mixed_currency_withholds_money(spark):
    got = ev(spark, [row(1, 0, "2023-11-22T00:00:00"), row(1, 1, "2023-11-23T00:00:00", currency="EUR")])
    r = one(got, window_year=2023)
    assert r["currencies"] == "EUR;USD" and r["min_price"] is None and r["max_cut"] == 50.0


def test_labels_and_policies(spark):
    rows = [row(1, 0, "2023-11-22T00:00:00"), row(2, 0, "2023-11-22T00:00:00", "full_price"), row(3, 0, "2023-11-22T00:00:00", "null")]
    lab = labels.label_rows(ev(spark, rows, [(i, OLD) for i in (1, 2, 3, 4)])).where("window_year = 2023")
    op = {r["entity_id"]: (r["discount_observed"], r["pu_status"], r["requires_review"], r["model_eligible"]) for r in labels.with_policy(lab).collect()}
    assert op == {1: (1, "positive", False, True), 2: (0, "unlabeled", False, True), 3: (None, "unlabeled", True, False), 4: (0, "unlabeled", False, True)}
    strict = {r["entity_id"]: r["model_eligible"] for r in labels.with_policy(lab, "conservative").collect()}
    assert strict == {1: True, 2: True, 3: False, 4: False}
    with pytest.raises(ValueError):
        labels.with_policy(lab, "other")


def test_overlapping_windows_share_segments(spark):
    cal = Calendar.of([Window(1, date(2023, 1, 1), date(2023, 1, 10), datetime(2023, 1, 1), datetime(2023, 1, 10)),
                       Window(2, date(2023, 1, 5), date(2023, 1, 20), datetime(2023, 1, 5), datetime(2023, 1, 20))])
    rows = [row(1, i, datetime(2023, 1, d)) for i, d in enumerate((1, 4, 5, 9, 10, 19, 20))]
    ctx = evidence.pair_context(entities(spark, [(1, OLD)]), obs(spark, rows), cal)
    got = {r["window_year"]: (r["before_n"], r["inside_n"], r["after_n"]) for r in ctx.collect()}
    assert got == {1: (0, 4, 3), 2: (2, 4, 1)}


def test_typing_precedence(spark):
    money = "struct<amount:double,amountInt:bigint,currency:string>"
    schema = f"entity_id bigint, record_index bigint, timestamp string, shop struct<id:int,name:string>, deal struct<price:{money},regular:{money},cut:double>"
    m = lambda a, c="USD": (a, int(a * 100) if a == a else 0, c)
    deals = [None, (None, None, None), (m(5.0), m(10.0), None), (m(10.0), m(10.0), 50.0), (m(5.0), m(10.0), 0.0), (m(0.0), m(0.0), 0.0),
             (m(5.0), m(10.0, "EUR"), 50.0), (m(-1.0), m(10.0), 50.0), (m(float("nan")), m(10.0), 50.0), (m(5.0), m(10.0), 50.0),
             (m(5.0, "usd"), m(10.0, "usd"), 50.0), (m(5.0), m(10.0), 101.0)]
    raw = spark.createDataFrame([(1, i, "2023-11-21T19:00:00+01:00", (61, "m"), d) for i, d in enumerate(deals)], schema)
    got = obs_ops.type_records(raw).orderBy("record_index").collect()
    assert [(r["kind"], r["issue"]) for r in got] == [
        ("ambiguous", "deal_null"), ("ambiguous", "missing_or_invalid_price_regular_cut"), ("ambiguous", "missing_or_invalid_price_regular_cut"),
        ("ambiguous", "price_regular_cut_disagree"), ("ambiguous", "price_regular_cut_disagree"), ("full_price", None),
        ("ambiguous", "missing_or_mismatched_currency"), ("ambiguous", "missing_or_invalid_price_regular_cut"),
        ("ambiguous", "missing_or_invalid_price_regular_cut"), ("discount", None),
        ("ambiguous", "missing_or_mismatched_currency"), ("ambiguous", "missing_or_invalid_price_regular_cut")]
    assert got[0]["ts"] == datetime(2023, 11, 21, 18)


def test_naive_timestamps_are_rejected(spark):
    from tideline.functions import rules
    df = spark.createDataFrame([("2023-11-21T18:00:00",), ("2023-11-21 18:00:00Z",), ("2023-11-21T18:00:00Z",), ("2023-11-21T10:00:00-08:00",)], "v string")
    got = [r[0] for r in df.select(rules.utc_instant(F.col("v"))).collect()]
    assert got == [None, None, datetime(2023, 11, 21, 18), datetime(2023, 11, 21, 18)]


def test_results_do_not_depend_on_the_session_zone(spark):
    from tideline.functions import rules
    text = spark.createDataFrame([("2024-11-03T08:30:00Z",), ("2024-11-03T09:30:00Z",), ("2024-03-10T02:30:00Z",)], "v string")
    rows = obs(spark, [row(1, 0, "2024-03-10T02:30:00"), row(1, 1, "2024-12-10T02:30:00")])
    run = lambda: ([r[0] for r in text.select(rules.utc_instant(F.col("v"))).collect()],
                   [tuple(r) for r in evidence.pair_context(entities(spark, [(1, OLD)]), rows, CAL).select("pre_gap_days", "post_gap_days").orderBy("window_year").collect()])
    want = run()
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert run() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert want[0][0] == datetime(2024, 11, 3, 8, 30)


def test_checked_join_checks_even_when_no_right_column_is_used(spark):
    from pyspark.errors import PySparkException

    from tideline.operators import reconcile

    many = spark.createDataFrame([(1,), (2,)], "k int")
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(PySparkException, match="repeats a key"):
        reconcile.checked_join(many, twice, ["k"]).select("k").count()
    assert reconcile.checked_join(many, twice.where("v <> 'b'"), ["k"]).count() == 2


def test_history_that_is_not_valid_gets_no_category_or_label(spark):
    status = F.expr("CASE entity_id WHEN 2 THEN 'invalid' WHEN 3 THEN 'partial' WHEN 4 THEN NULL ELSE 'valid' END")
    ents = entities(spark, [(i, OLD) for i in (1, 2, 3, 4)]).withColumn("history_status", status)
    rows = obs(spark, [row(i, 0, "2023-01-01T00:00:00") for i in (1, 2, 3)])
    lab = labels.with_policy(labels.label_rows(evidence.direct_evidence(ents, rows, CAL))).where("eligible")
    got = {(r["entity_id"], r["category"], r["records"] is None, r["discount_observed"], r["pu_status"], r["model_eligible"])
           for r in lab.where("window_year = 2023").collect()}
    assert got == {(1, "D", False, 0, "unlabeled", True), (2, None, True, None, "unknown", False),
                   (3, None, False, None, "unknown", False), (4, None, True, None, "unknown", False)}
    assert {r[0] for r in lab.where("entity_id > 1").select("eligibility_status").collect()} == {"unknown_history"}
    ctx = evidence.pair_context(ents, rows, CAL).where("category IS NOT NULL")
    assert {r[0] for r in ctx.select("entity_id").collect()} == {1}


def test_shared_states_by_link_or_by_sets(spark):
    from tideline.operators import coverage

    at = lambda e, day, price, minute=0: row(e, day * 10 + minute, f"2020-01-0{day}T00:0{minute}:00", price=price)
    rows = [at(1, 1, 5.0), at(1, 1, 5.0, 1), at(1, 2, 5.0), at(1, 3, 6.0), at(1, 3, 7.0), at(1, 4, 7.0), at(1, 5, 8.0), at(1, 5, 9.0), at(2, 1, 9.0)]
    links = coverage.consecutive_groups(obs(spark, rows), coverage.STATE_COLUMNS)
    assert set(links.schema["this"].dataType.names) == {"ts", *coverage.STATE_COLUMNS}
    assert links.count() == coverage.consecutive_groups(obs(spark, rows)).count() == 5
    assert coverage.shared_state_links(obs(spark, rows), links).first()[0] == 3
