"""The bucketed ordered computations against plain Python, with one hot group."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tideline.operators import coverage, metrics, prefix, sampling


def hot_rows(n=3000, seed=5):
    """A third of all rows in one group, with many ties, negatives and zeros."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{r.randrange(40)}"
        out.append((g, i, r.choice([0.0, -1.5, round(r.gauss(0, 50), 1), r.random() * 1e6])))
    return out


@pytest.fixture
def many_slots(spark):
    """32 partitions that AQE leaves apart, although they are small."""
    wanted = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield 32
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("value", [
    "1000000000000 + id", "7", "IF(id % 2 = 0, double('infinity'), IF(id % 3 = 0, double('-infinity'), 0.0))", "pow(2.0, id % 1000)", "CAST(NULL AS INT)"])
def test_no_slot_exceeds_three_times_its_share(spark, many_slots, value):
    n = 100_000
    df = spark.range(n).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id % 5000 AS STRING)) AS g", f"{value} AS v")
    for keys in ([], ["g"]):
        rows = prefix.with_slot(df, keys, [F.col("v"), F.col("id")]).groupBy("_slot.number").count().collect()
        assert sum(r["count"] for r in rows) == n and max(r["count"] for r in rows) <= 3 * n / many_slots


def test_slots_rise_along_the_order(spark, many_slots):
    values = sorted({v for _, _, v in hot_rows()} | {float("-inf"), -1e300, -5e-324, 5e-324, 1e300, float("inf")}) + [float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = prefix.with_slot(df, [], [F.col("v")]).orderBy("i").collect()
    got = [r["_slot"]["number"] for r in rows]
    assert got == sorted(got) and len(set(got)) > 20
    assert prefix.with_slot(df.where("false"), [], [F.col("v")]).count() == 0


def test_with_next_goes_round(spark, many_slots):
    r = random.Random(2)
    keys = r.sample(range(10**12, 10**12 + 10**6), 500) + [None]
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "k long, t string")
    got = {x["k"]: x["next"]["t"] for x in prefix.with_next(df, [F.col("k")], ["t"]).collect()}
    ring = [None] + sorted(k for k in keys if k is not None)
    assert got == {k: f"t{ring[(i + 1) % len(ring)]}" for i, k in enumerate(ring)}
    one = prefix.with_next(df.limit(1), [F.col("k")], ["k"]).first()
    assert one["next"]["k"] == one["k"]


def test_ranked_equals_row_number(spark, many_slots):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = prefix.ranked(df, ["g"], [F.col("v"), F.col("i")]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 1):
            want[r[1]] = k
    assert {r["i"]: r["rank"] for r in got} == want


def test_null_keys_are_kept_as_a_group(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 1.0), ("a", 2.0)], "g string, v double")
    got = prefix.ranked(df, ["g"], [F.col("v")]).collect()
    assert {(r["g"], r["v"]): r["rank"] for r in got} == {(None, 1.0): 1, (None, 3.0): 2, ("a", 2.0): 1}
    assert {r["g"]: r["m"] for r in prefix.quantiles(df, ["g"], "v", {"m": .5}).collect()} == {None: 2.0, "a": 2.0}
    assert {r["g"]: r["median"] for r in coverage.gap_stats(df, ["g"], "v").collect()} == {None: 2.0, "a": 2.0}


def quantile(values, f):
    v = sorted(values)
    pos = (len(v) - 1) * f
    lo = int(pos)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (pos - lo)


def test_quantiles_equal_brute_force(spark, many_slots):
    rows = hot_rows()
    df = spark.createDataFrame(rows + [("hot", -1, None)], "g string, i int, v double")
    fr = {"a": 0.0, "b": .1, "c": .5, "d": .95, "e": 1.0}
    for r in prefix.quantiles(df, ["g"], "v", fr).collect():
        vals = [v for g, _, v in rows if g == r["g"]]
        assert [r[k] for k in fr] == pytest.approx([quantile(vals, f) for f in fr.values()], abs=1e-9)
    whole = prefix.quantiles(df, [], "v", fr).first()
    assert whole["c"] == pytest.approx(statistics.median(v for _, _, v in rows))


def test_gap_stats_fixture(spark):
    df = spark.createDataFrame([(None,), (None,), (0.0,), (10.0,)], "d double").withColumn("g", F.lit("x"))
    r = coverage.gap_stats(df, ["g"], "d").first()
    assert (r["n"], r["missing"], r["median"], r["p90"]) == (2, 2, 5.0, 9.0)


def test_spearman_ties_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 4.0), ("a", 1.0, 4.0), ("a", 3.0, 9.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in prefix.spearman(df, ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(1.0) and got["c"] is None


def auc(pairs):
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    total, ap, tp, seen = sum(y for _, y in pairs), 0.0, 0, 0
    for t in sorted({p for p, _ in pairs}, reverse=True):
        here = [y for p, y in pairs if p == t]
        tp, seen = tp + sum(here), seen + len(here)
        ap += sum(here) / total * tp / seen
    return ap


def test_metrics_equal_brute_force(spark):
    r = random.Random(9)
    rows = [("m", i, round(r.random(), 2), int(r.random() < .4)) for i in range(800)]
    df = spark.createDataFrame(rows, "model string, i int, p double, actual int")
    got = metrics.evaluate(df, ["model"], digits=12).first()
    pairs = [(p, y) for _, _, p, y in rows]
    assert got["roc_auc"] == pytest.approx(auc(pairs)) and got["average_precision"] == pytest.approx(average_precision(pairs))
    assert got["brier_score"] == pytest.approx(sum((p - y) ** 2 for p, y in pairs) / 800)
    assert got["tp"] == sum(p >= .5 and y for p, y in pairs)


def test_undefined_metrics_are_null_and_half_is_positive(spark):
    df = spark.createDataFrame([("one", .5, 1), ("one", .2, 1), ("none", .1, 0)], "model string, p double, actual int")
    got = {r["model"]: r for r in metrics.evaluate(df, ["model"]).collect()}
    assert got["one"]["tp"] == 1 and got["one"]["roc_auc"] is None and got["one"]["balanced_accuracy"] is None
    assert got["none"]["average_precision"] is None and got["none"]["precision"] is None and got["none"]["recall"] is None


def test_calibration_edges(spark):
    df = spark.createDataFrame([("m", p, 1) for p in (0.0, .1, .3, .30000000000000004, .9999, 1.0)], "model string, p double, actual int")
    got = {r["bin"]: r["observations"] for r in metrics.calibration(df, ["model"], [i / 10 for i in range(11)]).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 2, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2}


def test_model_choice_breaks_ties(spark):
    df = spark.createDataFrame([("a", .9, .2), ("b", .9, .1), ("c", .9, .1), ("d", .5, 0.0)], "model string, average_precision double, brier_score double")
    got = metrics.choose_model(df, ["a", "c", "b", "d"]).orderBy("place").collect()
    assert [r["model"] for r in got] == ["c", "b", "a", "d"] and [r["selected"] for r in got] == [True, False, False, False]


def test_interleave_matches_rational_order(spark):
    from fractions import Fraction

    r = random.Random(3)
    names = ["s1", "s2", "s3", "empty"]
    rows = [(i, r.choices(names[:3], [6, 3, 1])[0]) for i in range(1, 400)]
    df = sampling.with_priority(spark.createDataFrame(rows, "entity_id bigint, stratum string"))
    got = sampling.interleave(df, "stratum", names).collect()
    want, keyed = [], []
    for s in names:
        pool = sorted((x for x in got if x["stratum"] == s), key=lambda x: (x["priority"], x["entity_id"]))
        keyed += [(Fraction(2 * k - 1, 2 * len(pool)), s, x["priority"], x["entity_id"]) for k, x in enumerate(pool, 1)]
    want = {e: k for k, (_, _, _, e) in enumerate(sorted(keyed), 1)}
    assert {x["entity_id"]: x["sample_rank"] for x in got} == want


def test_quotas_and_cap(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 25), ("c", 1)], "s string, n int")
    got = {r["s"]: r["quota"] for r in sampling.sqrt_quotas(sizes, 16, "s", "n").collect()}
    assert got == {"a": 10, "b": 5, "c": 1}
    rows = sampling.with_priority(spark.createDataFrame([(i, "a", "hot" if i % 3 else f"o{i}") for i in range(60)], "entity_id bigint, s string, owner string"))
    picked = sampling.capped_pick(rows, spark.createDataFrame([("a", 15)], "s string, quota int"), ["s"], "owner").collect()
    assert len(picked) == 15 and sum(r["owner"] == "hot" for r in picked) <= 2


def test_split_digest_rule(spark):
    import hashlib
    from tideline.functions import rules
    ids = list(range(1, 300))
    df = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", rules.evaluation_group(F.col("i"), "x|42|").alias("g"))
    want = {i: "evaluation" if int(hashlib.sha256(f"x|42|{i}".encode()).hexdigest(), 16) % 5 == 0 else "development" for i in ids}
    assert {r["i"]: r["g"] for r in df.collect()} == want
