import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import metrics, models, prepare

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = []
    for i in range(240):
        a, b = r.gauss(0, 2), r.gauss(5, 1)
        data.append((i, 2023 + i % 3, None if i % 17 == 0 else a, b, 1.0, int(a + r.gauss(0, .5) > 0)))
    return spark.createDataFrame(data, "entity_id bigint, window_year int, a double, b double, c double, discount_observed int")


def test_medians_interpolate_and_scale_uses_population_std(spark):
    df = spark.createDataFrame([(i, 1, float(i)) for i in (1, 2, 3, 4)], "entity_id int, window_year int, a double")
    med = prepare.training_medians(df, ["a"])
    assert med.first()["median"] == 2.5
    s = prepare.scaling(df, ["a"]).first()
    assert (s["mean"], s["variance"]) == (2.5, 1.25)


def test_all_missing_training_column(spark):
    df = spark.createDataFrame([(1, 1, 2.0, None), (2, 1, 4.0, None)], "entity_id int, window_year int, a double, b double")
    med = prepare.training_medians(df, ["a", "b"])
    assert {r["feature"]: r["keep"] for r in prepare.observed_features(med).collect()} == {"a": True, "b": False}
    with pytest.raises(Exception, match="entirely missing"):
        prepare.impute(df, med, ["a", "b"]).collect()
    assert {r["b"] for r in prepare.impute(df, med, ["a", "b"], empty="zero").collect()} == {0.0}


def test_statistics_ignore_evaluation_rows(spark, rows):
    train = rows.where("window_year < 2025")
    changed = rows.withColumn("a", F.when(F.col("window_year") == 2025, 1e9).otherwise(F.col("a")))
    a = prepare.training_medians(train, NAMES).orderBy("feature").collect()
    assert a == prepare.training_medians(changed.where("window_year < 2025"), NAMES).orderBy("feature").collect()


def test_scores_and_importances(spark, rows):
    train, valid = rows.where("window_year < 2025"), rows.where("window_year = 2025")
    fitted = [models.fit(k, train, names=NAMES) for k in ("prior_baseline", "logistic_regression", "random_forest")]
    scored = models.score(fitted, valid)
    assert scored.count() == 240
    prior = train.agg(F.avg("discount_observed")).first()[0]
    assert {round(r["p"], 12) for r in scored.where("model = 'prior_baseline'").collect()} == {round(prior, 12)}
    auc = {r["model"]: r["roc_auc"] for r in metrics.evaluate(scored, ["model"]).collect()}
    assert auc["logistic_regression"] > .85 and auc["random_forest"] > .85 and auc["prior_baseline"] == .5
    assert {r["violations"] for r in metrics.validate_predictions(scored, valid.withColumnRenamed("discount_observed", "actual"),
                                                                   ["entity_id", "window_year"]).collect()} == {0}
    sig = scored.where("model = 'logistic_regression'").select(F.max(F.abs(F.col("p") - 1 / (1 + F.exp(-F.col("decision_score")))))).first()[0]
    assert sig < 1e-9
    imp = {(r["model"], r["feature"]): r["value"] for r in models.importances(fitted, "final").collect()}
    assert imp["random_forest", "a"] > .5 and abs(imp["logistic_regression", "c"]) < 1e-9
    perm = {r["feature"]: r for r in models.permutation_importance(fitted[2], valid, repeats=3).collect()}
    assert perm["a"]["importance_mean"] > .1 and perm["c"]["importance_mean"] == 0.0 and perm["a"]["repeats"] == 3


def test_models_share_one_preparation(spark, rows, monkeypatch):
    train, valid = rows.where("window_year < 2025"), rows.where("window_year = 2025")
    calls = []
    monkeypatch.setattr(prepare, "training_medians", lambda *a, real=prepare.training_medians: calls.append(1) or real(*a))
    kinds = ("prior_baseline", "logistic_regression")
    together = models.fit_all(kinds, train, names=NAMES)
    assert len(calls) == 1
    apart = [models.fit(k, train, names=NAMES) for k in kinds]
    get = lambda fitted: sorted((r["entity_id"], r["model"], round(r["p"], 6)) for r in models.score(fitted, valid).collect())
    assert get(together) == get(apart)


def test_permutation_of_several_models_writes_one_predictor_at_a_time(spark, rows, monkeypatch):
    train, valid = rows.where("window_year < 2025"), rows.where("window_year = 2025")
    fitted = models.fit_all(("random_forest", "boosted_trees"), train, names=NAMES)
    dropped, real = [], models.forget
    monkeypatch.setattr(models, "forget", lambda *t: dropped.append(len(t)) or real(*t))
    both = models.permutation_importance(fitted, valid, repeats=2)
    assert dropped == [2] * len(NAMES)
    got = {(r["model"], r["feature"]): tuple(r)[1:4] for r in both.collect()}
    alone = models.permutation_importance(fitted[0], valid, repeats=2).collect()
    assert len(got) == 6 and {got["random_forest", r["feature"]] for r in alone} == {tuple(r)[1:4] for r in alone}
    with pytest.raises(ValueError, match="same inputs"):
        models.permutation_importance([fitted[0], models.fit("random_forest", train, names=NAMES[:2])], valid)


def test_permutation_scores_a_row_once_for_each_value_it_receives(spark, monkeypatch):
    data = [(i, 2025, float(i % 2), float(i % 7), i * .25, int(i % 2 or i % 7 > 4)) for i in range(60)]
    rows = spark.createDataFrame(data, "entity_id bigint, window_year int, a double, b double, c double, discount_observed int").withColumn("k", F.lit(1.0))
    fitted = models.fit("random_forest", rows, names=(*NAMES, "k"))
    scored, real = [], models._long_probabilities
    monkeypatch.setattr(models, "_long_probabilities", lambda m, r, *keys: scored.append(r) or real(m, r, *keys))
    monkeypatch.setattr(models, "forget", lambda *t: None)
    monkeypatch.setattr(models, "BUCKET_ROWS", 8)
    monkeypatch.setattr(models, "REPEATS_HELD", 5)
    got = {r["feature"]: r for r in models.permutation_importance(fitted, rows, repeats=12).collect()}
    a, b, c, k = (r.count() for r in scored[1:])
    assert k == 60 * 3 and a <= 60 * 6 and b < 60 * 12 and a < c <= 60 * 12  # 12 repeats in three blocks
    # The same shuffles in plain Python.
    sha = lambda *parts: hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()
    base = [(*r[2:5], 1.0, r[5]) for r in sorted(data, key=lambda r: sha(42, r[0], r[1]))]
    tables = {}
    for f, name in enumerate((*NAMES, "k")):
        for repeat in range(1, 13):
            order = sorted(range(60), key=lambda i: sha(42, f, repeat, i + 1))  # noqa: B023
            tables[name, repeat] = [(*r[:f], base[o][f], *r[f + 1:]) for r, o in zip(base, order, strict=True)]
    inputs = sorted({r[:-1] for t in (base, *tables.values()) for r in t})
    p = {tuple(r["v"]): r["p"] for r in fitted.predict_inputs(
        spark.createDataFrame([(list(x), list(x)) for x in inputs], "x array<double>, v array<double>")).collect()}
    full = auc([(p[r[:-1]], r[-1]) for r in base])
    for name in got:
        drops = [full - auc([(p[r[:-1]], r[-1]) for r in tables[name, repeat]]) for repeat in range(1, 13)]
        assert got[name]["repeats"] == 12 and abs(got[name]["importance_mean"] - sum(drops) / 12) < 1e-8
    assert got["a"]["importance_mean"] > .05


def auc(scores):
    pairs = [(a > b) + (a == b) / 2 for a, y in scores if y for b, z in scores if not z]
    return sum(pairs) / len(pairs)


def test_roles_and_overlap(spark, rows):
    roles = prepare.chronological_roles(rows, 2023, 2024, 2025)
    got = {r["role"]: r["rows"] for r in prepare.split_summary(roles, "discount_observed").collect()}
    assert got == {"development_training": 80, "development_validation": 80, "final_training": 160, "held_out_test": 80}
    assert prepare.role_overlap(roles, "final_training", "held_out_test").first()["shared_entities"] == 0
