"""Model queries, fitted on MLlib. Scores are checked by rows and tests; contracts and optimality conditions also by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import features, metrics, models, prepare
from tideline.plans import bindings as b
from tideline.plans.bindings import ENTITIES, FEATURES, OBS, PAIRS, TAGGED, WIN_2001, with_ctes
from tideline.plans.evaluation import MODELING_SQL, modeling_of
from tideline.plans.evidence import MODEL_CTES
from tideline.plans.registry import query
from tideline.session import durable


def parts(spark, d):
    rows = durable(modeling_of(spark, d))
    return {y: rows.where(F.col("window_year") == y) for y in (1998, 1999, 2000)} | {
        "final": rows.where("window_year < 2000"), "all": rows}


@query("logistic_scores", "M7 M10")
def logistic_scores(spark, d):
    p = parts(spark, d)
    return models.score([models.fit("logistic_regression", p["final"])], p[2000])


@query("forest_scores", "M8 M10")
def forest_scores(spark, d):
    p = parts(spark, d)
    return models.score([models.fit("random_forest", p["final"])], p[2000])


@query("boosted_scores", "M9 M10")
def boosted_scores(spark, d):
    p = parts(spark, d)
    return models.score([models.fit("boosted_trees", p["final"])], p[2000])


@query("held_out_metrics", "M6 M7 M8 M10 M11 M12 M13 M14 U1")
def held_out_metrics(spark, d):
    """All four models on the last year."""
    p = parts(spark, d)
    fitted = models.fit_all(models.MODEL_ORDER, p["final"])
    return metrics.evaluate(durable(models.score(fitted, p[2000])), ["model"])


@query("held_out_subgroups", "M18 W12")
def held_out_subgroups(spark, d):
    """Metrics of all four models by history, discount, missingness and density subgroups."""
    p = parts(spark, d)
    scored = durable(models.score(models.fit_all(models.MODEL_ORDER, p["final"]), p[2000]))
    rows = scored.join(p[2000].drop("discount_observed"), ["entity_id", "window_year"])
    families = metrics.feature_families(F.size(prepare.missing_names()))
    return metrics.evaluate(metrics.by_segments(rows, families), ["model", "family", "segment"])


@query("coverage_only_ablation", "M21")
def coverage_only_ablation(spark, d):
    p = parts(spark, d)
    return models.coverage_ablation(p["final"], p[2000])


@query("model_importances", "M22")
def model_importances(spark, d):
    p = parts(spark, d)
    return models.importances(models.fit_all(models.MODEL_ORDER, p["final"]), "final")


@query("permutation_importance", "M23")
def permutation_importance(spark, d):
    """Both tree models, every predictor."""
    p = parts(spark, d)
    return models.permutation_importance(models.fit_all(("random_forest", "boosted_trees"), p["final"]), p[2000])


@query("second_experiment", "M24 M19")
def second_experiment(spark, d):
    """First year to second year with all four models, ranked on those rows only."""
    p = parts(spark, d)
    fitted = models.fit_all(models.MODEL_ORDER, p[1998])
    scored = durable(models.score(fitted, p[1999]))
    result = metrics.evaluate(scored, ["model"])
    return result.join(metrics.choose_model(result, models.MODEL_ORDER), "model")


@query("refit_later_window", "M25 P23")
def refit_later_window(spark, d):
    """Refit on every labelled year, score the later window, attach availability."""
    p = parts(spark, d)
    later = features.features(b.entities(spark, d), b.observations(spark, d), b.CALENDAR_2001)
    return models.refit_rows(models.fit("boosted_trees", p["all"]), later, rules.coverage_group(F.col("prior_price_record_count")))


# ------------------------------------------------------------------ contracts that SQL can state
KINDS = "(VALUES " + ", ".join(f"('{k}')" for k in models.MODEL_ORDER) + ") AS k(model)"
MODELING = MODELING_SQL[:MODELING_SQL.index(",\nroles AS")]
FITTED_ON = {"first_year": "window_year = 1998", "both_years": "window_year < 2000"}


@query("model_score_contracts", "M7 M8 M9 M10 M24", with_ctes(*MODEL_CTES, MODELING, body=f"""
SELECT model, count(*) AS scored_rows, count(DISTINCT (entity_id, window_year)) AS pairs, CAST(sum(discount_observed) AS BIGINT) AS positives,
  CAST(0 AS BIGINT) AS bad_probability, CAST(0 AS BIGINT) AS wrong_class, CAST(0 AS BIGINT) AS wrong_sign
FROM modeling CROSS JOIN {KINDS} WHERE window_year = 2000 GROUP BY 1"""))
def model_score_contracts(spark, d):
    """All four models score every held-out pair once; probabilities, classes and decision signs agree."""
    p = parts(spark, d)
    scored = durable(models.score(models.fit_all(models.MODEL_ORDER, p["final"]), p[2000]))
    c = F.col
    return scored.groupBy("model").agg(
        F.count("*").alias("scored_rows"), F.count_distinct("entity_id", "window_year").alias("pairs"), F.sum("actual").alias("positives"),
        F.count_if(~F.coalesce(c("p").between(0, 1), F.lit(False))).alias("bad_probability"),
        F.count_if(~c("predicted").eqNullSafe((c("p") >= 0.5).cast("int"))).alias("wrong_class"),
        F.count_if(F.coalesce((c("decision_score") >= 0) != (c("p") >= 0.5), F.lit(False))).alias("wrong_sign"))


@query("training_rates", "M6 M7 M24", with_ctes(*MODEL_CTES, MODELING, body="\nUNION ALL ".join(f"""
SELECT '{name}' AS fitted_on, model, count(*) AS training_rows, round(avg(discount_observed), 9) AS training_rate, true AS calibrated
FROM modeling CROSS JOIN (VALUES ('prior_baseline'), ('logistic_regression')) AS k(model) WHERE {where} GROUP BY 2""" for name, where in FITTED_ON.items())))
def training_rates(spark, d):
    """The prior is the training rate, and so is the logistic model's mean training probability: its intercept is not penalised."""
    p = parts(spark, d)
    out = None
    for name, rows in (("first_year", p[1998]), ("both_years", p["final"])):
        scored = models.score(models.fit_all(("prior_baseline", "logistic_regression"), rows), rows)
        one = scored.groupBy(F.lit(name).alias("fitted_on"), "model").agg(
            F.count("*").alias("training_rows"), F.round(F.avg("actual"), 9).alias("training_rate"), (F.abs(F.avg("p") - F.avg("actual")) < 1e-3).alias("calibrated"))
        out = one if out is None else out.unionByName(one)
    return out


@query("logistic_optimality", "M7 M5", "SELECT feature, true AS optimal FROM (VALUES " + ", ".join(f"('{f}')" for f in features.PREDICTORS) + ") AS f(feature)")
def logistic_optimality(spark, d):
    """Gradient of the penalised loss at the fitted coefficients, by predictor: mean (p - y) x + w / (C n) is near 0."""
    p = parts(spark, d)
    fitted = models.fit("logistic_regression", p["final"])
    inputs = fitted.inputs(p["final"])
    scored = fitted.predict_inputs(inputs)
    n, residual = F.count("*"), F.col("p") - F.col("discount_observed")
    gradient = [F.struct(F.lit(f).alias("feature"), (F.abs(F.avg(residual * F.col(f)) + F.lit(float(w)) / (models.LOGISTIC["C"] * n)) < 2e-3).alias("optimal"))
                for f, w in zip(fitted.features, fitted.model.coefficients.toArray())]
    return scored.agg(F.array(*gradient).alias("g")).select(F.inline("g"))


@query("importance_contracts", "M22", """
SELECT model, CAST(15 AS BIGINT) AS features, CAST(0 AS BIGINT) AS not_finite, tree AS sums_to_one
FROM (VALUES ('logistic_regression', NULL), ('random_forest', true), ('boosted_trees', true)) AS k(model, tree)""")
def importance_contracts(spark, d):
    p = parts(spark, d)
    rows = models.importances(models.fit_all(models.MODEL_ORDER, p["final"]), "final")
    v, tree = F.col("value"), F.col("model") != "logistic_regression"
    return rows.groupBy("model").agg(
        F.count_distinct("feature").alias("features"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf")) | (tree & (v < 0))).alias("not_finite"),
        F.when(F.first(tree), F.abs(F.sum(v) - 1) < 1e-9).alias("sums_to_one"))


@query("ablation_counts", "M21", with_ctes(*MODEL_CTES, MODELING, body="""
SELECT model, count(*) AS observations, count(*) FILTER (WHERE discount_observed = 1) AS actual_positive, true AS confusion_adds_up
FROM modeling CROSS JOIN (VALUES ('logistic_regression'), ('coverage_only_logistic')) AS k(model) WHERE window_year = 2000 GROUP BY 1"""))
def ablation_counts(spark, d):
    p = parts(spark, d)
    c = F.col
    return models.coverage_ablation(p["final"], p[2000]).select(
        "model", "observations", "actual_positive",
        ((c("tp") + c("fn") == c("actual_positive")) & (c("tn") + c("fp") == c("actual_negative")) & c("roc_auc").between(0, 1)).alias("confusion_adds_up"))


@query("refit_contract", "M25 P23", with_ctes(ENTITIES, OBS, WIN_2001, PAIRS, TAGGED, FEATURES, body="""
SELECT entity_id, window_year, prior_price_record_count, prior_discount_count, has_prior_price_history,
  CASE WHEN prior_price_record_count = 0 THEN '0' WHEN prior_price_record_count <= 9 THEN '1-9' WHEN prior_price_record_count <= 29 THEN '10-29' ELSE '30+' END AS coverage_group,
  true AS valid_score FROM feat"""))
def refit_contract(spark, d):
    """Every pair of the later window is scored once, beside its availability columns."""
    rows, c = refit_later_window(spark, d), F.col
    return rows.select("entity_id", "window_year", "prior_price_record_count", "prior_discount_count", "has_prior_price_history", "coverage_group",
                       (c("p").between(0, 1) & (c("predicted") == (c("p") >= 0.5).cast("int"))).alias("valid_score"))
