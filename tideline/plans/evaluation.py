"""Split, preparation, metric and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import catalog, features, metrics, prefix, prepare, sampling
from tideline.plans import bindings as b
from tideline.plans.bindings import ENTITIES, FEATURES, OBS, PAIRS, SCORES, TAGGED, WIN, WIN_2001, with_ctes
from tideline.plans.catalog import SPLIT_SQL, stable_hash_split
from tideline.plans.evidence import CAL, FEATURE_CTES, MODEL_CTES, features_of, labels_of, modeling_rows
from tideline.plans.registry import query
from tideline.session import durable

P = features.PREDICTORS
TENTHS = [i / 10 for i in range(11)]
FIFTHS = [i * 0.2 for i in range(6)]


# ------------------------------------------------------------------ splits
def modeling_of(spark, d):
    return modeling_rows(spark, d).where("model_eligible")


MODELING_SQL = """modeling AS (
  SELECT f.*, l.category, l.discount_observed FROM feat f JOIN lab l USING (entity_id, window_year) WHERE l.model_eligible),
roles AS (
  SELECT m.*, unnest(list_filter([CASE WHEN window_year = 1998 THEN 'development_training' END, CASE WHEN window_year = 1999 THEN 'development_validation' END,
    CASE WHEN window_year IN (1998, 1999) THEN 'final_training' END, CASE WHEN window_year = 2000 THEN 'held_out_test' END], lambda x: x IS NOT NULL)) AS role
  FROM modeling m)"""
ROLE_CTES = (*MODEL_CTES, MODELING_SQL)


def roles_of(spark, d):
    return prepare.chronological_roles(modeling_of(spark, d), 1998, 1999, 2000)


@query("chronological_roles", "M1", with_ctes(*ROLE_CTES, body="SELECT entity_id, window_year, role, discount_observed FROM roles"))
def chronological_roles(spark, d):
    return roles_of(spark, d).select("entity_id", "window_year", "role", "discount_observed")


@query("split_summary", "A34 M1", with_ctes(*ROLE_CTES, body="""
SELECT role, count(*) AS "rows", count(DISTINCT entity_id) AS entities, count(*) FILTER (WHERE discount_observed = 1) AS positives,
  count(*) FILTER (WHERE discount_observed = 0) AS zeros FROM roles GROUP BY 1"""))
def split_summary(spark, d):
    return prepare.split_summary(roles_of(spark, d), "discount_observed")


@query("split_overlap", "A34", with_ctes(*ROLE_CTES, body="""
SELECT count(*) AS shared_entities FROM (SELECT DISTINCT entity_id FROM roles WHERE role = 'final_training'
  AND entity_id IN (SELECT entity_id FROM roles WHERE role = 'held_out_test'))"""))
def split_overlap(spark, d):
    return prepare.role_overlap(roles_of(spark, d), "final_training", "held_out_test")


@query("entity_disjoint_split", "M2", with_ctes(*ROLE_CTES, SPLIT_SQL, body="""
SELECT m.entity_id, m.window_year, CASE WHEN s.evaluation_group = 'development' THEN 'train' ELSE 'evaluation' END AS part
FROM modeling m JOIN split s USING (entity_id)
WHERE (s.evaluation_group = 'development' AND m.window_year < 2000) OR (s.evaluation_group = 'evaluation' AND m.window_year = 2000)"""))
def entity_disjoint_split(spark, d):
    group = rules.evaluation_group(F.col("entity_id"), "window-split|42|")
    rows = modeling_of(spark, d).select("entity_id", "window_year", group.alias("g"))
    part = F.when((F.col("g") == "development") & (F.col("window_year") < 2000), "train") \
        .when((F.col("g") == "evaluation") & (F.col("window_year") == 2000), "evaluation")
    return rows.select("entity_id", "window_year", part.alias("part")).where(F.col("part").isNotNull())


# ------------------------------------------------------------------ preparation
LONG_SQL = "\nUNION ALL ".join(f"SELECT entity_id, window_year, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {{src}}" for c in P)
FLONG = "flong AS (" + LONG_SQL.format(src="feat") + ")"
TRAIN_LONG = "tlong AS (SELECT * FROM flong WHERE window_year < 2000)"
MEDIANS_SQL = """med AS (SELECT feature, count(*) AS n, count(value) AS observed, quantile_cont(value, 0.5) AS median FROM tlong GROUP BY 1)"""
IMPUTED_SQL = """imp AS (SELECT f.entity_id, f.window_year, f.feature, coalesce(f.value, m.median) AS value FROM flong f JOIN med m USING (feature))"""
PREP_CTES = (*FEATURE_CTES, FLONG, TRAIN_LONG, MEDIANS_SQL, IMPUTED_SQL)


def frozen_features(spark, d):
    """Feature table written once: several statistics and projections read it afterwards."""
    return durable(features_of(spark, d))


def train_of(f):
    return f.where("window_year < 2000")


@query("training_medians", "M3", with_ctes(*PREP_CTES, body="""
SELECT feature, n AS "rows", observed, round(median, 6) AS median FROM med"""))
def training_medians(spark, d):
    return prepare.training_medians(train_of(features_of(spark, d))).withColumn("median", F.round("median", 6))


@query("imputed_features", "M3", with_ctes(*PREP_CTES, body="SELECT entity_id, window_year, feature, round(value, 6) AS value FROM imp"))
def imputed_features(spark, d):
    f = frozen_features(spark, d)
    rows = prepare.impute(f, prepare.training_medians(train_of(f)))
    return features.melt(rows, ["entity_id", "window_year"]).withColumn("value", F.round("value", 6))


@query("observed_training_features", "M4", with_ctes(*PREP_CTES, body="""
SELECT feature, n AS "rows", observed, observed > 0 AS keep FROM med"""))
def observed_training_features(spark, d):
    return prepare.observed_features(prepare.training_medians(train_of(features_of(spark, d))))


SCALE_SQL = "sc AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS variance FROM imp WHERE window_year < 2000 GROUP BY 1)"


def scaling_of(f):
    """Medians and scale of the training rows; the small median table is kept as well."""
    medians = durable(prepare.training_medians(train_of(f)))
    return medians, prepare.scaling(prepare.impute(train_of(f), medians))


@query("training_scale", "M5", with_ctes(*PREP_CTES, SCALE_SQL, body="""
SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 4) AS variance FROM sc"""))
def training_scale(spark, d):
    return scaling_of(frozen_features(spark, d))[1].select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                                          F.round("variance", 4).alias("variance"))


@query("standardised_features", "M5", with_ctes(*PREP_CTES, SCALE_SQL, body="""
SELECT entity_id, window_year, feature, round((value - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 6) AS value FROM imp JOIN sc USING (feature)"""))
def standardised_features(spark, d):
    f = frozen_features(spark, d)
    medians, stats = scaling_of(f)
    rows = prepare.standardise(prepare.impute(f, medians), stats)
    return features.melt(rows, ["entity_id", "window_year"]).withColumn("value", F.round("value", 6))


@query("preprocessing_check", "L6", with_ctes(*PREP_CTES, SCALE_SQL, body="""
SELECT 'median_differs' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'mean_not_zero', 0 UNION ALL SELECT 'variance_not_one', 0
UNION ALL SELECT 'empty_feature', count(*) FILTER (WHERE observed = 0) FROM med"""))
def preprocessing_check(spark, d):
    """Fitted statistics against statistics recomputed from the transformed training rows."""
    f = frozen_features(spark, d)
    train = train_of(f)
    medians, stats = scaling_of(f)
    z = features.melt(prepare.standardise(prepare.impute(train, medians), stats), []).groupBy("feature").agg(
        F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    c = F.col
    # A median leaves at most half of the values on either side.
    sides = features.melt(train, []).join(medians.select("feature", "median"), "feature").groupBy("feature").agg(
        F.count("value").alias("k"), F.count_if(c("value") < c("median")).alias("below"),
        F.count_if(c("value") > c("median")).alias("above"))
    rows = sides.join(z, "feature").join(stats.select("feature", "std"), "feature")
    return features.count_violations(rows, {
        "median_differs": (2 * c("below") > c("k")) | (2 * c("above") > c("k")), "mean_not_zero": F.abs(c("m")) > 1e-9,
        "variance_not_one": (F.abs(c("v") - 1) > 1e-9) & (c("std") > 0), "empty_feature": c("k") == 0})


@query("training_prior", "M6", with_ctes(*ROLE_CTES, body="""
SELECT role, round(avg(discount_observed), 9) AS prior, count(*) AS training_rows FROM roles WHERE role LIKE '%training' GROUP BY 1"""))
def training_prior(spark, d):
    rows = roles_of(spark, d).where("role LIKE '%training'")
    return rows.groupBy("role").agg(F.round(F.avg(F.col("discount_observed").cast("double")), 9).alias("prior"),
                                    F.count("*").alias("training_rows"))


# ------------------------------------------------------------------ missing values
@query("feature_missingness", "A12", with_ctes(*FEATURE_CTES, FLONG, body="""
SELECT feature, window_year, count(*) AS "rows", count(*) - count(value) AS missing, round(min(value), 6) AS low, round(max(value), 6) AS high,
  round(100e0 * (count(*) - count(value)) / count(*), 6) AS missing_percent FROM flong GROUP BY GROUPING SETS ((feature, window_year), (feature))"""))
def feature_missingness(spark, d):
    return prepare.missingness(features_of(spark, d))


@query("feature_statistics", "A12", with_ctes(*FEATURE_CTES, FLONG, body="""
SELECT feature, count(*) - count(value) AS missing, round(min(value), 6) AS low, round(max(value), 6) AS high, count(DISTINCT value) AS distinct_values,
  round(quantile_cont(value, 0.5), 6) AS median FROM flong GROUP BY 1"""))
def feature_statistics(spark, d):
    return prepare.feature_statistics(features_of(spark, d))


PATTERN = "concat_ws(';', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in P) + ")"


@query("missing_patterns", "A24", with_ctes(*FEATURE_CTES, body=f"""
SELECT pattern, count(*) AS "rows", CAST(CASE WHEN pattern = '' THEN 0 ELSE length(pattern) - length(replace(pattern, ';', '')) + 1 END AS INTEGER) AS missing_features
FROM (SELECT {PATTERN} AS pattern FROM feat) GROUP BY 1"""))
def missing_patterns(spark, d):
    return prepare.missing_patterns(features_of(spark, d))


@query("missingness_by_class", "A25", with_ctes(*ROLE_CTES, "mlong AS (" + "\nUNION ALL ".join(
    f"SELECT discount_observed, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM modeling" for c in P) + ")", body="""
SELECT feature, discount_observed, count(*) AS "rows", count(*) - count(value) AS missing,
  round(100e0 * (count(*) - count(value)) / count(*), 6) AS missing_percent FROM mlong GROUP BY 1, 2"""))
def missingness_by_class(spark, d):
    return prepare.missingness_by_class(modeling_of(spark, d), "discount_observed")


@query("feature_availability", "A33", with_ctes(*FEATURE_CTES, FLONG, body="""
, bd AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM flong WHERE window_year < 2000 GROUP BY 1)
SELECT feature, count(*) AS "rows", count(*) - count(value) AS missing, round(max(lo), 6) AS train_low, round(max(hi), 6) AS train_high,
  count(*) FILTER (WHERE value < lo OR value > hi) AS outside_training_range FROM flong JOIN bd USING (feature) WHERE window_year = 2000 GROUP BY 1
""").replace("\n, bd", ", bd"))
def feature_availability(spark, d):
    f = frozen_features(spark, d)
    return prepare.availability(f.where("window_year = 2000"), f.where("window_year < 2000"))


@query("coverage_group_rates", "A22", with_ctes(*ROLE_CTES, body="""
SELECT window_year, CASE WHEN prior_price_record_count = 0 THEN '0' WHEN prior_price_record_count <= 9 THEN '1-9' WHEN prior_price_record_count <= 29 THEN '10-29' ELSE '30+' END AS coverage_group,
  count(*) AS n, count(*) FILTER (WHERE discount_observed = 1) AS positives, round(avg(discount_observed), 9) AS positive_rate FROM modeling GROUP BY 1, 2"""))
def coverage_group_rates(spark, d):
    return modeling_of(spark, d).groupBy("window_year", rules.coverage_group(F.col("prior_price_record_count")).alias("coverage_group")).agg(
        F.count("*").alias("n"), F.count_if(F.col("discount_observed") == 1).alias("positives"),
        F.round(F.avg(F.col("discount_observed").cast("double")), 9).alias("positive_rate"))


@query("record_count_histogram", "A20", with_ctes(*FEATURE_CTES, body="""
SELECT b.bin, lower, upper, upper_closed, count(f.entity_id) AS n FROM (
  SELECT CAST(range AS INTEGER) AS bin, range * top / 10e0 AS lower, (range + 1) * top / 10e0 AS upper, range = 9 AS upper_closed
  FROM range(0, 10), (SELECT CAST(greatest(coalesce(max(prior_price_record_count), 1), 1) AS DOUBLE) AS top FROM feat)) b
LEFT JOIN feat f ON prior_price_record_count >= lower AND (prior_price_record_count < upper OR (upper_closed AND prior_price_record_count <= upper)) GROUP BY 1, 2, 3, 4"""))
def record_count_histogram(spark, d):
    rows = features_of(spark, d)
    top = float(max(rows.agg(F.max("prior_price_record_count")).first()[0] or 1, 1))
    return catalog.histogram(rows, "prior_price_record_count", [i * top / 10.0 for i in range(11)])


# ------------------------------------------------------------------ metrics over scored rows
def metric_ctes(keys: str, source: str = "scores") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""cnt AS (SELECT {k}p, count(*) FILTER (WHERE actual = 1) AS pos, count(*) FILTER (WHERE actual = 0) AS neg FROM {source} GROUP BY {k}p),
run AS (SELECT *, coalesce(sum(pos) OVER ({part}ORDER BY p DESC {frame}), 0) AS pb, coalesce(sum(neg) OVER ({part}ORDER BY p DESC {frame}), 0) AS nb FROM cnt),
agg AS (
  SELECT {k}CAST(sum(pos + neg) AS BIGINT) AS observations, CAST(sum(pos) AS BIGINT) AS actual_positive, CAST(sum(neg) AS BIGINT) AS actual_negative,
    CAST(sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p >= 0.5 THEN neg ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN p < 0.5 THEN pos ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN p < 0.5 THEN neg ELSE 0 END) AS BIGINT) AS tn,
    sum(neg * (pb + pos / 2e0)) AS s_auc, sum(pos * (pb + pos) / CAST(pb + pos + nb + neg AS DOUBLE)) AS s_ap,
    sum(pos * ((pb + pos) / CAST(pb + pos + nb + neg AS DOUBLE) + CASE WHEN pb + nb = 0 THEN 1 ELSE pb / CAST(pb + nb AS DOUBLE) END) / 2e0) AS s_trap,
    sum(pos * (1 - p) * (1 - p) + neg * p * p) AS s_brier,
    sum(-(pos * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) + neg * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))))) AS s_log,
    sum((pos + neg) * p) AS s_mean
  FROM run {f'GROUP BY {keys}' if keys else ''}),
metric AS (
  SELECT {k}observations, actual_positive, actual_negative, tp, fp, fn, tn, tp + fp AS predicted_positive,
    round(CASE WHEN actual_positive > 0 AND actual_negative > 0 THEN s_auc / (CAST(actual_positive AS DOUBLE) * actual_negative) END, 9) AS roc_auc,
    round(CASE WHEN actual_positive > 0 THEN s_ap / actual_positive END, 9) AS average_precision,
    round(CASE WHEN actual_positive > 0 THEN s_trap / actual_positive END, 9) AS pr_auc_trapezoidal,
    round(s_brier / observations, 9) AS brier_score, round(s_log / observations, 9) AS log_loss,
    round((tp + tn) / CAST(observations AS DOUBLE), 9) AS accuracy,
    round(CASE WHEN actual_positive > 0 AND actual_negative > 0 THEN (tp / CAST(actual_positive AS DOUBLE) + tn / CAST(actual_negative AS DOUBLE)) / 2 END, 9) AS balanced_accuracy,
    round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 9) AS "precision", round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 9) AS recall,
    round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 9) AS f1, round(s_mean / observations, 9) AS mean_probability FROM agg)"""


METRIC_CTES = (SCORES, metric_ctes("model"))


@query("confusion_metrics", "M11", with_ctes(*METRIC_CTES, body="""
SELECT model, observations, actual_positive, actual_negative, tp, fp, fn, tn, predicted_positive, accuracy, balanced_accuracy, "precision", recall, f1 FROM metric"""))
def confusion_metrics(spark, d):
    return metrics.evaluate(b.scores(spark, d), ["model"]).select(
        "model", "observations", "actual_positive", "actual_negative", "tp", "fp", "fn", "tn", "predicted_positive",
        "accuracy", "balanced_accuracy", "precision", "recall", "f1")


@query("probability_metrics", "M12", with_ctes(*METRIC_CTES, body="SELECT model, brier_score, log_loss, mean_probability, predicted_positive FROM metric"))
def probability_metrics(spark, d):
    return metrics.evaluate(b.scores(spark, d), ["model"]).select("model", "brier_score", "log_loss", "mean_probability", "predicted_positive")


@query("roc_auc", "M13", with_ctes(*METRIC_CTES, body="SELECT model, roc_auc FROM metric"))
def roc_auc(spark, d):
    return metrics.evaluate(b.scores(spark, d), ["model"]).select("model", "roc_auc")


@query("average_precision", "M14", with_ctes(*METRIC_CTES, body="SELECT model, average_precision, pr_auc_trapezoidal FROM metric"))
def average_precision(spark, d):
    return metrics.evaluate(b.scores(spark, d), ["model"]).select("model", "average_precision", "pr_auc_trapezoidal")


@query("curve_points", "M15", with_ctes(*METRIC_CTES, body="""
SELECT model, p AS threshold, CAST(pb + pos AS BIGINT) AS tp, CAST(nb + neg AS BIGINT) AS fp, round((pb + pos) / CAST(a.actual_positive AS DOUBLE), 9) AS tpr,
  round((nb + neg) / CAST(a.actual_negative AS DOUBLE), 9) AS fpr, round((pb + pos) / CAST(pb + pos + nb + neg AS DOUBLE), 9) AS "precision"
FROM run JOIN agg a USING (model)"""))
def curve_points(spark, d):
    return metrics.curve_points(b.scores(spark, d), ["model"])


BINS_SQL = """, bins AS (SELECT CAST(range AS INTEGER) AS bin, {lo} AS lower, {hi} AS upper FROM range(0, {n})),
assigned AS (SELECT s.*, b.bin FROM scores s JOIN bins b ON (b.bin = 0 OR s.p >= b.lower) AND (b.bin = {n} - 1 OR s.p < b.upper))"""


@query("calibration_bins", "M16", with_ctes(SCORES, body=BINS_SQL.format(lo="range / 10e0", hi="(range + 1) / 10e0", n=10) + """
SELECT m.model, b.bin, b.lower, b.upper, count(a.entity_id) AS observations, round(avg(a.p), 9) AS mean_probability, round(avg(a.actual), 9) AS positive_fraction
FROM (SELECT DISTINCT model FROM scores) m CROSS JOIN bins b LEFT JOIN assigned a ON a.model = m.model AND a.bin = b.bin GROUP BY 1, 2, 3, 4"""))
def calibration_bins(spark, d):
    return metrics.calibration(b.scores(spark, d), ["model"], TENTHS)


@query("calibration_error", "M16", with_ctes(SCORES, body=BINS_SQL.format(lo="range / 10e0", hi="(range + 1) / 10e0", n=10) + """
, pb AS (SELECT model, bin, count(*) AS n, sum(p) AS s, sum(actual) AS y FROM assigned GROUP BY 1, 2)
SELECT model, round(sum(abs(s - y)) / sum(n), 9) AS ece, round(sum(s) / sum(n), 9) AS mean_probability, round(CAST(sum(y) AS DOUBLE) / sum(n), 9) AS prevalence FROM pb GROUP BY 1"""))
def calibration_error(spark, d):
    return metrics.calibration_error(b.scores(spark, d), ["model"], TENTHS)


@query("reliability_table", "M17", with_ctes(SCORES, body=BINS_SQL.format(lo="range * 0.2e0", hi="(range + 1) * 0.2e0", n=5) + """
SELECT a.model, a.bin, b.lower, b.upper, count(*) AS observations, round(avg(p), 9) AS mean_probability, round(avg(actual), 9) AS positive_fraction
FROM assigned a JOIN bins b USING (bin) GROUP BY 1, 2, 3, 4"""))
def reliability_table(spark, d):
    return metrics.calibration(b.scores(spark, d), ["model"], FIFTHS, dense=False)


SEGMENT_SQL = """seg AS (
  SELECT model, p, actual, 'toxicity' AS family, CASE WHEN toxic = 1 THEN 'present' ELSE 'none' END AS segment FROM scores
  UNION ALL SELECT model, p, actual, 'language', lang FROM scores
  UNION ALL SELECT model, p, actual, 'density', CASE WHEN n_chars // 500 = 0 THEN '0' WHEN n_chars // 500 <= 9 THEN '1-9' WHEN n_chars // 500 <= 29 THEN '10-29' ELSE '30+' END FROM scores
  UNION ALL SELECT model, p, actual, 'source', source FROM scores)"""


@query("subgroup_metrics", "M18", with_ctes(SCORES, SEGMENT_SQL, metric_ctes("model, family, segment", "seg"), body="SELECT * FROM metric"))
def subgroup_metrics(spark, d):
    rows = metrics.by_segments(b.scores(spark, d), {
        "toxicity": F.when(F.col("toxic") == 1, "present").otherwise("none"), "language": F.col("lang"),
        "density": rules.coverage_group(F.floor(F.col("n_chars") / 500)), "source": F.col("source")})
    return metrics.evaluate(rows, ["model", "family", "segment"])


@query("model_selection", "M19", with_ctes(*METRIC_CTES, body="""
SELECT CAST(row_number() OVER w AS INTEGER) AS place, model, row_number() OVER w = 1 AS selected FROM metric
WINDOW w AS (ORDER BY average_precision DESC, brier_score, CASE model WHEN 'short_scale' THEN 0 ELSE 1 END)"""))
def model_selection(spark, d):
    return metrics.choose_model(metrics.evaluate(b.scores(spark, d), ["model"]), ["short_scale", "long_scale"])


STAGE_SQL = """staged AS (SELECT *, unnest(CASE entity_id % 3 WHEN 0 THEN ['development_training', 'final_training'] WHEN 1 THEN ['development_validation', 'final_training'] ELSE ['held_out_test'] END) AS stage FROM scores)"""
STAGES = ["development_training", "development_validation", "final_training", "held_out_test"]


@query("temporal_stability", "M20", with_ctes(SCORES, STAGE_SQL, metric_ctes("model, stage", "staged"), body="SELECT model, " + ", ".join(
    f"max(average_precision) FILTER (WHERE stage = '{s}') AS {s}" for s in STAGES) + " FROM metric GROUP BY 1"))
def temporal_stability(spark, d):
    rows = prepare.chronological_roles(b.scores(spark, d).withColumn("window_year", (F.col("entity_id") % 3).cast("int")), 0, 1, 2)
    return metrics.evaluate(rows, ["model", "role"]).groupBy("model").pivot("role", STAGES).agg(F.max("average_precision"))


@query("spearman_scores", "W12", with_ctes(SCORES, body="""
, r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2e0 AS rp,
  rank() OVER (PARTITION BY model ORDER BY n_chars) + (count(*) OVER (PARTITION BY model, n_chars) - 1) / 2e0 AS rn FROM scores)
SELECT model, count(*) AS n, round(corr(rp, rn), 9) AS rho FROM r GROUP BY 1""").replace("\n, r AS", ", r AS"))
def spearman_scores(spark, d):
    return prefix.spearman(b.scores(spark, d), ["model"], "p", "n_chars").withColumn("rho", F.round("rho", 9))


@query("average_ranks", "W12", """
SELECT l_quantity AS value, count(*) AS copies, (SELECT count(*) FROM lineitem) * 0e0 + min(rk) + (count(*) - 1) / 2e0 AS rank
FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS rk FROM lineitem) GROUP BY 1""")
def average_ranks(spark, d):
    counts = prefix.value_counts(b.table(spark, d, "lineitem").withColumn("all", F.lit(1)), ["all"], "l_quantity")
    return prefix.average_ranks(counts, ["all"]).drop("all")


@query("prediction_contract", "P21", with_ctes(SCORES, body="""
, broken AS (SELECT *, CASE WHEN entity_id % 40 = 3 THEN 1 - predicted ELSE predicted END AS pc FROM scores WHERE NOT (lang = 'en' AND toxic = 1))
SELECT 'duplicate_key' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'probability_range', count(*) FILTER (WHERE p < 0 OR p > 1) FROM broken
UNION ALL SELECT 'threshold_disagreement', count(*) FILTER (WHERE pc <> CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) FROM broken
UNION ALL SELECT 'missing_prediction', count(*) FILTER (WHERE lang = 'en' AND toxic = 1) FROM scores
UNION ALL SELECT 'unexpected_key', 0 UNION ALL SELECT 'label_mismatch', 0""").replace("\n, broken", ", broken"))
def prediction_contract(spark, d):
    rows = b.scores(spark, d)
    k = F.col("entity_id")
    broken = rows.where("NOT (lang = 'en' AND toxic = 1)").withColumn("predicted", F.when(k % 40 == 3, 1 - F.col("predicted")).otherwise(F.col("predicted")))
    expected = b.table(spark, d, "labels").join(b.table(spark, d, "documents").select("doc_id"), "doc_id") \
        .select(F.col("doc_id").alias("entity_id"), F.col("quality").alias("actual"))
    return metrics.validate_predictions(broken, expected, ["entity_id"])


def _summary_sql(v: str) -> str:
    return (f"round(avg({v}), 9) AS {v}_mean, round(stddev_pop({v}), 9) AS {v}_std, " + ", ".join(
        f"round(quantile_cont({v}, {f}), 9) AS {v}_{n}" for n, f in
        {"min": 0, "p05": .05, "q25": .25, "median": .5, "q75": .75, "p95": .95, "max": 1}.items()))


@query("score_summary", "A23", with_ctes(SCORES, body=f"""
SELECT model, lang, count(*) AS n, count(*) FILTER (WHERE predicted = 1) AS predicted_positive, count(*) FILTER (WHERE predicted = 0) AS predicted_zero,
  round(avg(predicted), 9) AS positive_rate, {_summary_sql('p')}, {_summary_sql('n_chars')} FROM scores GROUP BY 1, 2"""))
def score_summary(spark, d):
    rows, keys = b.scores(spark, d), ["model", "lang"]
    return metrics.class_counts(rows, keys).join(metrics.score_summary(rows, keys, "p"), keys) \
        .join(metrics.score_summary(rows, keys, "n_chars"), keys)


@query("score_quantiles", "A23", with_ctes(SCORES, body="""
SELECT model, round(quantile_cont(p, 0), 9) AS q00, round(quantile_cont(p, 0.01), 9) AS q01, round(quantile_cont(p, 0.05), 9) AS q05,
  round(quantile_cont(p, 0.25), 9) AS q25, round(quantile_cont(p, 0.5), 9) AS q50, round(quantile_cont(p, 0.75), 9) AS q75,
  round(quantile_cont(p, 0.95), 9) AS q95, round(quantile_cont(p, 0.99), 9) AS q99, round(quantile_cont(p, 1), 9) AS q100 FROM scores GROUP BY 1"""))
def score_quantiles(spark, d):
    wanted = {f"q{f:02d}": f / 100 for f in (0, 1, 5, 25, 50, 75, 95, 99, 100)}
    q = prefix.quantiles(b.scores(spark, d), ["model"], "p", wanted)
    return q.select("model", *[F.round(c, 9).alias(c) for c in wanted])


@query("score_histogram", "A20", with_ctes(SCORES, body="""
SELECT b.bin, lower, upper, upper_closed, count(p) AS n FROM (
  SELECT CAST(range AS INTEGER) AS bin, range / 20e0 AS lower, (range + 1) / 20e0 AS upper, range = 19 AS upper_closed FROM range(0, 20)) b
LEFT JOIN scores ON p >= lower AND (p < upper OR (upper_closed AND p <= upper)) GROUP BY 1, 2, 3, 4"""))
def score_histogram(spark, d):
    return catalog.histogram(b.scores(spark, d), "p", [i / 20 for i in range(21)])


@query("top_scores", "K1", with_ctes(SCORES, body="""
SELECT entity_id, p, n_chars FROM scores WHERE model = 'short_scale' ORDER BY p DESC, entity_id LIMIT 10"""))
def top_scores(spark, d):
    return metrics.top_scores(b.scores(spark, d).where("model = 'short_scale'")).select("entity_id", "p", "n_chars")


@query("bottom_predicted_zero", "K1", with_ctes(SCORES, body="""
SELECT entity_id, p, n_chars FROM scores WHERE model = 'short_scale' AND predicted = 0 ORDER BY p, entity_id LIMIT 10"""))
def bottom_predicted_zero(spark, d):
    return metrics.top_scores(b.scores(spark, d).where("model = 'short_scale' AND predicted = 0"), highest=False).select("entity_id", "p", "n_chars")


@query("observed_and_predicted_rates", "M26 U1", with_ctes(*MODEL_CTES, SCORES, body="""
SELECT window_year, 'observed_labels' AS kind, count(*) AS n, count(*) FILTER (WHERE discount_observed = 1) AS positives, round(avg(discount_observed), 9) AS positive_rate
FROM lab WHERE model_eligible GROUP BY 1
UNION ALL SELECT 2001, 'model_predictions', count(*), count(*) FILTER (WHERE predicted = 1), round(avg(predicted), 9) FROM scores WHERE model = 'long_scale'"""))
def observed_and_predicted_rates(spark, d):
    rate = lambda c: [F.count("*").alias("n"), F.count_if(F.col(c) == 1).alias("positives"),
                      F.round(F.avg(F.col(c).cast("double")), 9).alias("positive_rate")]
    seen = labels_of(spark, d).where("model_eligible").groupBy("window_year").agg(F.lit("observed_labels").alias("kind"), *rate("discount_observed"))
    new = b.scores(spark, d).where("model = 'long_scale'").agg(F.lit("model_predictions").alias("kind"), *rate("predicted")) \
        .withColumn("window_year", F.lit(2001))
    return seen.unionByName(new)


@query("score_set_comparison", "M26", with_ctes(SCORES, body="""
, g AS (SELECT *, CASE WHEN n_chars // 500 = 0 THEN '0' WHEN n_chars // 500 <= 9 THEN '1-9' WHEN n_chars // 500 <= 29 THEN '10-29' ELSE '30+' END AS coverage_group FROM scores)
SELECT model, coverage_group, count(*) AS n, count(*) FILTER (WHERE predicted = 1) AS predicted_positive, count(*) FILTER (WHERE predicted = 0) AS predicted_zero,
  round(avg(predicted), 9) AS positive_rate, round(avg(p), 9) AS mean_probability FROM g GROUP BY 1, 2""").replace("\n, g AS", ", g AS"))
def score_set_comparison(spark, d):
    rows = b.scores(spark, d).withColumn("coverage_group", rules.coverage_group(F.floor(F.col("n_chars") / 500)))
    keys = ["model", "coverage_group"]
    return metrics.class_counts(rows, keys).join(rows.groupBy(*keys).agg(F.round(F.avg("p"), 9).alias("mean_probability")), keys)
