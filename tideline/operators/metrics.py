"""Tie-correct classification metrics from distinct scores.

Rows are first aggregated to (group, score) with positive and negative counts. Every metric then
follows from that table and its running totals, which use the bucketed prefix sums, so neither a
large model nor a large subgroup is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators import prefix

THRESHOLD = 0.5
EPSILON = 2.220446049250313e-16  # fixed value: probabilities are kept this far from 0 and 1


def score_counts(predictions: DataFrame, keys: Sequence[str], p: str = "p", actual: str = "actual") -> DataFrame:
    return predictions.groupBy(*keys, F.col(p).alias("p")).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg"))


def running(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add true and false positives strictly above each distinct score."""
    return prefix.prefix_sums(counts, keys, [-F.col("p")], {"pos": F.col("pos"), "neg": F.col("neg")})


def _ratio(num: Column, den: Column) -> Column:
    return num / F.when(den != 0, den)


def evaluate(predictions: DataFrame, keys: Sequence[str], digits: int = 9) -> DataFrame:
    """All metrics per key; undefined ones are null, never zero."""
    rows = running(score_counts(predictions, keys), keys)
    c = F.col
    tp, fp = c("pos_before") + c("pos"), c("neg_before") + c("neg")
    precision = tp / (tp + fp)
    before = c("pos_before") + c("neg_before")
    previous = F.when(before == 0, F.lit(1.0)).otherwise(c("pos_before") / before)
    hit = c("p") >= THRESHOLD
    clipped = F.greatest(F.lit(EPSILON), F.least(F.lit(1.0 - EPSILON), c("p")))
    n = c("pos") + c("neg")
    s = rows.groupBy(*keys).agg(
        F.sum(n).alias("_rows"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"),
        F.sum(F.when(hit, c("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, c("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(c("pos"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(c("neg"))).alias("tn"),
        F.sum(c("neg") * (c("pos_before") + c("pos") / 2.0)).alias("_auc"),
        F.sum(c("pos") * precision).alias("_ap"), F.sum(c("pos") * (precision + previous) / 2.0).alias("_trap"),
        F.sum(c("pos") * (1 - c("p")) * (1 - c("p")) + c("neg") * c("p") * c("p")).alias("_brier"),
        F.sum(-(c("pos") * F.ln(clipped) + c("neg") * F.ln(1 - clipped))).alias("_log"),
        F.sum(n * c("p")).alias("_mean"))
    both = (c("_pos") > 0) & (c("_neg") > 0)
    has_pos = c("_pos") > 0
    out = {
        "roc_auc": F.when(both, c("_auc") / (c("_pos").cast("double") * c("_neg"))),
        "average_precision": F.when(has_pos, c("_ap") / c("_pos")),
        "pr_auc_trapezoidal": F.when(has_pos, c("_trap") / c("_pos")),
        "brier_score": c("_brier") / c("_rows"), "log_loss": c("_log") / c("_rows"),
        "accuracy": (c("tp") + c("tn")) / c("_rows"),
        "balanced_accuracy": F.when(both, (c("tp") / c("_pos") + c("tn") / c("_neg")) / 2.0),
        "precision": _ratio(c("tp"), c("tp") + c("fp")), "recall": _ratio(c("tp"), c("tp") + c("fn")),
        "f1": _ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        "mean_probability": c("_mean") / c("_rows"),
    }
    return s.select(*keys, c("_rows").alias("observations"), c("_pos").alias("actual_positive"), c("_neg").alias("actual_negative"),
                    "tp", "fp", "fn", "tn", (c("tp") + c("fp")).alias("predicted_positive"),
                    *[F.round(v, digits).alias(k) for k, v in out.items()])


def curve_points(predictions: DataFrame, keys: Sequence[str], digits: int = 9) -> DataFrame:
    """ROC and precision-recall points at every distinct threshold."""
    counts = score_counts(predictions, keys)
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    rows = prefix.join_on(running(counts, keys), totals, list(keys))
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    return rows.select(*keys, F.col("p").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                       F.round(_ratio(tp, F.col("_P")), digits).alias("tpr"), F.round(_ratio(fp, F.col("_N")), digits).alias("fpr"),
                       F.round(tp / (tp + fp), digits).alias("precision"))


def bin_index(p: Column, edges: Sequence[float]) -> Column:
    """Bin of a probability: left-closed, last bin closed on both sides."""
    last = len(edges) - 2
    expr = None
    for i in range(last):
        expr = F.when(p < edges[i + 1], i) if expr is None else expr.when(p < edges[i + 1], i)
    return expr.otherwise(last) if expr is not None else F.lit(0)


def calibration(predictions: DataFrame, keys: Sequence[str], edges: Sequence[float], *, dense: bool = True,
                digits: int = 9) -> DataFrame:
    """Mean score and observed rate per bin; with ``dense`` empty bins are kept."""
    bins = len(edges) - 1
    counts = score_counts(predictions, keys).withColumn("bin", bin_index(F.col("p"), edges))
    n = F.col("pos") + F.col("neg")
    per_bin = counts.groupBy(*keys, "bin").agg(
        F.sum(n).alias("observations"), F.round(F.sum(n * F.col("p")) / F.sum(n), digits).alias("mean_probability"),
        F.round(F.sum("pos") / F.sum(n), digits).alias("positive_fraction"))
    names = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("lower"),
                               F.lit(float(edges[i + 1])).alias("upper")) for i in range(bins)])
    if not dense:
        edge = names[F.col("bin")]
        return per_bin.select(*keys, "bin", edge["lower"].alias("lower"), edge["upper"].alias("upper"),
                              "observations", "mean_probability", "positive_fraction")
    grid = predictions.select(*keys).distinct().select("*", F.inline(names))
    return prefix.join_on(grid, per_bin, [*keys, "bin"], "left").select(
        *keys, "bin", "lower", "upper", F.coalesce("observations", F.lit(0)).alias("observations"),
        "mean_probability", "positive_fraction")


def calibration_error(predictions: DataFrame, keys: Sequence[str], edges: Sequence[float], digits: int = 9) -> DataFrame:
    """Expected calibration error and overall means per key."""
    counts = score_counts(predictions, keys).withColumn("bin", bin_index(F.col("p"), edges))
    n = F.col("pos") + F.col("neg")
    per_bin = counts.groupBy(*keys, "bin").agg(F.sum(n).alias("n"), F.sum(n * F.col("p")).alias("s"), F.sum("pos").alias("y"))
    return per_bin.groupBy(*keys).agg(
        F.round(F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n"), digits).alias("ece"),
        F.round(F.sum("s") / F.sum("n"), digits).alias("mean_probability"),
        F.round(F.sum("y") / F.sum("n"), digits).alias("prevalence"))


def by_segments(predictions: DataFrame, families: Mapping[str, Column]) -> DataFrame:
    """Each row once per family with its segment; null segments are left out."""
    entry = lambda name, seg: F.struct(F.lit(name).alias("family"), seg.alias("segment"))
    return predictions.select("*", F.inline(F.array(*[entry(n, s) for n, s in families.items()]))) \
        .where(F.col("segment").isNotNull())


def feature_families(missing_features: Column) -> dict[str, Column]:
    """The four subgroup families of a feature row: history, discounts, missingness, density."""
    from tideline.functions import rules

    flag = lambda c, no, yes: F.when(c, yes).otherwise(no)
    return {
        "prior_price_history": flag(F.col("has_prior_price_history") == 1, "none", "present"),
        "prior_discount_history": flag(F.col("has_prior_discount_observation") == 1, "none", "present"),
        "feature_missingness": flag(missing_features > 0, "complete", "any_missing"),
        "price_observation_density": rules.coverage_group(F.col("prior_price_record_count"))}


def choose_model(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ranking by average precision, then lower Brier score, then the fixed order."""
    place = F.coalesce(*[F.when(F.col("model") == m, i) for i, m in enumerate(order)])
    ranked = F.array_sort(F.collect_list(F.struct(
        (-F.col("average_precision")).alias("a"), F.col("brier_score").alias("b"), place.alias("c"), F.col("model").alias("m"))))
    # One row per candidate model: a handful by construction.
    return metrics.agg(ranked.alias("r")).select(F.posexplode("r").alias("i", "e")).select(
        (F.col("i") + 1).alias("place"), F.col("e.m").alias("model"), (F.col("i") == 0).alias("selected"))


def validate_predictions(predictions: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prediction contract violations per rule, including keys and labels of the evaluation rows."""
    c = F.col
    per = predictions.groupBy(*keys, "model").agg(F.count("*").alias("_n"), F.max("p").alias("p"),
                                                  F.max("predicted").alias("predicted"), F.max("actual").alias("actual"))
    names = F.array_sort(F.collect_set("model"))  # candidate models: a handful
    models = predictions.agg(names).scalar()
    want = expected.select(*keys, c("actual").alias("_y"), F.explode(models).alias("model"))
    both = per.join(want, [*keys, "model"], "full_outer")
    return both.agg(F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(F.coalesce(x, F.lit(False))).alias("violations")) for n, x in {
        "duplicate_key": c("_n") > 1, "probability_range": ~c("p").between(0.0, 1.0),
        "threshold_disagreement": c("predicted") != (c("p") >= THRESHOLD).cast("int"),
        "missing_prediction": c("_n").isNull(), "unexpected_key": c("_y").isNull() & c("_n").isNotNull(),
        "label_mismatch": c("_y") != c("actual")}.items()]).alias("a")).select(F.inline("a"))


def score_summary(rows: DataFrame, keys: Sequence[str], value: str, digits: int = 9, name: str | None = None) -> DataFrame:
    """min, p05, quartiles, p95, max, mean and population std of one measure per key."""
    name = name or value
    base = rows.groupBy(*keys).agg(F.round(F.avg(value), digits).alias(f"{name}_mean"),
                                   F.round(F.stddev_pop(value), digits).alias(f"{name}_std"))
    q = prefix.quantiles(rows, keys, value, {"min": 0.0, "p05": .05, "q25": .25, "median": .5, "q75": .75, "p95": .95, "max": 1.0})
    return prefix.join_on(base, q, list(keys)).select(*keys, f"{name}_mean", f"{name}_std", *[
        F.round(k, digits).alias(f"{name}_{k}") for k in ("min", "p05", "q25", "median", "q75", "p95", "max")])


def class_counts(rows: DataFrame, keys: Sequence[str], digits: int = 9) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("predicted") == 1).alias("predicted_positive"),
        F.count_if(F.col("predicted") == 0).alias("predicted_zero"),
        F.round(F.avg(F.col("predicted").cast("double")), digits).alias("positive_rate"))


def top_scores(rows: DataFrame, n: int = 10, highest: bool = True, key: str = "entity_id") -> DataFrame:
    return rows.orderBy(F.desc("p") if highest else F.asc("p"), key).limit(n)
