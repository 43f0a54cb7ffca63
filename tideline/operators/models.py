"""Classifiers on MLlib: fitting, long-form scoring, importances, ablation, permutation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.operators import metrics, prefix, prepare, sampling
from tideline.operators.features import COVERAGE_PREDICTORS, PREDICTORS
from tideline.session import durable, forget

# Model settings, chosen before any evaluation.
LOGISTIC = {"C": 1.0, "tol": 1e-4, "maxIter": 2000}
FOREST = {"numTrees": 200, "maxDepth": 4, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt", "seed": 42}
BOOSTED = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8,
           "featureSubsetStrategy": "0.8", "seed": 42}
BUCKET_ROWS = 1 << 15  # rows of a repeat that are ranked together
TASK_ROWS = 20_000  # received values that a task scores, while there are partitions enough
REPEATS_HELD = 60  # repeats that one long holds a bit for
MODEL_ORDER = ("prior_baseline", "logistic_regression", "random_forest", "boosted_trees")


@dataclass(frozen=True)
class Fitted:
    """A fitted classifier with the training statistics its inputs need."""

    name: str
    model: object
    features: tuple[str, ...]
    medians: DataFrame
    scale: DataFrame | None = None
    prior: float | None = None

    def inputs(self, rows: DataFrame) -> DataFrame:
        if self.prior is not None:
            return rows
        out = prepare.impute(rows, self.medians, self.features)
        if self.scale is not None:
            out = prepare.standardise(out, self.scale, self.features)
        return out.withColumn("x", F.array(*[F.col(c) for c in self.features]))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``p`` and, for linear models, ``decision_score``."""
        if self.prior is not None:
            return rows.withColumn("p", F.lit(self.prior)).withColumn("decision_score", F.lit(None).cast("double"))
        return self.predict_inputs(self.inputs(rows))

    def predict_inputs(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(rows.withColumn("features", array_to_vector("x")))
        score = vector_to_array("rawPrediction")[1] if self.scale is not None else F.lit(None).cast("double")
        return scored.withColumn("p", vector_to_array("probability")[1]).withColumn("decision_score", score) \
            .drop("features", "rawPrediction", "probability", "prediction", "x")


class Training:
    """Training rows with what models of every kind take from them, each written once, at its first reader."""

    def __init__(self, rows: DataFrame, label: str = "discount_observed", names: Sequence[str] = PREDICTORS):
        self.rows, self.label, self.names = rows, label, tuple(names)

    @cached_property
    def medians(self) -> DataFrame:
        return durable(prepare.training_medians(self.rows, self.names))

    @cached_property
    def scale(self) -> DataFrame:
        return durable(prepare.scaling(self._filled(), self.names))

    @cached_property
    def plain(self) -> DataFrame:
        return self._vectors(self._filled())

    @cached_property
    def standardised(self) -> DataFrame:
        return self._vectors(prepare.standardise(self._filled(), self.scale, self.names))

    def _filled(self) -> DataFrame:
        return prepare.impute(self.rows, self.medians, self.names)

    def _vectors(self, ready: DataFrame) -> DataFrame:
        return durable(ready.select(F.col(self.label).cast("double").alias("label"),
                                    array_to_vector(F.array(*[F.col(c) for c in self.names])).alias("features")))


def fit_all(kinds: Sequence[str], train: DataFrame, label: str = "discount_observed", names: Sequence[str] = PREDICTORS) -> list[Fitted]:
    """Fit several classifiers on the same training rows, which are prepared once for all."""
    training = Training(train, label, names)
    return [fit(k, train, label, names, training=training) for k in kinds]


def fit(kind: str, train: DataFrame, label: str = "discount_observed", names: Sequence[str] = PREDICTORS,
        title: str | None = None, training: Training | None = None) -> Fitted:
    """Fit one classifier on training rows only; statistics come from the same rows (``training``, if prepared already)."""
    names = tuple(names)
    training = training or Training(train, label, names)
    medians = training.medians
    if kind == "prior_baseline":
        rate = prepare.prior_rate(train, label).first()["prior"]
        return Fitted(title or kind, None, names, medians, prior=float(rate))
    scale = training.scale if kind == "logistic_regression" else None
    data = training.plain if scale is None else training.standardised
    if kind == "logistic_regression":
        n = data.count()
        model = LogisticRegression(regParam=1.0 / (LOGISTIC["C"] * n), elasticNetParam=0.0, standardization=False,
                                   tol=LOGISTIC["tol"], maxIter=LOGISTIC["maxIter"]).fit(data)
        if model.summary.totalIterations >= LOGISTIC["maxIter"]:
            raise ValueError("logistic regression did not converge")
    elif kind == "random_forest":
        # More histogram memory per pass means fewer passes over the data; the trees are the same.
        model = RandomForestClassifier(**FOREST, maxMemoryInMB=1024).fit(data)
    elif kind == "boosted_trees":
        model = GBTClassifier(**BOOSTED).fit(data)
    else:
        raise ValueError(f"unknown model {kind}")
    return Fitted(title or kind, model, names, medians, scale)


def score(models: Sequence[Fitted], rows: DataFrame, label: str | None = "discount_observed") -> DataFrame:
    """Long-form scores of several models: inclusive 0.5 threshold, one row per key and model."""
    out = None
    for m in models:
        actual = F.col(label).cast("int") if label else F.lit(None).cast("int")
        part = m.predict(rows).select(
            "entity_id", "window_year", F.lit(m.name).alias("model"), actual.alias("actual"), "p",
            (F.col("p") >= metrics.THRESHOLD).cast("int").alias("predicted"), "decision_score")
        out = part if out is None else out.unionByName(part)
    return out


def importances(models: Sequence[Fitted], stage: str) -> DataFrame:
    """Coefficients and tree importances, long form. One row per predictor and model."""
    spark = models[0].medians.sparkSession
    rows = []
    for m in models:
        if m.prior is not None:
            continue
        linear = m.scale is not None
        values = (m.model.coefficients if linear else m.model.featureImportances).toArray()
        kind = "standardised log-odds coefficient" if linear else "impurity importance"
        rows += [(stage, m.name, f, float(v), kind) for f, v in zip(m.features, values)]
    return spark.createDataFrame(rows, "stage string, model string, feature string, value double, definition string")


def permutation_importance(fitted: Fitted | Sequence[Fitted], rows: DataFrame, label: str = "discount_observed", repeats: int = 20,
                           seed: int = 42, digits: int = 9) -> DataFrame:
    """Drop in ROC-AUC when one predictor is shuffled, over several repeats, for one model or several with the same inputs.

    The shuffle is a join: row number i receives the value of the row whose hash rank is i for
    that predictor and repeat. Both ranks use hash buckets, so no task sorts a whole predictor. Only
    single values are shuffled, one predictor at a time: what its repeats wrote is deleted before the next one's.
    A row that receives one value in several repeats is scored once for them.
    """
    fitted = [fitted] if isinstance(fitted, Fitted) else list(fitted)
    first = fitted[0]
    if any((m.features, m.medians, m.scale) != (first.features, first.medians, first.scale) for m in fitted):
        raise ValueError("models must have the same inputs")
    base = first.inputs(rows).select("entity_id", "window_year", F.col(label).cast("int").alias("actual"), "x") \
        .withColumn("_all", F.lit(1)) \
        .withColumn("priority", F.sha2(F.concat_ws("|", F.lit(seed), "entity_id", "window_year"), 256))
    order = [F.col("priority"), F.col("entity_id"), F.col("window_year")]
    numbered = durable(prefix.ranked(base, ["_all"], order, "i").select("i", "actual", "x"))
    full = metrics.evaluate(_long_probabilities(fitted, numbered), ["model"]).select("model", F.col("roc_auc").alias("full"))
    size = numbered.count()
    # Scoring takes long for few bytes, so its tasks are counted by rows.
    tasks = min(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), size * repeats // TASK_ROWS + 1)
    parts = []
    for f, name in enumerate(first.features):
        shuffled = durable(_shuffled(numbered, size, f, repeats, seed))
        received = _received(shuffled, tasks)
        changed = F.array(*[F.col("value") if k == f else F.col("x")[k] for k in range(len(first.features))])
        replaced = numbered.join(received, "i").withColumn("x", changed)
        each = _long_probabilities(fitted, replaced, "block", "held")
        auc = metrics.evaluate(each.withColumn("repeat", _repeats(F.col("block"), F.col("held"))), ["model", "repeat"])
        parts.append(durable(auc.select("model", F.lit(name).alias("feature"), "roc_auc")))
        forget(shuffled, auc)
    drop = reduce(DataFrame.unionByName, parts).join(full, "model").withColumn("drop", F.col("full") - F.col("roc_auc"))
    return drop.groupBy("feature", "model").agg(
        F.round(F.avg("drop"), digits).alias("importance_mean"), F.round(F.stddev_pop("drop"), digits).alias("importance_std"),
        F.count("*").alias("repeats")).select("feature", "importance_mean", "importance_std", "repeats", "model")


def _shuffled(numbered: DataFrame, size: int, f: int, repeats: int, seed: int) -> DataFrame:
    """(i, repeat, value): what each row of ``numbered``, of ``size`` rows, receives of predictor number ``f``.

    Hashes are uniform, so their first bits alone cut each repeat into even buckets; ranks inside them follow the buckets before.
    """
    # The first 60 bits of the hash order the rows as the whole hash does, in an eighth of its size.
    priority = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit(f), "repeat", "i"), 256), 1, 15), 16, 10).cast("bigint")
    bits = max(0, (size // BUCKET_ROWS).bit_length())
    donors = numbered.select("i", F.col("x")[f].alias("value"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")) \
        .withColumn("priority", priority).withColumn("bucket", F.shiftright("priority", 60 - bits))
    before = W.partitionBy("repeat").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = donors.groupBy("repeat", "bucket").agg(F.count("*").alias("n")).select(
        "repeat", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("repeat", "bucket").orderBy("priority", "i"))
    return donors.withColumn("place", place).join(offsets, ["repeat", "bucket"]).select(
        (F.col("offset") + F.col("place")).alias("i"), "repeat", "value")


def _received(shuffled: DataFrame, tasks: int) -> DataFrame:
    """(i, value, block, held): each distinct value that row i receives, with a bit for each repeat of a block of ``REPEATS_HELD``."""
    at = F.col("repeat") - 1
    return shuffled.select("i", "value", F.floor(at / REPEATS_HELD).alias("block"), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (at % REPEATS_HELD).cast("int")).alias("bit")).repartition(tasks, "i") \
        .groupBy("i", "value", "block").agg(F.bit_or("bit").alias("held"))


def _repeats(block: Column, held: Column) -> Column:
    """One row for each repeat of ``_received``."""
    numbers = F.filter(F.sequence(F.lit(0), F.lit(REPEATS_HELD - 1)), lambda k: F.getbit(held, k) == 1)
    return F.explode(F.transform(numbers, lambda k: (block * REPEATS_HELD + k + 1).cast("int")))


def _long_probabilities(fitted: Sequence[Fitted], rows: DataFrame, *keys: str) -> DataFrame:
    """``model, p`` of each row of inputs ``x`` from each model, in one pass over the rows."""
    for n, m in enumerate(fitted):
        rows = m.predict_inputs(rows.withColumn("_x", F.col("x"))).withColumnsRenamed({"p": f"_p{n}", "_x": "x"}).drop("decision_score")
    each = F.array(*[F.struct(F.lit(m.name).alias("model"), F.col(f"_p{n}").alias("p")) for n, m in enumerate(fitted)])
    return rows.select(*keys, "actual", F.inline(each))


def coverage_ablation(train: DataFrame, valid: DataFrame, label: str = "discount_observed") -> DataFrame:
    """Metrics of a model on availability predictors only, next to the full one."""
    full = fit("logistic_regression", train, label)
    only = fit("logistic_regression", train, label, COVERAGE_PREDICTORS, "coverage_only_logistic")
    return metrics.evaluate(score([full, only], valid, label), ["model"])


def refit_rows(fitted: Fitted, features: DataFrame, coverage_group: Column) -> DataFrame:
    """Scores for a later window with the availability columns a reader needs beside them."""
    missing = prepare.missing_names(fitted.features)
    context = features.select("entity_id", "window_year", "prior_price_record_count", "prior_discount_count",
                              coverage_group.alias("coverage_group"), "has_prior_price_history",
                              F.size(missing).alias("missing_feature_count"), F.array_join(missing, ";").alias("missing_features"))
    return score([fitted], features, None).drop("actual", "decision_score").join(context, ["entity_id", "window_year"])
