"""Model preparation: splits, training-only statistics, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators import prefix
from tideline.operators.features import PREDICTORS, melt


def chronological_roles(rows: DataFrame, first: int, second: int, last: int) -> DataFrame:
    """Each row once per chronological role it plays."""
    y = F.col("window_year")
    roles = F.array_compact(F.array(
        F.when(y == first, F.lit("development_training")), F.when(y == second, F.lit("development_validation")),
        F.when(y.isin(first, second), F.lit("final_training")), F.when(y == last, F.lit("held_out_test"))))
    return rows.select("*", F.explode(roles).alias("role"))


def split_summary(rows: DataFrame, label: str) -> DataFrame:
    """Rows, entities and class counts per role; distinct entities from a two-step count."""
    y = F.col(label)
    per = rows.groupBy("role", "entity_id").agg(F.count("*").alias("n"), F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("z"))
    return per.groupBy("role").agg(F.sum("n").alias("rows"), F.count("*").alias("entities"),
                                   F.sum("p").alias("positives"), F.sum("z").alias("zeros"))


def role_overlap(rows: DataFrame, left: str, right: str) -> DataFrame:
    a = rows.where(F.col("role") == left).select("entity_id").distinct()
    b = rows.where(F.col("role") == right).select("entity_id")
    return a.join(b, "entity_id", "left_semi").agg(F.count("*").alias("shared_entities"))


def training_medians(train: DataFrame, names: Sequence[str] = PREDICTORS) -> DataFrame:
    """Exact median, non-null count and row count per feature of the training rows."""
    long = melt(train, [], names)
    base = long.groupBy("feature").agg(F.count("*").alias("rows"), F.count("value").alias("observed"))
    q = prefix.quantiles(long, ["feature"], "value", {"median": .5})
    return base.join(q, "feature", "left")


def _feature_map(table: DataFrame, value: str) -> Column:
    # One entry per feature: bounded by the predictor list.
    return table.agg(F.map_from_entries(F.collect_list(F.struct("feature", value)))).scalar()


def impute(rows: DataFrame, medians: DataFrame, names: Sequence[str] = PREDICTORS, *, empty: str = "stop") -> DataFrame:
    """Fill nulls with training medians. ``empty`` decides for all-missing training columns:
    ``stop`` fails the job, ``zero`` keeps a structural zero, ``drop`` is done by the caller."""
    values = rows.withColumn("_med", _feature_map(medians, "median"))
    fallback = F.lit(0.0) if empty == "zero" else F.raise_error(F.lit("a training column is entirely missing")).cast("double")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.when(F.col("_med")[c].isNotNull(), F.col("_med")[c]).otherwise(fallback))
              for c in names}
    return values.withColumns(filled).drop("_med")


def observed_features(medians: DataFrame) -> DataFrame:
    """Features to keep or exclude under the rule for entirely missing training columns."""
    return medians.select("feature", "rows", "observed", (F.col("observed") > 0).alias("keep"))


def scaling(imputed_train: DataFrame, names: Sequence[str] = PREDICTORS) -> DataFrame:
    """Training mean and population standard deviation per feature."""
    return melt(imputed_train, [], names).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("variance"))


def standardise(rows: DataFrame, stats: DataFrame, names: Sequence[str] = PREDICTORS) -> DataFrame:
    """Centre and scale; a constant training column is only centred."""
    v = rows.withColumn("_m", _feature_map(stats, "mean")).withColumn("_s", _feature_map(stats, "std"))
    return v.withColumns({c: (F.col(c) - F.col("_m")[c]) / F.when(F.col("_s")[c] > 0, F.col("_s")[c]).otherwise(1.0)
                          for c in names}).drop("_m", "_s")


def prior_rate(train: DataFrame, label: str) -> DataFrame:
    return train.agg(F.avg(F.col(label).cast("double")).alias("prior"), F.count("*").alias("training_rows"))


# ------------------------------------------------------------------ missing values
def missing_names(names: Sequence[str] = PREDICTORS) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in names]))


def missingness(rows: DataFrame, names: Sequence[str] = PREDICTORS, digits: int = 6) -> DataFrame:
    """Per feature and year (null year = all): rows, missing, observed range and distinct values."""
    long = melt(rows, ["window_year"], names)
    cells = long.groupBy("window_year", "feature", "value").agg(F.count("*").alias("w"))
    return cells.rollup("feature", "window_year").agg(
        F.sum("w").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("w"))), F.lit(0)).alias("missing"),
        F.round(F.min("value"), digits).alias("low"), F.round(F.max("value"), digits).alias("high")) \
        .where(F.col("feature").isNotNull()) \
        .withColumn("missing_percent", F.round(100.0 * F.col("missing") / F.col("rows"), digits))


def feature_statistics(rows: DataFrame, names: Sequence[str] = PREDICTORS, digits: int = 6) -> DataFrame:
    """Missing, range, exact median and distinct values per feature."""
    long = melt(rows, [], names)
    per_value = long.groupBy("feature", "value").agg(F.count("*").alias("w"))
    base = per_value.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("w"))), F.lit(0)).alias("missing"),
        F.round(F.min("value"), digits).alias("low"), F.round(F.max("value"), digits).alias("high"),
        F.count("value").alias("distinct_values"))
    q = prefix.quantiles_of_counts(per_value.where("value IS NOT NULL").select("feature", "value", F.col("w").alias("copies")),
                                   ["feature"], {"median": .5})
    return base.join(q, "feature", "left").select("feature", "missing", "low", "high", "distinct_values",
                                                  F.round("median", digits).alias("median"))


def missing_patterns(rows: DataFrame, names: Sequence[str] = PREDICTORS) -> DataFrame:
    return rows.select(F.array_join(missing_names(names), ";").alias("pattern")).groupBy("pattern").agg(
        F.count("*").alias("rows")).withColumn("missing_features", F.when(F.col("pattern") == "", 0)
                                               .otherwise(F.size(F.split("pattern", ";"))))


def missingness_by_class(rows: DataFrame, cls: str, names: Sequence[str] = PREDICTORS, digits: int = 6) -> DataFrame:
    long = melt(rows, [cls], names)
    return long.groupBy("feature", cls).agg(
        F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.round(100.0 * F.count_if(F.col("value").isNull()) / F.count("*"), digits).alias("missing_percent"))


def availability(rows: DataFrame, train: DataFrame, names: Sequence[str] = PREDICTORS, digits: int = 6) -> DataFrame:
    """Per feature: missing values and values outside the training range."""
    bounds = melt(train, [], names).groupBy("feature").agg(F.min("value").alias("train_low"), F.max("value").alias("train_high"))
    per_value = melt(rows, [], names).groupBy("feature", "value").agg(F.count("*").alias("w"))
    joined = per_value.join(bounds, "feature", "left")
    out = (F.col("value") < F.col("train_low")) | (F.col("value") > F.col("train_high"))
    return joined.groupBy("feature").agg(
        F.sum("w").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("w"))), F.lit(0)).alias("missing"),
        F.round(F.max("train_low"), digits).alias("train_low"), F.round(F.max("train_high"), digits).alias("train_high"),
        F.coalesce(F.sum(F.when(out, F.col("w"))), F.lit(0)).alias("outside_training_range"))
