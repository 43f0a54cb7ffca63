"""Operational labels, label policies and their distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import rules


def label_rows(evidence: DataFrame) -> DataFrame:
    """A -> 1, B/D -> 0, C -> null with review; uncertain release hours need review too."""
    cat = F.col("category")
    return evidence.select(
        "*", rules.label_value(cat).alias("discount_observed"),
        F.coalesce(F.when(F.col("eligible"), rules.pu_status(cat)), F.lit("unknown")).alias("pu_status"),
        F.coalesce(cat == "C", F.lit(True)).alias("ambiguity_flag"),
        (F.coalesce(cat == "C", F.lit(True))
         | (F.col("eligibility_status") != "eligible_by_release_date")).alias("requires_review"))


def with_policy(labels: DataFrame, policy: str = "operational") -> DataFrame:
    """Which rows may train a model. Targets stay; only the mask differs between policies."""
    if policy == "operational":
        ok = F.col("category").isin("A", "B", "D") & F.col("discount_observed").isNotNull()
        why = "operational_observation_target"
    elif policy == "conservative":
        ok = F.col("category").isin("A", "B") & ~F.col("requires_review")
        why = "observed_in_window_price"
    else:
        raise ValueError(f"unknown policy {policy}")
    ok = F.coalesce(ok, F.lit(False))
    return labels.select("*", ok.alias("model_eligible"),
                         F.when(ok, why).otherwise("missing_or_uncertain_in_window_evidence")
                         .alias("evidence_sufficiency"))


def labelability(labels: DataFrame) -> DataFrame:
    """Blank the label where a row is not usable and say why it is or is not."""
    ok, y = F.col("model_eligible"), F.col("discount_observed")
    return labels.select(
        "entity_id", "window_year", F.when(ok, y).alias("discount_observed"),
        F.when(ok & (y == 1), "usable_observed_discount").when(ok, "usable_observed_full_price")
        .otherwise("unknown_or_excluded").alias("labelability_status"))


def _category_counts() -> list[Column]:
    return [F.count_if(F.col("category") == c).alias(f"category_{c.lower()}") for c in rules.CATEGORIES]


def distribution(labels: DataFrame) -> DataFrame:
    """Totals overall and per year (null year = all)."""
    y = F.col("discount_observed")
    counts = [F.count("*").alias("rows"), *_category_counts(),
        F.count_if(y == 1).alias("label_1"), F.count_if(y == 0).alias("label_0"),
        F.count_if(y.isNull()).alias("label_null"),
        F.count_if(F.col("pu_status") == "positive").alias("pu_positive"),
        F.count_if(F.col("pu_status") == "unlabeled").alias("pu_unlabeled"),
        F.count_if("requires_review").alias("review_required"),
        F.count_if(F.col("eligibility_status") == "uncertain_release_hour").alias("release_hour_uncertain")]
    per_year = labels.groupBy("window_year").agg(*counts)
    # The grand total rolls up a handful of year rows instead of doubling every label row.
    return per_year.rollup("window_year").agg(*[F.sum(c).alias(c) for c in per_year.columns if c != "window_year"])


def yearly_quality(labels: DataFrame, usable_history: DataFrame) -> DataFrame:
    """Coverage by year, with entities that have at least one usable record."""
    rows = labels.join(usable_history.withColumn("_usable", F.lit(True)), "entity_id", "left")
    return rows.groupBy("window_year").agg(
        F.count("*").alias("target_entities"), *_category_counts(),
        F.count_if(F.col("category").isNull()).alias("category_unknown"),
        F.count_if("model_eligible").alias("usable_labels"),
        F.count_if(~F.col("model_eligible")).alias("unusable_labels"),
        F.count_if(F.col("eligibility_status") == "ineligible_by_release_date").alias("ineligible"),
        F.count_if("_usable").alias("entities_with_usable_history"))


def yearly_labelability(labels: DataFrame, conflict_pairs: DataFrame) -> DataFrame:
    rows = labels.join(conflict_pairs.withColumn("_conflict", F.lit(True)),
                       ["entity_id", "window_year"], "left")
    ok, y = F.col("model_eligible"), F.col("discount_observed")
    usable = F.count_if(ok & y.isin(0, 1))
    return rows.groupBy("window_year").agg(
        F.count("*").alias("pairs"), *_category_counts(),
        F.count_if(F.col("category").isNull()).alias("not_classified"),
        F.count_if(ok & (y == 1)).alias("usable_positive"), F.count_if(ok & (y == 0)).alias("usable_negative"),
        (F.count("*") - usable).alias("unknown_or_excluded"),
        F.round(100.0 * usable / F.count("*"), 6).alias("usable_percent"),
        F.count_if(F.col("eligibility_status") == "ineligible_by_release_date").alias("ineligible"),
        F.count_if(F.col("eligibility_status") == "uncertain_release_hour").alias("release_hour_uncertain"),
        F.count_if("_conflict").alias("conflict_pairs"))


def recurrence(labels: DataFrame, years: int) -> DataFrame:
    """How many years each entity is positive, as a dense histogram with shares."""
    per_entity = labels.groupBy("entity_id").agg(
        F.sum(F.coalesce("discount_observed", F.lit(0))).cast("int").alias("positive_years"))
    counts = per_entity.groupBy("positive_years").agg(F.count("*").alias("entities"))
    spark = labels.sparkSession
    dense = spark.range(0, years + 1).select(F.col("id").cast("int").alias("positive_years"))
    filled = dense.join(counts, "positive_years", "left").select(
        "positive_years", F.coalesce("entities", F.lit(0)).alias("entities"))
    total = counts.agg(F.sum("entities")).scalar()
    return filled.select("positive_years", "entities",
                         F.round(F.col("entities") / total, 9).alias("share"))


def modeling_table(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Targets joined only after features exist, on the same key and cutoff."""
    targets = labels.select("entity_id", "window_year", F.col("window_start").alias("prediction_cutoff"),
                            "category", "discount_observed", "model_eligible")
    return features.join(targets, ["entity_id", "window_year", "prediction_cutoff"])
