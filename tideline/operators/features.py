"""Strictly pre-cutoff features and the audits that show they cannot see the future."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import rules
from tideline.operators.evidence import entity_segments, segment_summary
from tideline.operators.windows import Calendar, _ntz, tag_records

# Predictor names in their fixed order.
STATIC = ("game_age_days", "release_year", "release_month", "release_quarter")
PRICE = ("prior_price_record_count", "prior_discount_count", "prior_discount_rate",
         "days_since_last_price_record", "days_since_last_discount", "max_prior_discount_pct",
         "mean_prior_discount_pct", "last_observed_price", "last_observed_discount_pct",
         "has_prior_price_history", "has_prior_discount_observation")
PREDICTORS = STATIC + PRICE
NEVER_NULL = STATIC + ("prior_price_record_count", "prior_discount_count",
                       "has_prior_price_history", "has_prior_discount_observation")
COVERAGE_PREDICTORS = ("prior_price_record_count", "days_since_last_price_record",
                       "has_prior_price_history")


def static_features(release: Column, start_date: Column) -> list[Column]:
    return [F.datediff(start_date, release).alias("game_age_days"),
            F.year(release).alias("release_year"), F.month(release).alias("release_month"),
            F.quarter(release).alias("release_quarter"),
            (release == start_date).cast("int").alias("audit_release_hour_uncertain")]


def prior_summary(rows: DataFrame, *versions: str) -> DataFrame:
    """Everything known strictly before each window start, per entity and window (and version), from ``entity_segments``."""
    prior = (F.col("segment") >= 0) & (F.col("segment") < F.col("first_segment"))
    p = lambda c: F.when(prior, F.col(c))
    total = lambda c: F.coalesce(F.sum(p(c)), F.lit(0))
    latest = lambda c: F.max_by(p(c), p("valid_ts"))
    return rows.groupBy("entity_id", "window_year", "start_date", "window_start", *versions).agg(
        F.max("known").alias("known"), F.max("release_date").alias("release_date"),
        total("n").alias("prior_n"), (total("n_discount") + total("n_full")).alias("valid_n"),
        total("n_discount").alias("discount_n"), total("n_null_deal").alias("null_deal_n"),
        total("n_ambiguous").alias("ambiguous_n"), total("n_conflicts").alias("conflict_n"),
        F.max(p("valid_ts")).alias("valid_ts"), F.max(p("discount_ts")).alias("discount_ts"),
        latest("valid_price").alias("valid_price"), latest("valid_cut").alias("valid_cut"),
        F.coalesce(latest("valid_conflict"), F.lit(False)).alias("valid_conflict"),
        F.sum(p("discount_cut_sum")).alias("cut_sum"), F.max(p("discount_cut_max")).alias("cut_max"),
        F.min(p("currency_low")).alias("currency_low"),
        F.max(p("currency_high")).alias("currency_high")).where("known").drop("known")


def money_issue(home_currency: str = "USD") -> Column:
    home = rules.currency_code(F.lit(home_currency))
    return (F.when(F.col("valid_n") == 0, "no_valid_prior_price")
            .when(F.col("currency_low") != F.col("currency_high"), "mixed_prior_currencies")
            .when(F.col("currency_low") != home, "non_home_prior_currency")
            .when(F.col("valid_conflict"), "conflicting_latest_timestamp"))


def features(entities: DataFrame, observations: DataFrame | None, calendar: Calendar, *,
             home_currency: str = "USD", with_diagnostics: bool = False, segments: DataFrame | None = None) -> DataFrame:
    """Feature rows for every eligible entity and window; nulls are never filled.

    ``segments`` is a ready ``segment_summary`` of the observations.
    """
    segments = segment_summary(observations, calendar) if segments is None else segments
    return feature_rows(prior_summary(entity_segments(entities, segments, calendar)), home_currency, with_diagnostics)


def feature_rows(prior: DataFrame, home_currency: str = "USD", with_diagnostics: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Features from ``prior_summary`` rows, with the ``keep`` columns."""
    rows = prior.where(F.col("release_date") <= F.col("start_date")) \
        .withColumn("money_issue", money_issue(home_currency))
    n, d, cutoff = F.col("valid_n"), F.col("discount_n"), F.col("window_start")
    has = n > 0
    price = [
        n.alias("prior_price_record_count"), d.alias("prior_discount_count"),
        F.when(has, d / n).alias("prior_discount_rate"),
        rules.gap_days(F.col("valid_ts"), cutoff).alias("days_since_last_price_record"),
        rules.gap_days(F.col("discount_ts"), cutoff).alias("days_since_last_discount"),
        F.col("cut_max").alias("max_prior_discount_pct"),
        F.when(d > 0, F.col("cut_sum") / d).alias("mean_prior_discount_pct"),
        F.when(F.col("money_issue").isNull(), F.col("valid_price")).alias("last_observed_price"),
        F.when(~F.col("valid_conflict"), F.col("valid_cut")).alias("last_observed_discount_pct"),
        has.cast("int").alias("has_prior_price_history"),
        (d > 0).cast("int").alias("has_prior_discount_observation")]
    *static, uncertain = static_features(F.col("release_date"), F.col("start_date"))
    extra = [] if not with_diagnostics else [
        F.col("money_issue"), F.col("valid_ts").alias("latest_valid_ts"),
        F.col("discount_ts").alias("latest_discount_ts"),
        F.col("ambiguous_n").alias("prior_ambiguous_count"),
        F.col("null_deal_n").alias("prior_null_deal_count"),
        F.col("conflict_n").alias("prior_conflict_groups"),
        F.col("valid_conflict").alias("latest_valid_conflict")]
    return rows.select("entity_id", "window_year", *keep, cutoff.alias("prediction_cutoff"),
                       *static, *price, uncertain, *extra)


def select_predictors(frame: DataFrame, names=PREDICTORS, keep=("entity_id", "window_year"),
                      prohibited=("category", "discount_observed")) -> DataFrame:
    """Exactly the approved predictors, in order, as doubles."""
    missing = [c for c in names if c not in frame.columns]
    leaked = [c for c in names if c in prohibited]
    if missing or leaked:
        raise ValueError(f"predictors missing {missing}, prohibited {leaked}")
    return frame.select(*keep, *[F.col(c).cast("double").alias(c) for c in names])


def melt(frame: DataFrame, keys, names=PREDICTORS) -> DataFrame:
    """Long form ``keys, feature, value`` in one narrow pass."""
    typed = frame.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return typed.unpivot(list(keys), list(names), "feature", "value")


def contract_violations(rows: DataFrame) -> DataFrame:
    """Feature-row rules and how many rows break each (one pass, one row per rule)."""
    c = F.col
    count, disc = c("prior_price_record_count"), c("prior_discount_count")
    nullable = [f for f in PREDICTORS if f not in NEVER_NULL]
    any_of = lambda conds: F.array_contains(F.array(*[F.coalesce(x, F.lit(False)) for x in conds]), True)
    checks = {
        "required_feature_null": any_of([c(f).isNull() for f in NEVER_NULL]),
        "negative_or_infinite": any_of([(c(f) < 0) | F.isnan(c(f).cast("double"))
                                        | (c(f).cast("double") == float("inf")) for f in PREDICTORS]),
        "release_parts": ~(c("release_year").between(1, c("window_year"))
                           & c("release_month").between(1, 12)
                           & (c("release_quarter") == F.floor((c("release_month") - 1) / 3) + 1)),
        "discounts_exceed_records": disc > count,
        "history_flags": (c("has_prior_price_history") != (count > 0).cast("int"))
        | (c("has_prior_discount_observation") != (disc > 0).cast("int")),
        "discount_rate": F.when(count == 0, c("prior_discount_rate").isNotNull()).otherwise(
            c("prior_discount_rate").isNull()
            | (F.abs(c("prior_discount_rate") - disc / F.when(count > 0, count)) > 1e-9)),
        "recency_not_prior": any_of([c(f) <= 0 for f in (
            "days_since_last_price_record", "days_since_last_discount")]),
        "percent_range": any_of([~c(f).between(0, 100) for f in (
            "max_prior_discount_pct", "mean_prior_discount_pct", "last_observed_discount_pct")]),
        "filled_without_history": (count == 0) & any_of([c(f).isNotNull() for f in nullable]),
        "filled_without_discount": (disc == 0) & any_of([c(f).isNotNull() for f in (
            "days_since_last_discount", "max_prior_discount_pct", "mean_prior_discount_pct")]),
    }
    return count_violations(rows, checks)


def count_violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rule, violations`` from one aggregate over the rows."""
    names = list(checks)
    one = rows.agg(*[F.count_if(F.coalesce(x, F.lit(True))).alias(n) for n, x in checks.items()])
    return one.unpivot([], names, "rule", "violations")


# ------------------------------------------------------------------ leakage audits
def compare_versions(left: DataFrame, right: DataFrame,
                     keys=("entity_id", "window_year")) -> DataFrame:
    """``keys, changed`` over the key union of two versions, null-safe over all columns."""
    names = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*names).alias("_l"))
    b = right.select(*keys, F.struct(*names).alias("_r"))
    return a.join(b, list(keys), "full_outer").select(
        *keys, (~F.col("_l").eqNullSafe(F.col("_r"))).alias("changed"))


def differing_rows(left: DataFrame, right: DataFrame, keys=("entity_id", "window_year")) -> DataFrame:
    return compare_versions(left, right, keys).where("changed").drop("changed")


def in_versions(rows: DataFrame, versions: Mapping[str, Column]) -> DataFrame:
    """Every row once for each version whose condition holds for it, with the version's name."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), name) for name, holds in versions.items()]))
    return rows.withColumn("version", F.explode(names))


def version_differences(rows: DataFrame, versions: Mapping[str, Column]) -> DataFrame:
    """(entity_id, window_year, changed): whether the features of two versions of the records differ.

    ``rows`` are ``entity_segments``; a version keeps those where its condition holds. Both versions are aggregated in the same
    pass, so the records are read once, whatever the number of windows.
    """
    found = feature_rows(prior_summary(in_versions(rows, versions), "version"), keep=("version",))
    value = F.struct(*[c for c in found.columns if c not in ("entity_id", "window_year", "version")])
    one, other = [F.max(F.when(F.col("version") == name, value)) for name in versions]
    return found.groupBy("entity_id", "window_year").agg((~one.eqNullSafe(other)).alias("changed"))


def _per_window(changes: DataFrame) -> DataFrame:
    return changes.groupBy("window_year").agg(F.count("*").alias("compared_rows"), F.count_if("changed").alias("changed_rows"))


def boundary_probe(entities: DataFrame, calendar: Calendar, like: DataFrame, shop_id: int) -> DataFrame:
    """One synthetic discount exactly at each window start for every entity, with the window as ``probe``."""
    rows = calendar.each_window(entities.select("entity_id"))
    probe = rows.select(
        "entity_id", F.lit(-1).cast("bigint").alias("record_index"), F.col("window_start").alias("ts"),
        F.lit(shop_id).alias("shop_id"), F.lit("probe").alias("shop_name"),
        F.lit("object").alias("deal_status"), F.lit(1.0).alias("price"),
        F.lit(100).cast("bigint").alias("price_amount_int"), F.lit("USD").alias("price_currency"),
        F.lit(100.0).alias("regular"), F.lit(10000).cast("bigint").alias("regular_amount_int"),
        F.lit("USD").alias("regular_currency"), F.lit(99.0).alias("cut"),
        F.lit("discount").alias("kind"), F.lit(None).cast("string").alias("issue"), F.col("window_year").alias("probe"))
    return probe.select(*[F.col(c).cast(t) for c, t in like.dtypes], "probe")


def future_removal_differences(entities: DataFrame, observations: DataFrame,
                               calendar: Calendar) -> DataFrame:
    """Per window: rows whose features change when records at or after the cutoff are removed.

    A window start is an edge of the segments, so the shorter version is a choice of segment rows.
    """
    rows = entity_segments(entities, segment_summary(observations, calendar), calendar)
    return _per_window(version_differences(rows, {"all": F.lit(True), "before": F.col("segment") < F.col("first_segment")}))


def boundary_insertion_differences(entities: DataFrame, observations: DataFrame,
                                   calendar: Calendar, shop_id: int) -> DataFrame:
    """Per window: rows whose features change when a discount is added exactly at the cutoff.

    Probes join the records before the one aggregation and stay apart from them by their tag.
    """
    tagged = observations.withColumn("probe", F.lit(None).cast("int")).unionByName(boundary_probe(entities, calendar, observations, shop_id))
    rows = entity_segments(entities, segment_summary(tagged, calendar, "probe"), calendar)
    own = F.col("probe").isNull()
    return _per_window(version_differences(rows, {"plain": own, "probed": own | (F.col("probe") == F.col("window_year"))}))


def lineage(entities: DataFrame, observations: DataFrame, calendar: Calendar) -> DataFrame:
    """Which records each feature row uses, long form: one row per pair and prior record."""
    past = observations.where(F.col("ts") < _ntz(max(w.start for w in calendar.windows)))
    known = past.join(entities.select("entity_id", "release_date"), "entity_id")
    # Windows expand after the join, so each observation is shuffled once.
    rows = tag_records(known, calendar).where((F.col("side") == "before") & (F.col("release_date") <= F.col("start_date")))
    valid = F.col("kind") != "ambiguous"
    return rows.select(
        "entity_id", "window_year", "record_index", "ts", "kind", valid.alias("used"),
        (F.col("kind") == "discount").alias("used_as_discount"),
        (valid & (F.col("ts").cast("date") < F.col("release_date"))).alias("before_release"),
        (F.col("ts") >= F.col("window_start")).alias("cutoff_violation"))


def lineage_summary(entities: DataFrame, observations: DataFrame, calendar: Calendar) -> DataFrame:
    return lineage(entities, observations, calendar).groupBy("entity_id", "window_year").agg(
        F.count_if("used").alias("valid_records"), F.count_if(~F.col("used")).alias("ambiguous_records"),
        F.count_if("used_as_discount").alias("discount_records"),
        F.count_if("before_release").alias("records_before_release"),
        F.count_if("cutoff_violation").alias("cutoff_violations"),
        F.max(F.when(F.col("used"), F.col("ts"))).alias("latest_valid_ts"))


def old_filter_impact(entities: DataFrame, observations: DataFrame, calendar: Calendar,
                      older_cutoff: Column) -> DataFrame:
    """Entities whose features change under an older record filter, and records left out, from one scan of the records."""
    only = calendar.only(calendar.windows[-1].year)
    segments = segment_summary(observations.withColumn("older", F.col("ts") < older_cutoff), only, "older")
    rows = entity_segments(entities, segments, only)
    marker = F.col("segment") < 0
    changed = version_differences(rows, {"all": F.lit(True), "older": marker | F.col("older")})
    inside = (F.col("segment") >= F.col("first_segment")) & (F.col("segment") <= F.col("last_segment"))
    count = lambda holds, name: F.coalesce(F.sum(F.when(holds, F.col("n"))), F.lit(0)).alias(name)
    sides = only.each_window(segments, segments=True).agg(
        count(inside, "in_window_records"), count(F.col("segment") > F.col("last_segment"), "after_window_records"),
        count(F.col("segment") >= F.col("first_segment"), "excluded_records"))
    return sides.select(changed.agg(F.count_if("changed")).scalar().alias("changed_entities"), "*")
