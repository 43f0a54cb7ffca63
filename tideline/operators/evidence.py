"""What each window directly shows, and what surrounds it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import rules
from tideline.operators import observations as obs_ops
from tideline.operators.windows import Calendar, _ntz, entity_windows, tag_records

SIDES = ("before", "inside", "after")
STATE_CODES = {"full_price": 1, "discount": 2, "ambiguous": 3}


def in_any_window(calendar: Calendar, ts: Column) -> Column:
    """Plain range predicates on the raw column, so they reach the scan."""
    return reduce(lambda a, b: a | b, [(ts >= _ntz(w.start)) & (ts < _ntz(w.end))
                                       for w in calendar.windows])


def inside_records(observations: DataFrame, calendar: Calendar) -> DataFrame:
    """Records that lie in a window, one row per record and window."""
    near = observations.where(in_any_window(calendar, F.col("ts")))
    return tag_records(near, calendar).where(F.col("side") == "inside").drop("side")


def inside_counts(observations: DataFrame, calendar: Calendar) -> DataFrame:
    """Per entity and window: direct evidence counts and comparable money extremes."""
    kind, day = F.col("kind"), F.col("ts").cast("date")
    priced = F.col("price").isNotNull() & ~F.isnan("price")
    regular = F.col("regular").isNotNull() & ~F.isnan("regular")
    grouped = inside_records(observations, calendar).groupBy("entity_id", "window_year").agg(
        F.count("*").alias("records"), F.count_if(kind == "discount").alias("discounts"),
        F.count_if(kind == "full_price").alias("full_prices"),
        F.count_if(kind == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("deal_status") == "null").alias("null_deals"),
        F.count_if(day == F.col("start_date")).alias("on_start_date"),
        F.count_if(day == F.col("end_date")).alias("on_end_date"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max(F.when(F.col("cut").between(0, 100), F.col("cut"))).alias("max_cut"),
        # Currency codes are a small closed domain, so this set is bounded.
        F.array_sort(F.collect_set(F.when(priced, F.coalesce("price_currency", F.lit("")))))
        .alias("currencies"),
        F.array_sort(F.collect_set(F.when(regular, F.coalesce("regular_currency", F.lit("")))))
        .alias("_regular_currencies"),
        F.min(F.when(priced & (F.col("price") >= 0), F.col("price"))).alias("_min_price"),
        F.max(F.when(regular & (F.col("regular") >= 0), F.col("regular"))).alias("_max_regular"))
    comparable = (F.size(F.array_union("currencies", "_regular_currencies")) == 1) \
        & ~F.array_contains("currencies", "")
    return grouped.select(
        "entity_id", "window_year", "records", "discounts", "full_prices", "ambiguous",
        "null_deals", "on_start_date", "on_end_date", "first_ts", "last_ts", "max_cut",
        F.array_join("currencies", ";").alias("currencies"),
        F.when(comparable, F.col("_min_price")).alias("min_price"),
        F.when(comparable, F.col("_max_regular")).alias("max_regular"))


def history_status(entities: DataFrame) -> Column:
    """Status of an entity's history, from the required column ``history_status`` (null: absent).

    Without it nothing is known about unread histories; ``sources.history.with_history_status`` derives it from the documents.
    """
    if "history_status" not in entities.columns:
        raise ValueError("entities need the column history_status")
    return F.coalesce("history_status", F.lit("absent"))


def direct_evidence(entities: DataFrame, observations: DataFrame, calendar: Calendar) -> DataFrame:
    """Every entity and window with its evidence category; blank when not eligible or not known.

    A history that is not ``valid`` shows nothing certain: no category, status ``unknown_history``, and no counts
    either unless it is ``partial``. A valid history without records is D.
    """
    counts = ["records", "discounts", "full_prices", "ambiguous", "null_deals"]
    pairs = entity_windows(entities.select("entity_id", "release_date", history_status(entities).alias("_history")), calendar)
    joined = pairs.join(inside_counts(observations, calendar), ["entity_id", "window_year"], "left")
    known = F.col("eligible") & (F.col("_history") == "valid")
    counted = F.col("eligible") & F.col("_history").isin("valid", "partial")
    shown = [F.when(counted, F.coalesce(c, F.lit(0))).alias(c) for c in counts]
    rows = joined.select(
        "entity_id", "window_year", "window_start", "window_end", "release_date", "release_timing",
        F.when(F.col("eligible") & ~known, "unknown_history").otherwise(F.col("eligibility_status")).alias("eligibility_status"),
        "eligible", known.alias("_known"), *shown,
        *[F.when(counted, F.col(c)).alias(c) for c in
          ("first_ts", "last_ts", "max_cut", "currencies", "min_price", "max_regular",
           "on_start_date", "on_end_date")])
    return rows.withColumn("category", F.when(F.col("_known"), rules.evidence_category(
        F.col("records"), F.col("discounts"), F.col("full_prices")))).drop("_known")


# ------------------------------------------------------------------ surrounding context
def _state_code() -> Column:
    return (F.when((F.col("n_ambiguous") > 0) | F.col("conflict"), 3)
            .when(F.col("n_discount") > 0, 2).otherwise(1))


def state_name(code: Column) -> Column:
    return (F.when(code == 1, "full_price").when(code == 2, "discount")
            .when(code == 3, "ambiguous").otherwise("missing"))


def segment_summary(observations: DataFrame, calendar: Calendar, *tags: str) -> DataFrame:
    """Per entity and elementary time segment (and tag columns); every later step works on these few rows.

    Written once (``session.durable``), it can serve context, features and labels with one scan of the records.
    """
    per_instant = obs_ops.instants(observations, *tags)
    valid_ts = F.when(F.col("n_discount") + F.col("n_full") > 0, F.col("ts"))
    state = _state_code()
    return per_instant.withColumn("segment", calendar.segment(F.col("ts"))) \
        .groupBy("entity_id", "segment", *tags).agg(
            *[F.sum(c).alias(c) for c in ("n", "n_discount", "n_full", "n_ambiguous", "n_null_deal")],
            F.count_if("conflict").alias("n_conflicts"),
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.min_by(state, F.col("ts")).alias("first_state"),
            F.max_by(state, F.col("ts")).alias("last_state"),
            F.min_by("n", "ts").alias("first_ties"), F.max_by("n", "ts").alias("last_ties"),
            F.min_by("conflict", "ts").alias("first_conflict"),
            F.max_by("conflict", "ts").alias("last_conflict"),
            F.min_by("state_a", "ts").alias("first_a"), F.max_by("state_a", "ts").alias("last_a"),
            F.min_by("state_b", "ts").alias("first_b"), F.max_by("state_b", "ts").alias("last_b"),
            F.min_by("lowest_index", "ts").alias("first_index"),
            F.max_by("lowest_index", "ts").alias("last_index"),
            F.max(valid_ts).alias("valid_ts"),
            F.max_by("valid_price", valid_ts).alias("valid_price"),
            F.max_by("valid_cut", valid_ts).alias("valid_cut"),
            F.max_by("valid_conflict", valid_ts).alias("valid_conflict"),
            F.max(F.when(F.col("n_discount") > 0, F.col("ts"))).alias("discount_ts"),
            F.sum("discount_cut_sum").alias("discount_cut_sum"),
            F.max("discount_cut_max").alias("discount_cut_max"),
            F.min("currency_low").alias("currency_low"),
            F.max("currency_high").alias("currency_high"))


def entity_segments(entities: DataFrame, segments: DataFrame, calendar: Calendar) -> DataFrame:
    """Segment rows of known entities per window, clustered by entity.

    Entity rows join the stream as a marker segment instead of through a join, and the shuffle
    happens before the per-window expansion, so it moves one short row set per entity.
    """
    markers = entities.select("entity_id", F.lit(-1).alias("segment"), F.lit(True).alias("known"), "release_date",
                              *[c for c in ("history_status",) if c in entities.columns])
    both = segments.unionByName(markers, allowMissingColumns=True).repartition("entity_id")
    return calendar.each_window(both, segments=True)


def pair_context(entities: DataFrame, observations: DataFrame | None, calendar: Calendar, segments: DataFrame | None = None) -> DataFrame:
    """Per entity and window: counts on each side, nearest state before and after, gaps.

    The category is blank when the window is not eligible or the history not valid, as in ``direct_evidence``.
    ``segments`` is a ready ``segment_summary`` of the observations.
    """
    segments = segment_summary(observations, calendar) if segments is None else segments
    rows = entity_segments(entities.withColumn("history_status", history_status(entities)), segments, calendar)
    seg, first, last = F.col("segment"), F.col("first_segment"), F.col("last_segment")
    real = seg >= 0
    on = {"before": real & (seg < first), "inside": (seg >= first) & (seg <= last),
          "after": seg > last}
    counts = ("n", "n_discount", "n_full", "n_ambiguous", "n_null_deal", "n_conflicts")
    total = lambda s, c: F.coalesce(F.sum(F.when(on[s], F.col(c))), F.lit(0)).alias(f"{s}_{c}")
    near = lambda s, f, c, t: f(F.when(on[s], F.col(c)), F.when(on[s], F.col(t)))
    keys = ["entity_id", "window_year", "start_date", "end_date", "window_start", "window_end"]
    wide = rows.groupBy(*keys).agg(
        F.max("known").alias("known"), F.max("release_date").alias("release_date"), F.max("history_status").alias("_history"),
        *[total(s, c) for s in SIDES for c in counts],
        F.max(F.when(on["before"], F.col("last_ts"))).alias("pre_ts"),
        F.min(F.when(on["after"], F.col("first_ts"))).alias("post_ts"),
        F.min("first_ts").alias("history_first_ts"), F.max("last_ts").alias("history_last_ts"),
        *[near("before", F.max_by, f"last_{c}", "last_ts").alias(f"pre_{c}")
          for c in ("state", "ties", "conflict", "a", "b", "index")],
        *[near("after", F.min_by, f"first_{c}", "first_ts").alias(f"post_{c}")
          for c in ("state", "ties", "conflict", "a", "b", "index")])
    wide = wide.where("known").drop("known")
    start, end, release = F.col("window_start"), F.col("window_end"), F.col("release_date")
    return wide.select(
        "*", rules.release_timing(release, F.col("start_date"), F.col("end_date")).alias("release_timing"),
        rules.eligibility_status(release, F.col("start_date")).alias("eligibility_status"),
        (release <= F.col("start_date")).alias("eligible"),
        F.when((release <= F.col("start_date")) & (F.col("_history") == "valid"), rules.evidence_category(
            F.col("inside_n"), F.col("inside_n_discount"), F.col("inside_n_full"))).alias("category"),
        state_name(F.col("pre_state")).alias("pre_observed_state"),
        state_name(F.col("post_state")).alias("post_observed_state"),
        rules.gap_days(F.col("pre_ts"), start).alias("pre_gap_days"),
        rules.gap_days(end, F.col("post_ts")).alias("post_gap_days"),
        rules.gap_days(F.col("pre_ts"), F.col("post_ts")).alias("surrounding_days")).drop("_history")


def history_conflict_counts(segments: DataFrame) -> DataFrame:
    """(entity_id, history_conflicts) of entities with same-time conflicts, from a segment summary."""
    return segments.groupBy("entity_id").agg(F.sum("n_conflicts").alias("history_conflicts")).where("history_conflicts > 0")


def nearest_records(observations: DataFrame, context: DataFrame) -> DataFrame:
    """All tied nearest records before and after, long form with the representative marked.

    Ties are kept as rows, never gathered into one list, so a hot instant stays spread out.
    """
    sides = context.select("entity_id", "window_year", F.inline(F.array(
        F.struct(F.lit("before").alias("side"), F.col("pre_ts").alias("ts"),
                 F.col("pre_gap_days").alias("gap_days"), F.col("pre_ties").alias("ties"),
                 F.col("pre_index").alias("lowest_index")),
        F.struct(F.lit("after").alias("side"), F.col("post_ts").alias("ts"),
                 F.col("post_gap_days").alias("gap_days"), F.col("post_ties").alias("ties"),
                 F.col("post_index").alias("lowest_index"))))).where(F.col("ts").isNotNull())
    joined = sides.join(observations, ["entity_id", "ts"])
    return joined.withColumn("representative", F.col("record_index") == F.col("lowest_index")) \
        .drop("lowest_index")


def interpretation_cues(observations: DataFrame, context: DataFrame,
                        history_conflicts: DataFrame) -> DataFrame:
    """Ordered review reasons and overlapping pattern flags per entity and eligible window."""
    rows = context.where("eligible").join(history_conflicts, "entity_id", "left")
    one_differs = F.when(
        F.col("pre_conflict") & F.col("post_conflict"), F.lit(None).cast("boolean")) \
        .when(F.col("pre_conflict") | F.col("post_conflict"), F.lit(True)) \
        .otherwise((F.col("pre_a") != F.col("post_a")) | (F.col("pre_b") != F.col("post_b")))
    rows = rows.withColumn("_differs", one_differs)
    # Both sides conflicting is rare: compare those signature sets exactly.
    hard = rows.where(F.col("pre_ts").isNotNull() & F.col("post_ts").isNotNull()
                      & F.col("pre_conflict") & F.col("post_conflict"))
    ends = hard.select("entity_id", "window_year", F.inline(F.array(
        F.struct(F.lit(1).alias("_bit"), F.col("pre_ts").alias("ts")),
        F.struct(F.lit(2).alias("_bit"), F.col("post_ts").alias("ts")))))
    seen = ends.join(obs_ops.with_state(observations), ["entity_id", "ts"]) \
        .groupBy("entity_id", "window_year", "state_a", "state_b").agg(F.bit_or("_bit").alias("_sides"))
    resolved = seen.groupBy("entity_id", "window_year").agg((F.min("_sides") < 3).alias("_sets_differ"))
    rows = rows.join(resolved, ["entity_id", "window_year"], "left")
    pre, post = F.col("pre_observed_state"), F.col("post_observed_state")
    differs = F.coalesce("_differs", "_sets_differ", F.lit(False)) \
        & F.col("pre_ts").isNotNull() & F.col("post_ts").isNotNull()
    reasons = F.array_compact(F.array(
        F.when((pre == "missing") | (post == "missing"), F.lit("missing_surrounding_observation")),
        F.when((pre == "ambiguous") | (post == "ambiguous") | (F.col("inside_n_ambiguous") > 0),
               F.lit("ambiguous_observed_information")),
        F.when(differs, F.lit("surrounding_observed_values_differ")),
        F.when(F.coalesce("history_conflicts", F.lit(0)) > 0, F.lit("same_timestamp_history_conflict")),
        F.when(F.col("release_timing") == "on_start_date", F.lit("release_hour_unknown"))))
    found = F.col("inside_n_discount") > 0
    return rows.select(
        "entity_id", "window_year", F.array_join(reasons, ";").alias("cues"),
        (F.size(reasons) > 0).alias("requires_review"), found.alias("direct_discount"),
        ((pre == "discount") & ~found).alias("pre_discount_only"),
        ((pre == "full_price") & ~found).alias("pre_full_price_only"),
        pre.isin("missing", "ambiguous").alias("no_clear_pre_state"))


def conflicts(observations: DataFrame, *extra_keys: str) -> DataFrame:
    """Same-timestamp groups that show more than one state."""
    rows = obs_ops.with_state(observations)
    grouped = rows.groupBy("entity_id", *extra_keys, "ts").agg(
        F.count("*").alias("records"), F.min("record_index").alias("lowest_index"),
        ((F.min("state_a") != F.max("state_a")) | (F.min("state_b") != F.max("state_b"))).alias("_c"))
    return grouped.where("_c").drop("_c")
