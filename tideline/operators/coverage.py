"""Surrounding-evidence diagnostics: gap statistics, sensitivity slices, consecutive states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rules
from tideline.operators import observations as obs_ops, prefix
from tideline.session import durable

# Gap statistics, recency limits in days (null = unrestricted).
GAP_FRACTIONS = {"min": 0.0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75,
                 "p90": 0.9, "p95": 0.95, "max": 1.0}
RECENCY_LIMITS = (7, 14, 30, 60, 90, None)
GAPS = ("pre_gap_days", "post_gap_days", "surrounding_days")


def gap_stats(rows: DataFrame, keys, value: str, digits: int = 6) -> DataFrame:
    """n, missing, quantiles and mean of a nullable measure per key."""
    keys = list(keys)
    base = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"),
        F.round(F.avg(value), digits).alias("mean"))
    q = prefix.quantiles(rows, keys, value, GAP_FRACTIONS)
    if keys:
        joined = prefix.join_on(base, q, keys, "left")
    else:
        joined = base.withColumn("_q", q.select(F.struct(*GAP_FRACTIONS)).scalar()).select("*", "_q.*")
    return joined.select(*keys, "n", "missing", "mean",
                         *[F.round(c, digits).alias(c) for c in GAP_FRACTIONS])


def melt_gaps(context: DataFrame, *keys: str) -> DataFrame:
    """Long form of the three gap measures, keeping missing ones as rows."""
    return context.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(g).alias("metric"), F.col(g).alias("days")) for g in GAPS])))


def dense_grid(spark, columns: dict[str, list]) -> DataFrame:
    """All combinations of a few fixed value lists, as nested explodes of one row."""
    out = spark.range(1).select()
    for name, values in columns.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def grouped_gap_stats(context: DataFrame, years: list[int]) -> DataFrame:
    """Gap statistics of eligible pairs over several axes and per year, dense: every axis value has its rows."""
    spark = context.sparkSession
    axes = {"window_year": [str(y) for y in years], "category": list(rules.CATEGORIES),
            "pre_observed_state": list(rules.STATES), "post_observed_state": list(rules.STATES)}
    axis_rows = [(a, v) for a, vs in axes.items() for v in vs]
    axis_rows += [(f"{y}:{a}", v) for y in years for a in
                  ("category", "pre_observed_state", "post_observed_state") for v in axes[a]]
    grid = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("group_axis"), F.lit(v).alias("group_value")) for a, v in axis_rows]))) \
        .select("*", F.explode(F.array(*[F.lit(g) for g in GAPS])).alias("metric"))
    year = F.col("window_year").cast("string")
    entry = lambda axis, value: F.struct(axis.alias("group_axis"), value.alias("group_value"))
    members = F.array(
        entry(F.lit("window_year"), year),
        *[entry(F.lit(a), F.col(a)) for a in ("category", "pre_observed_state", "post_observed_state")],
        *[entry(F.concat(year, F.lit(":" + a)), F.col(a))
          for a in ("category", "pre_observed_state", "post_observed_state")])
    # Aggregate equal (year, category, states, gaps) first: far fewer rows get expanded.
    slim = context.where("eligible").groupBy("window_year", "category", "pre_observed_state", "post_observed_state",
                           *GAPS).agg(F.count("*").alias("w"))
    long = melt_gaps(slim, "window_year", "category", "pre_observed_state", "post_observed_state", "w") \
        .select("metric", "days", "w", F.inline(members))
    stats = weighted_gap_stats(long, ["group_axis", "group_value", "metric"])
    return grid.join(stats, ["group_axis", "group_value", "metric"], "left").select(
        "group_axis", "group_value", "metric", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("missing", F.lit(0)).alias("missing"), "mean", *GAP_FRACTIONS)


def weighted_gap_stats(long: DataFrame, keys, digits: int = 6) -> DataFrame:
    """gap_stats over rows ``days`` that stand for ``w`` originals each."""
    keys = list(keys)
    cells = long.groupBy(*keys, "days").agg(F.sum("w").alias("w"))
    base = cells.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("days").isNotNull(), F.col("w"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("days").isNull(), F.col("w"))), F.lit(0)).alias("missing"),
        F.sum(F.col("days") * F.col("w")).alias("_sum"))
    q = prefix.quantiles_of_counts(cells.where("days IS NOT NULL").select(
        *keys, F.col("days").alias("value"), F.col("w").alias("copies")), keys, GAP_FRACTIONS)
    return prefix.join_on(base, q, keys, "left").select(
        *keys, "n", "missing", F.round(F.col("_sum") / F.when(F.col("n") > 0, F.col("n")), digits).alias("mean"),
        *[F.round(c, digits).alias(c) for c in GAP_FRACTIONS])


def state_crosstab(context: DataFrame, by: str, side: str) -> DataFrame:
    """Eligible pairs by one column and the nearest state of one side."""
    state = F.col(f"{side}_observed_state")
    return context.where("eligible").groupBy(by).agg(
        F.count("*").alias("pairs"),
        *[F.count_if(state == s).alias(s) for s in rules.STATES])


def sensitivity_members(context: DataFrame) -> DataFrame:
    """Long-form membership: non-A pairs in every recency / year / category slice they satisfy."""
    rows = context.where(F.col("eligible") & (F.col("category") != "A")).select(
        "entity_id", F.col("window_year"), F.col("category").alias("own_category"),
        "pre_observed_state", "post_observed_state", "pre_gap_days", "post_gap_days")
    return _slices(rows, F.lit(1))


def _slices(rows: DataFrame, weight: Column) -> DataFrame:
    limits = F.array(*[F.struct(
        F.lit("unrestricted" if d is None else f"pre_within_{d}_days").alias("scenario"),
        F.lit(d).cast("int").alias("limit_days")) for d in RECENCY_LIMITS])
    year = F.col("window_year").cast("string")
    out = rows.withColumn("_w", weight).select("*", F.inline(limits)) \
        .withColumn("in_pool", F.lit(True)) \
        .withColumn("matches", F.col("limit_days").isNull()
                    | F.coalesce(F.col("pre_gap_days") <= F.col("limit_days"), F.lit(False)))
    return out.select("*", F.explode(F.array(F.lit("all"), year)).alias("slice_year")) \
        .select("*", F.explode(F.array(F.lit("all_non_A"), F.col("own_category"))).alias("slice_category"))


def _post_name(state: str) -> str:
    return "post_missing_state" if state == "missing" else f"post_{state}"


def sensitivity_table(context: DataFrame, years: list[int]) -> DataFrame:
    """The dense limit x year x category x state table with post-state counts and gap statistics."""
    spark = context.sparkSession
    slim = context.where(F.col("eligible") & (F.col("category") != "A")).groupBy(
        "window_year", F.col("category").alias("own_category"), "pre_observed_state",
        "post_observed_state", "pre_gap_days", "post_gap_days").agg(F.count("*").alias("w"))
    rows = _slices(slim, F.col("w"))
    keys = ["scenario", "slice_year", "slice_category", "pre_observed_state"]
    hit = lambda cond: F.coalesce(F.sum(F.when(F.col("matches") & cond, F.col("_w"))), F.lit(0))
    post_seen = F.col("post_gap_days").isNotNull()
    within = post_seen & F.col("pre_gap_days").isNotNull() \
        & (F.col("limit_days").isNull() | (F.col("post_gap_days") <= F.col("limit_days")))
    counts = rows.groupBy(*keys).agg(
        F.sum("_w").alias("pool_pairs"), hit(F.lit(True)).alias("matching_pairs"),
        hit(post_seen).alias("post_seen"), hit(~post_seen).alias("post_missing"),
        hit(within).alias("both_within_limit"),
        *[hit(F.col("post_observed_state") == s).alias(_post_name(s)) for s in rules.STATES])
    stats = weighted_gap_stats(rows.where("matches").select(
        *keys, F.col("post_gap_days").alias("days"), F.col("_w").alias("w")), keys)
    grid = dense_grid(spark, {
        "scenario": ["unrestricted" if d is None else f"pre_within_{d}_days" for d in RECENCY_LIMITS],
        "slice_year": ["all", *[str(y) for y in years]],
        "slice_category": ["all_non_A", "B", "C", "D"], "pre_observed_state": list(rules.STATES)})
    names = ["pool_pairs", "matching_pairs", "post_seen", "post_missing", "both_within_limit",
             *[_post_name(s) for s in rules.STATES]]
    return grid.join(counts, keys, "left").join(stats, keys, "left").select(
        *keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        F.coalesce("n", F.lit(0)).alias("gap_n"), F.coalesce("missing", F.lit(0)).alias("gap_missing"),
        F.col("mean").alias("gap_mean"), *[F.col(c).alias(f"gap_{c}") for c in GAP_FRACTIONS])


# ------------------------------------------------------------------ consecutive groups
GROUP_COLUMNS = ("n", "kind", "price", "currency", "cut", "a", "b")
STATE_COLUMNS = ("a", "b", "many")  # what shared_state_links reads; many: the group shows more than one state


def consecutive_groups(observations: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each entity's timestamp groups linked to the next one in time.

    ``columns`` are the group columns that a caller reads beside ``ts``, all by default: every shuffle moves the others too.

    The next timestamp comes from a window over distinct timestamps cut into days: the last
    group of a day looks up the first group of the next non-empty day.
    """
    # Fixed-width codes keep both aggregates hash-based; they are only read for single-record groups.
    kind = F.when(F.col("kind") == "discount", 2).when(F.col("kind") == "full_price", 1).otherwise(3)
    currency = F.coalesce(rules.currency_code(F.col("price_currency")).cast("bigint"), F.xxhash64("price_currency"))
    rows = obs_ops.with_state(observations).withColumn("_kind", kind).withColumn(
        "_currency", F.when(F.col("price_currency").isNotNull(), currency))
    groups = rows.groupBy("entity_id", "ts").agg(
        F.count("*").alias("n"), F.min("_kind").alias("kind"), F.min("price").alias("price"),
        F.min("_currency").alias("currency"), F.min("cut").alias("cut"),
        F.min("state_a").alias("a"), F.min("state_b").alias("b"),
        ((F.min("state_a") != F.max("state_a")) | (F.min("state_b") != F.max("state_b"))).alias("many"))
    cols = ["ts", *(GROUP_COLUMNS if columns is None else columns)]
    # Written, as the days' heads are read beside the groups.
    tagged = durable(groups.select("entity_id", *cols)).withColumn("day", F.col("ts").cast("date"))
    inner = W.partitionBy("entity_id", "day").orderBy("ts")
    local = tagged.select("entity_id", "day", F.struct(*cols).alias("this"), F.lead(F.struct(*cols)).over(inner).alias("next_g"))
    # A day's first row is cut out before the shuffle, as a limit by group.
    firsts = tagged.withColumn("_at", F.row_number().over(inner)).where("_at = 1")
    across = firsts.select("entity_id", "day", F.lead(F.struct(*cols)).over(
        W.partitionBy("entity_id").orderBy("day")).alias("later_g"))
    linked = local.join(across, ["entity_id", "day"])
    return linked.select("entity_id", "this", F.coalesce("next_g", "later_g").alias("next")).where(F.col("next").isNotNull())


KIND_NAMES = {1: "full_price", 2: "discount", 3: "ambiguous"}


def _kind_name(code: Column) -> Column:
    return F.when(code == 1, KIND_NAMES[1]).when(code == 2, KIND_NAMES[2]).otherwise(KIND_NAMES[3])


def transition_matrix(links: DataFrame) -> DataFrame:
    """Kind-to-kind counts between adjacent single-record groups."""
    single = (F.col("this.n") == 1) & (F.col("next.n") == 1)
    return links.where(single).groupBy(_kind_name(F.col("this.kind")).alias("from_kind"),
                                       _kind_name(F.col("next.kind")).alias("to_kind")).agg(F.count("*").alias("pairs"))


def consecutive_facts(links: DataFrame) -> DataFrame:
    single = (F.col("this.n") == 1) & (F.col("next.n") == 1)
    same_state = (F.col("this.a") == F.col("next.a")) & (F.col("this.b") == F.col("next.b"))
    zero_cut = (F.col("this.cut") == 0) & (F.col("next.cut") == 0)
    same_price = F.col("this.price").eqNullSafe(F.col("next.price")) \
        & F.col("this.currency").eqNullSafe(F.col("next.currency"))
    return links.agg(
        F.count("*").alias("adjacent_groups"), F.count_if(single).alias("singleton_pairs"),
        F.count_if(~single).alias("excluded_pairs"), F.count_if(single & same_price).alias("same_price"),
        F.count_if(single & zero_cut).alias("consecutive_zero_cut"),
        F.count_if(single & zero_cut & same_state).alias("identical_zero_cut"),
        F.round(F.sum(rules.gap_days(F.col("this.ts"), F.col("next.ts"))), 6).alias("total_gap_days"))


def shared_state_links(observations: DataFrame, links: DataFrame) -> DataFrame:
    """Number of adjacent groups that have at least one state in common.

    ``links`` carry ``STATE_COLUMNS``. Two groups of one state each compare on their link. For the others, distinct states per group are
    matched by a shuffle join on the state itself, so a group with many states is never gathered.
    """
    this, then = F.col("this"), F.col("next")
    open_ = this["many"] | then["many"]
    # Written, as both ways of comparing read them.
    pairs = durable(links.select("entity_id", this["ts"].alias("ts"), then["ts"].alias("next_ts"), open_.alias("open"),
                                 (~open_ & (this["a"] == then["a"]) & (this["b"] == then["b"])).alias("equal")))
    some = pairs.where("open").select("entity_id", "ts", "next_ts")
    ends = some.select("entity_id", F.explode(F.array("ts", "next_ts")).alias("ts")).distinct()
    states = obs_ops.with_state(observations).select("entity_id", "ts", "state_a", "state_b") \
        .join(ends, ["entity_id", "ts"], "left_semi").distinct()
    here = some.join(states, ["entity_id", "ts"])
    there = states.withColumnRenamed("ts", "next_ts")
    shared = here.join(there, ["entity_id", "next_ts", "state_a", "state_b"], "left_semi").select("entity_id", "ts").distinct()
    return pairs.where("equal").select("entity_id", "ts").unionByName(shared).agg(F.count("*").alias("sharing_pairs"))


def history_totals(observations: DataFrame, requested_since: Column) -> DataFrame:
    """Totals over all histories: kinds, zero prices, records at the request boundary, tied groups."""
    marked = observations.withColumn("_zero", F.coalesce((F.col("price") == 0) & (F.col("regular") == 0), F.lit(False)))
    rows = obs_ops.with_state(marked).groupBy("entity_id", "ts").agg(
        F.count("*").alias("n"), F.count_if(F.col("deal_status") == "null").alias("null_deals"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in rules.KINDS], F.count_if("_zero").alias("zero_prices"),
        ((F.min("state_a") != F.max("state_a")) | (F.min("state_b") != F.max("state_b"))).alias("conflict"))
    per_entity = rows.groupBy("entity_id").agg(
        *[F.sum(c).alias(c) for c in ("n", "null_deals", *rules.KINDS, "zero_prices")],
        F.coalesce(F.sum(F.when(F.col("ts") == requested_since, F.col("n"))), F.lit(0)).alias("boundary"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.count_if("conflict").alias("conflict_groups"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return per_entity.agg(
        F.count("*").alias("entities"), total("n", "records"), total("null_deals", "null_deals"), total("ambiguous", "ambiguous"),
        total("full_price", "full_prices"), total("discount", "discounts"), total("zero_prices", "zero_prices"),
        total("boundary", "at_request_boundary"), total("duplicate_groups", "duplicate_groups"), total("conflict_groups", "conflict_groups"))


def newest_first(observations: DataFrame) -> DataFrame:
    """Per entity: are records stored newest first (time never rises along the index)?

    Order breaks are found inside index slots and between adjacent slots' edges.
    """
    rows = prefix.with_slot(observations.select("entity_id", "record_index", "ts"), ["entity_id"], [F.col("record_index")], "_b")
    inner = W.partitionBy("_b").orderBy("record_index")
    local = rows.withColumn("_ok", F.coalesce(F.lag("ts").over(inner) >= F.col("ts"), F.lit(True)))
    edges = local.groupBy("_b").agg(
        F.min("_ok").alias("_ok"), F.count("*").alias("n"),
        F.min_by("ts", "record_index").alias("_head"), F.max_by("ts", "record_index").alias("_tail"))
    outer = W.partitionBy("_b.key").orderBy("_b.number")
    ok = F.col("_ok") & F.coalesce(F.lag("_tail").over(outer) >= F.col("_head"), F.lit(True))
    return edges.select("_b.key.entity_id", "n", ok.alias("_ok")).groupBy("entity_id").agg(
        F.sum("n").alias("records"), F.min("_ok").alias("newest_first"))


def event_sequence(entities: DataFrame, observations: DataFrame, calendar) -> DataFrame:
    """Records and window markers in time order, long form with an exact position.

    At equal times a marker precedes records. Positions come from the slotted ranking, so a hot
    entity is not sorted in one task.
    """
    from tideline.operators.windows import tag_records

    marks = calendar.each_window(entities.select("entity_id"))
    mark = lambda name, ts: marks.select(
        "entity_id", "window_year", F.lit(name).alias("event"), F.col(ts).alias("ts"),
        F.lit(0).alias("_late"), F.lit(-1).cast("bigint").alias("record_index"))
    known = entities.select("entity_id")
    records = tag_records(observations.join(known, "entity_id", "left_semi"), calendar).select(
        "entity_id", "window_year", F.col("side").alias("event"), "ts", F.lit(1).alias("_late"), "record_index")
    merged = records.unionByName(mark("window_start", "window_start")).unionByName(mark("window_end", "window_end"))
    return prefix.ranked(merged, ["entity_id", "window_year"],
                         [F.col("ts"), F.col("_late"), F.col("record_index")], "position").drop("_late")


def context_extremes(context: DataFrame) -> DataFrame:
    """Per year the closest and farthest two-sided context among windows without records.

    min_by/max_by keep one row per partial aggregate instead of ranking the whole year.
    """
    two = context.where(F.col("eligible") & (F.col("inside_n") == 0)
                        & F.col("pre_gap_days").isNotNull() & F.col("post_gap_days").isNotNull()) \
        .withColumn("gap_sum", F.col("pre_gap_days") + F.col("post_gap_days"))
    key = F.struct("gap_sum", "entity_id")
    best = two.groupBy("window_year").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return best.select("window_year", F.inline(F.array(
        F.struct(F.lit("closest").alias("example"), F.col("lo.entity_id"), F.round("lo.gap_sum", 6).alias("gap_sum")),
        F.struct(F.lit("farthest").alias("example"), F.col("hi.entity_id"), F.round("hi.gap_sum", 6).alias("gap_sum")))))
