"""Catalog cleaning, profiling and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rules
from tideline.operators import prefix
from tideline.operators.windows import Calendar

# Date formats seen in catalogs, band names and edges.
DATE_FORMATS = ("yyyy-MM-dd", "MMM d, yyyy")
PRICE_BANDS = ("Low price", "Lower-mid price", "Upper-mid price", "High price")
RELEASE_STRATA = ("before_2015", "2015_2019", "2020_2022", "2023_before_sale")


def rule_columns(*, id_text="id_text", name="name", release="release_text", price="price_text",
                 formats: Sequence[str] = DATE_FORMATS) -> dict[str, Column]:
    """Failure condition of each cleaning rule, in order."""
    number = F.col(id_text).try_cast("double")
    amount = F.col(price).try_cast("double")
    id_ok = (number > 0) & (number <= rules.MAX_ID) & (number == F.floor(number))
    checks = {
        "invalid_id": ~id_ok,
        "missing_name": F.trim(name) == "",
        "invalid_release_date": rules.mixed_date(F.col(release), formats).isNull(),
        "invalid_price": amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")),
        "non_positive_price": amount <= 0,
    }
    return {k: F.coalesce(v, F.lit(True)) for k, v in checks.items()}


def rule_audit(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Per rule: rows failing on the input, and rows it removes after the earlier rules."""
    names = list(checks)
    flagged = df.select(*[checks[n].alias(f"_f{i}") for i, n in enumerate(names)])
    sums = []
    for i, _ in enumerate(names):
        fresh = F.col(f"_f{i}")
        for j in range(i):
            fresh = fresh & ~F.col(f"_f{j}")
        sums.append(F.struct(F.lit(i).alias("step"), F.lit(names[i]).alias("rule"),
                             F.count_if(F.col(f"_f{i}")).alias("failing"),
                             F.count_if(fresh).alias("removed")))
    return flagged.agg(F.array(*sums).alias("a")).select(F.inline("a"))


def clean(df: DataFrame, checks: Mapping[str, Column], formats=DATE_FORMATS) -> DataFrame:
    """Typed rows that pass every rule."""
    keep = F.lit(True)
    for failed in checks.values():
        keep = keep & ~failed
    release = rules.mixed_date(F.col("release_text"), formats)
    return df.where(keep).select(
        F.col("id_text").try_cast("double").cast("bigint").alias("entity_id"),
        F.trim("name").alias("name"), release.alias("release_date"),
        F.year(release).alias("release_year"), F.col("price_text").try_cast("double").alias("price"))


def master_violations(master: DataFrame) -> DataFrame:
    """Post-clean contract, one row per rule; duplicate ids from a pre-aggregated count."""
    from tideline.operators.features import count_violations

    c = F.col
    per_id = master.groupBy("entity_id").agg(F.count("*").alias("_n"))
    rules_part = count_violations(master, {
        "id_range": ~c("entity_id").between(1, rules.MAX_ID),
        "blank_name": F.trim("name") == "",
        "date_year": F.year("release_date") != c("release_year"),
        "price": ~((c("price") > 0) & (c("price") < float("inf")))})
    dup = per_id.agg(F.lit("duplicate_id").alias("rule"), F.count_if(c("_n") > 1).alias("violations"))
    return rules_part.unionByName(dup)


def date_report(df: DataFrame, column: str, formats=DATE_FORMATS) -> DataFrame:
    parsed = rules.mixed_date(F.col(column), formats)
    raw = F.col(column)
    return df.agg(F.count("*").alias("rows"), F.count_if(raw.isNull()).alias("nulls"),
                  F.count_if(raw == "").alias("empty"), F.count(parsed).alias("parsed"),
                  F.count_if(parsed.isNull() & raw.isNotNull()).alias("failed"),
                  F.min(parsed).alias("earliest"), F.max(parsed).alias("latest"))


def date_failures(df: DataFrame, column: str, formats=DATE_FORMATS) -> DataFrame:
    """Distinct values that no format parses, with counts."""
    return df.where(F.col(column).isNotNull() & rules.mixed_date(F.col(column), formats).isNull()) \
        .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def coercion_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values, values that are not numbers, and range after coercion."""
    number = lambda c: F.col(c).try_cast("double")
    return df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.count(c).alias("present"),
        F.count_if(F.col(c).isNotNull() & number(c).isNull()).alias("not_numeric"),
        F.min(number(c)).alias("low"), F.max(number(c)).alias("high")) for c in columns])
        .alias("a")).select(F.inline("a"))


def strict_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast optional numeric columns; a bad value fails the job instead of becoming null."""
    cast = {c: F.when(F.col(c).isNull(), None).otherwise(F.coalesce(
        F.col(c).try_cast("double"),
        F.raise_error(F.concat(F.lit(f"not numeric in {c}: "), F.col(c))).cast("double"))) for c in columns}
    return df.withColumns(cast)


# ------------------------------------------------------------------ bands
def quartile_bands(df: DataFrame, value: str, names: Sequence[str] = PRICE_BANDS) -> DataFrame:
    """Right-closed bands at exact quartiles; fails when quartiles are not distinct."""
    q = prefix.quantiles(df, [], value, {"q1": .25, "q2": .5, "q3": .75})
    edges = q.select(F.struct("q1", "q2", "q3")).scalar()
    rows = df.withColumn("_q", edges)
    q1, q2, q3 = (F.col(f"_q.q{i}") for i in (1, 2, 3))
    v = F.col(value)
    named = F.when(v <= q1, names[0]).when(v <= q2, names[1]).when(v <= q3, names[2]).otherwise(names[3])
    distinct = (q1 < q2) & (q2 < q3)
    return rows.withColumn("price_band", F.when(distinct, named).otherwise(
        F.raise_error(F.lit("quartiles are not distinct")).cast("string"))).drop("_q")


def release_stratum(release: Column, bounds=(2015, 2020, 2023, 2024), names=RELEASE_STRATA) -> Column:
    """Stratum by release year; ``bounds`` are exclusive upper years."""
    year = F.year(release)
    expr = F.when(release.isNull(), "unknown_release_date")
    for bound, name in zip(bounds, names):
        expr = expr.when(year < bound, name)
    return expr.otherwise("outside_historical_frame")


def owner_group(upper: Column) -> Column:
    return (F.when(upper == 0, "zero").when(upper <= 20000, "low").when(upper <= 50000, "middle")
            .when(upper.isNotNull(), "high"))


def activity_classes(df: DataFrame, value: str, fraction: float = 0.9) -> DataFrame:
    """Zero / below / at-or-above the given percentile of the non-zero values."""
    cut = prefix.quantiles(df.where(F.col(value) > 0), [], value, {"q": fraction}).select("q").scalar()
    v = F.col(value)
    return df.withColumn("activity_group", F.when(v == 0, "zero").when(v < cut, "below_high").otherwise("high"))


# ------------------------------------------------------------------ profiles
def null_profile(df: DataFrame) -> DataFrame:
    """Per column: nulls and empty strings, one pass."""
    total = F.count("*")
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"),
                      F.round(100.0 * F.count_if(F.col(c).isNull()) / total, 6).alias("null_percent"),
                      (F.count_if(F.col(c) == "") if t == "string" else F.lit(0).cast("bigint")).alias("empty"))
             for c, t in df.dtypes]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def categorical_profile(df: DataFrame, columns: Sequence[str], *, show_all: int = 30,
                        top: int = 10, bottom: int = 3) -> DataFrame:
    """Most and least frequent values per column; all of them when there are few.

    Value counts are pre-aggregated; the two rank filters become partial per-task limits.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                        for c in columns]))).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count("*").alias("rows"))
    sizes = counts.groupBy("column").agg(F.count("*").alias("distinct_values"))
    keep = max(show_all, top)
    best = W.partitionBy("column").orderBy(F.desc("rows"), "value")
    worst = W.partitionBy("column").orderBy("rows", F.desc("value"))
    upper = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep) \
        .join(sizes, "column").where((F.col("distinct_values") <= show_all) | (F.col("r") <= top)) \
        .select("column", "value", "rows", "distinct_values", F.lit("top").alias("part"), F.col("r").alias("position"))
    lower = counts.withColumn("r", F.row_number().over(worst)).where(F.col("r") <= bottom) \
        .join(sizes, "column").where(F.col("distinct_values") > show_all) \
        .select("column", "value", "rows", "distinct_values", F.lit("bottom").alias("part"), F.col("r").alias("position"))
    return upper.unionByName(lower)


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, nulls, mean, sample std, min, quartiles, max per column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                        for c in columns])))
    base = long.groupBy("column").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"),
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"),
        F.min("v").alias("low"), F.max("v").alias("high"))
    q = prefix.quantiles(long, ["column"], "v", {"q25": .25, "median": .5, "q75": .75})
    return base.join(q, "column", "left").select(
        "column", "n", "nulls", "mean", "std", "low", "high",
        *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")])


def suspicious_counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()]).unpivot([], list(checks), "flag", "rows")


def n_largest(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(column), tie).limit(n).select(tie, column)


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Excess full-row duplicates, ids that repeat, and the rows beyond one per id."""
    full = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    by_row = full.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    by_id = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).agg(
        F.count_if(F.col("_n") > 1).alias("repeated_ids"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("excess_id_rows"),
        F.count("*").alias("distinct_ids"))
    return by_id.select(by_row.scalar().alias("duplicate_rows"), "*")


def top_repeated(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1) \
        .orderBy(F.desc("rows"), key).limit(n)


def catalog_audit(catalog: DataFrame) -> DataFrame:
    """Identifier and date quality totals of a text catalog."""
    ident, day = F.col("id_text"), rules.strict_date(F.col("release_text"))
    ok, blank = rules.valid_id(ident), F.trim(ident) == ""
    blank_date = F.trim("release_text") == ""
    base = catalog.agg(
        F.count("*").alias("records"), F.count_if(blank).alias("missing_ids"),
        F.count_if(~ok & ~blank).alias("invalid_ids"), F.count_if(blank_date).alias("missing_dates"),
        F.count_if(day.isNull() & ~blank_date).alias("invalid_dates"),
        F.count_if(day.isNotNull() & (F.col("release_year_text") != F.year(day).cast("string"))).alias("year_mismatches"))
    per_id = catalog.where(ok).groupBy("id_text").agg(F.count("*").alias("_n")).agg(
        F.struct(F.count("*").alias("unique_ids"), F.count_if(F.col("_n") > 1).alias("duplicate_ids"),
                 F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("excess_rows")))
    return base.withColumn("_i", per_id.scalar()).select("*", "_i.*").drop("_i")


def eligible_everywhere(catalog: DataFrame, calendar: Calendar) -> DataFrame:
    """Entities released on or before (and strictly before) every window start date."""
    first = min(w.start_date for w in calendar.windows)
    day = rules.strict_date(F.col("release_text"))
    return catalog.agg(F.count_if(day <= F.lit(first)).alias("eligible_all"),
                       F.count_if(day < F.lit(first)).alias("strictly_before_all"))


def yearly_counts_dense(df: DataFrame, release: str = "release_date") -> DataFrame:
    """Entities per release year with empty years filled in."""
    counts = df.groupBy(F.year(release).alias("release_year")).agg(F.count("*").alias("entities"))
    years = counts.agg(F.sequence(F.min("release_year"), F.max("release_year")).alias("y")) \
        .select(F.explode("y").alias("release_year"))
    return years.join(counts, "release_year", "left").select(
        "release_year", F.coalesce("entities", F.lit(0)).alias("entities"))


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts between explicit edges; last bin closed; values outside fail the job."""
    v = F.col(value).cast("double")
    bins = len(edges) - 1
    index = F.when((v < edges[0]) | (v > edges[-1]),
                   F.raise_error(F.lit("value outside histogram edges")).cast("int"))
    for i in range(bins - 1):
        index = index.when(v < edges[i + 1], i)
    index = index.otherwise(bins - 1)
    counts = df.where(v.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("lower"), F.lit(float(edges[i + 1])).alias("upper"),
                 F.lit(i == bins - 1).alias("upper_closed")) for i in range(bins)])))
    return grid.join(counts, "bin", "left").select(
        "bin", "lower", "upper", "upper_closed", F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------ multi-value columns
def token_counts(df: DataFrame, column: Column) -> DataFrame:
    return df.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("entities"))


def portfolio_sizes(df: DataFrame, owners: Column) -> DataFrame:
    """Largest portfolio among each entity's owners (0 without owners).

    The per-owner counts meet the exploded rows in a shuffle join; AQE splits a hot owner.
    """
    long = df.select("entity_id", F.explode_outer(owners).alias("token"))
    sizes = long.where(F.col("token").isNotNull()).groupBy("token").agg(F.count("*").alias("size"))
    return long.join(sizes, "token", "left").groupBy("entity_id").agg(
        F.coalesce(F.max("size"), F.lit(0)).alias("portfolio"))


def portfolio_threshold(df: DataFrame, owners: Column, fraction: float = 0.95) -> DataFrame:
    return prefix.quantiles(token_counts(df, owners), [], "entities", {"threshold": fraction})


def coverage_summary(observations: DataFrame, calendar: Calendar) -> DataFrame:
    """Entities with any / valid / discount record and record totals, per window side and overall."""
    from tideline.operators.windows import segment_side

    seg = observations.groupBy("entity_id", calendar.segment(F.col("ts")).alias("segment")).agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") != "ambiguous").alias("v"),
        F.count_if(F.col("kind") == "discount").alias("d"))
    rows = calendar.each_window(seg.repartition("entity_id"), segments=True)
    side = segment_side(F.col("segment"), F.col("first_segment"), F.col("last_segment"))
    per = rows.groupBy("entity_id", "window_year", side.alias("side")).agg(*[F.sum(c).alias(c) for c in "nvd"])
    every = seg.groupBy("entity_id").agg(*[F.sum(c).alias(c) for c in "nvd"]).select(
        "entity_id", F.lit(None).cast("int").alias("window_year"), F.lit("all").alias("side"), *"nvd")
    return per.unionByName(every).groupBy("window_year", "side").agg(
        F.count("*").alias("entities_with_records"), F.count_if(F.col("v") > 0).alias("entities_with_valid"),
        F.count_if(F.col("d") > 0).alias("entities_with_discount"), F.sum("n").alias("records"),
        F.sum("v").alias("valid_records"), F.sum("d").alias("discount_records"))
