"""Deterministic sampling: hash priorities, quotas, interleaving, caps, extreme cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions import rules
from tideline.operators import prefix


def with_priority(df: DataFrame, id_col: str = "entity_id", prefix_text: str = "42|") -> DataFrame:
    return df.withColumn("priority", rules.hash_priority(F.col(id_col), prefix_text))


def rank_in_stratum(df: DataFrame, stratum: str, id_col: str = "entity_id") -> DataFrame:
    """Exact rank by (priority, id) in each stratum, spread over slots."""
    return prefix.ranked(df, [stratum], [F.col("priority"), F.col(id_col)], "stratum_rank")


def interleave(df: DataFrame, stratum: str, strata: Sequence[str]) -> DataFrame:
    """Global systematic rank over strata: order by (2r-1)/(2n), ties by stratum name.

    Each row's rank is counted directly: for every stratum k, the number of its members with a
    smaller key, in exact integers. No global sort; strata are a fixed, named list.
    """
    names = sorted(strata)
    ranked = rank_in_stratum(df.where(F.col(stratum).isin(*names)), stratum)
    sizes = df.where(F.col(stratum).isin(*names)).agg(F.array(*[
        F.count_if(F.col(stratum) == n) for n in names])).scalar()
    rows = ranked.withColumn("_n", sizes)
    own = F.lit(None).cast("bigint")
    for i, n in enumerate(names):
        own = F.when(F.col(stratum) == n, F.col("_n")[i]).otherwise(own)
    rows = rows.withColumn("stratum_size", own)
    rank = F.lit(1).cast("bigint")
    for i, name in enumerate(names):
        # Members of stratum k below this row: odd numbers 2s-1 < (2r-1) * n_k / n_h.
        q = f"((2 * stratum_rank - 1) * _n[{i}])"
        below = F.expr(f"least(_n[{i}], ({q} div stratum_size + if({q} % stratum_size > 0, 1, 0)) div 2)")
        tie = F.expr(f"{q} % stratum_size = 0 AND ({q} div stratum_size) % 2 = 1") & (F.lit(name) < F.col(stratum))
        rank = rank + F.when(F.col(stratum) == name, F.col("stratum_rank") - 1) \
            .otherwise(below + F.when(tie, 1).otherwise(0))
    return rows.withColumn("sample_rank", rank.cast("bigint")).drop("_n")


def nested_cohorts(ranked: DataFrame, sizes: Sequence[int], always: int = 0) -> DataFrame:
    """``included_in_N`` flags from the sample rank; ``always`` seats are taken already."""
    return ranked.select("*", *[(F.col("sample_rank") <= n - always).cast("int").alias(f"included_in_{n}")
                                for n in sizes])


def cohort_composition(ranked: DataFrame, stratum: str, sizes: Sequence[int], always: int = 0) -> DataFrame:
    """Members per cohort and stratum with the inclusion probability."""
    cut = F.array(*[F.lit(n) for n in sizes])
    counts = ranked.groupBy(stratum).agg(
        F.count("*").alias("stratum_size"),
        F.array(*[F.count_if(F.col("sample_rank") <= n - always) for n in sizes]).alias("m"))
    return counts.select(stratum, "stratum_size", F.posexplode("m").alias("i", "members"), cut.alias("c")) \
        .select(stratum, "stratum_size", F.col("c")[F.col("i")].alias("cohort_size"), "members",
                F.round(F.col("members") / F.col("stratum_size"), 9).alias("inclusion_probability"))


def sqrt_quotas(sizes: DataFrame, total: int | Column, position: str, size: str,
                within: Sequence[str] = ()) -> DataFrame:
    """Largest-remainder quotas proportional to sqrt(size), ties by position.

    Works on the table of strata (a handful of rows per parent), so its windows stay small.
    """
    parent = W.partitionBy(*within) if within else W.partitionBy(F.lit(1))
    total = F.lit(total) if isinstance(total, int) else total
    weight = F.sqrt(F.col(size).cast("double"))
    exact = sizes.withColumn("_exact", total * weight / F.sum(weight).over(parent)) \
        .withColumn("_base", F.floor("_exact"))
    rest = W.partitionBy(*(within or [F.lit(1)])).orderBy(F.desc(F.col("_exact") - F.col("_base")), position)
    left = total - F.sum("_base").over(parent)
    return exact.withColumn("_place", F.row_number().over(rest)) \
        .withColumn("_left", left).withColumn(
            "quota", (F.col("_base") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).cast("int")) \
        .drop("_exact", "_base", "_place", "_left")


def capped_pick(df: DataFrame, quotas: DataFrame, stratum: Sequence[str], owner: str, cap: int = 2) -> DataFrame:
    """Take each stratum's quota by hash order with at most ``cap`` entities per owner.

    The cap is a constant rank filter, which Spark turns into a per-task limit before the
    shuffle; ranks inside a stratum use hash buckets.
    """
    by_owner = W.partitionBy(owner).orderBy("priority", "entity_id")
    capped = df.withColumn("_o", F.row_number().over(by_owner)).where(F.col("_o") <= cap).drop("_o")
    ranked = prefix.ranked(capped, list(stratum), [F.col("priority"), F.col("entity_id")], "pick")
    return ranked.join(quotas, list(stratum)).where(F.col("pick") <= F.col("quota"))


def extreme_cases(df: DataFrame, criteria: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Tag one entity per criterion and join the reasons of each.

    A criterion is (condition, order): the row with the smallest order among those that satisfy
    the condition. All criteria are found in one aggregate.
    """
    picks = df.agg(F.array(*[F.struct(
        F.lit(reason).alias("reason"),
        F.min_by("entity_id", F.when(cond, order)).alias("entity_id"))
        for reason, (cond, order) in criteria.items()]).alias("a")).select(F.inline("a"))
    return picks.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"))


def membership_checks(subset: DataFrame, superset: DataFrame, key: str = "entity_id") -> DataFrame:
    """Subset rows missing from the superset, and duplicated keys of the subset."""
    missing = subset.join(superset, key, "left_anti").agg(F.count("*").alias("missing"))
    dup = subset.groupBy(key).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1)).scalar()
    return missing.select("missing", dup.alias("duplicate_keys"))


def overlap_count(left: DataFrame, right: DataFrame, key: str = "entity_id") -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_semi").agg(F.count("*").alias("shared"))
