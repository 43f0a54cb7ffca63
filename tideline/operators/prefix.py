"""Exact ordered computations that never put one whole group into one task.

A plain window ordered over a group sorts that group in a single task. Here the order axis is cut at
quantiles of a sample of the rows, so slots hold about equal numbers of rows
whatever the values are: narrow ranges far from zero, infinities, or ties told apart by a later order column.
Slot totals are pre-aggregated and running-summed (few rows per group); ranks inside a slot are added on top.
A group holding a third of all rows is thus spread over as many tasks as a third of the partitions,
and results stay exact wherever the cuts fall.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.session import durable

def with_slot(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_slot") -> DataFrame:
    """Add ``name``: (key, slot number), where slot numbers rise along the ascending ``order`` inside each key.

    Range partitioning cuts the axis (keys, order) at quantiles of a sample of these rows, so a slot holds some rows /
    ``spark.sql.shuffle.partitions`` of them at most, or what AQE takes for one small partition. The rows are written with their slots:
    every reader, a re-run task included, sees the same cuts. Null keys are a group of their own. Rows equal in all order columns share a slot.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(1).alias("all"))
    cut = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return durable(cut.withColumn(name, F.struct(key.alias("key"), F.spark_partition_id().alias("number"))))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats null keys as equal, by comparing the keys as one struct."""
    rest = [c for c in right.columns if c not in keys]
    a = left.withColumn("_key", F.struct(*keys))
    b = right.select(F.struct(*keys).alias("_key"), *rest)
    return a.join(b, "_key", how).drop("_key")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], measures: Mapping[str, Column]) -> DataFrame:
    """Add ``<name>_before``: the sum of each measure over earlier rows of the key.

    ``order`` is ascending and must be total inside a key. Rows with null keys are kept as a group of their own.
    """
    rows = with_slot(df, keys, order)
    totals = rows.groupBy("_slot").agg(*[F.sum(m).alias(f"_t_{n}") for n, m in measures.items()])
    earlier = W.partitionBy("_slot.key").orderBy("_slot.number").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_slot", *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in measures])
    local = W.partitionBy("_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.join(offsets, "_slot").select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.coalesce(F.sum(m).over(local), F.lit(0))).alias(f"{n}_before")
          for n, m in measures.items()])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Exact ``row_number`` per key (1-based) along the ascending ``order``, from slot totals."""
    return (prefix_sums(df, keys, order, {"_one": F.lit(1).cast("bigint")})
            .withColumn(name, F.col("_one_before") + 1).drop("_one_before"))


def with_next(df: DataFrame, order: Sequence[Column], columns: Sequence[str], name: str = "next") -> DataFrame:
    """Add ``name``: a struct of ``columns`` of the row that follows in the ascending ``order``; after the last, the first.

    ``order`` must be total. A slot's last row takes the first row of the next slot, from one row per slot.
    """
    rows = with_slot(df, [], order).withColumn("_row", F.struct(*columns))
    heads = rows.groupBy("_slot").agg(F.min_by("_row", F.struct(*order)).alias("_head"))
    chain = W.orderBy("_slot.number")  # a few rows: one for each slot
    first = F.first("_head").over(chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    after = heads.select("_slot", F.coalesce(F.lead("_head").over(chain), first).alias("_after"))
    return rows.join(after, "_slot").select(
        *df.columns, F.coalesce(F.lead("_row").over(W.partitionBy("_slot").orderBy(*order)), F.col("_after")).alias(name))


def _constant_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(1)), ["_all"])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their number of rows; nulls and NaN are left out."""
    v = F.col(value).cast("double")
    return (df.where(v.isNotNull() & ~F.isnan(v))
            .groupBy(*keys, v.alias("value")).agg(F.count("*").alias("copies")))


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              fractions: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per named fraction.

    Distinct values are pre-aggregated; only slots that contain
    a wanted position are ranked.
    """
    src, ks = _constant_key(df, keys)
    out = quantiles_of_counts(value_counts(src, ks, value), ks, fractions)
    return out if keys else out.drop("_all")


def quantiles_of_counts(counts: DataFrame, ks: Sequence[str],
                        fractions: Mapping[str, float]) -> DataFrame:
    """Quantiles of ``value`` rows that each stand for ``copies`` equal values."""
    counts = with_slot(counts, ks, [F.col("value")])
    per_bucket = counts.groupBy("_slot").agg(F.sum("copies").alias("_c"))
    key = W.partitionBy("_slot.key")
    running = key.orderBy("_slot.number").rowsBetween(W.unboundedPreceding, -1)
    placed = per_bucket.select(
        "_slot", "_c", F.coalesce(F.sum("_c").over(running), F.lit(0)).alias("_before"), F.sum("_c").over(key).alias("_n"))
    wanted = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(float(f)).alias("_f"))
                       for n, f in fractions.items()])
    spots = placed.select("*", F.inline(wanted))
    pos = (F.col("_n") - 1) * F.col("_f")
    spots = spots.withColumn("_k0", F.floor(pos)).withColumn("_w", pos - F.floor(pos)) \
        .withColumn("_k1", F.least(F.col("_k0") + 1, F.col("_n") - 1))
    covers = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))
    # At most two slots per wanted fraction: the list below is bounded by the fractions.
    spots = spots.where(covers(F.col("_k0")) | covers(F.col("_k1"))).groupBy("_slot").agg(
        F.max("_before").alias("_before"),
        F.collect_list(F.struct("_name", "_k0", "_k1", "_w")).alias("_wanted"))
    inside = W.partitionBy("_slot").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    hits = counts.join(spots, "_slot").select(
        *ks, "value", "copies", "_wanted",
        (F.col("_before") + F.coalesce(F.sum("copies").over(inside), F.lit(0))).alias("_at")) \
        .select(*ks, "value", "copies", "_at", F.inline("_wanted"))
    at = lambda k: (F.col("_at") <= F.col(k)) & (F.col(k) < F.col("_at") + F.col("copies"))
    pick = lambda n, k: F.max(F.when((F.col("_name") == n) & at(k), F.col("value")))
    weight = lambda n: F.max(F.when(F.col("_name") == n, F.col("_w")))
    return hits.groupBy(*ks).agg(*[
        (pick(n, "_k0") + (pick(n, "_k1") - pick(n, "_k0")) * weight(n)).alias(n)
        for n in fractions])


def average_ranks(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``value, copies`` rows with the tie-averaged rank of each distinct value."""
    placed = prefix_sums(counts, keys, [F.col("value")], {"copies": F.col("copies")})
    return placed.withColumn("rank", F.col("copies_before") + (F.col("copies") + 1) / F.lit(2.0)) \
        .drop("copies_before")


def spearman(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Spearman rho per key from tied average ranks; null when a side is constant."""
    src, ks = _constant_key(df, keys)
    clean = src.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    pairs = clean.groupBy(*ks, F.col(left).cast("double").alias("_x"),
                          F.col(right).cast("double").alias("_y")).agg(F.count("*").alias("_c"))
    rank_of = lambda col, name: average_ranks(
        pairs.groupBy(*ks, F.col(col).alias("value")).agg(F.sum("_c").alias("copies")), ks) \
        .select(*ks, F.col("value").alias(col), F.col("rank").alias(name))
    both = join_on(join_on(pairs, rank_of("_x", "_rx"), [*ks, "_x"]), rank_of("_y", "_ry"), [*ks, "_y"])
    c, rx, ry = (F.col(n).cast("double") for n in ("_c", "_rx", "_ry"))
    sums = both.groupBy(*ks).agg(
        F.sum("_c").alias("n"), F.sum(c * rx * ry).alias("_xy"),
        F.sum(c * rx * rx).alias("_xx"), F.sum(c * ry * ry).alias("_yy"),
        ((F.min("_x") != F.max("_x")) & (F.min("_y") != F.max("_y"))).alias("_varied"))
    mean_square = F.col("n") * ((F.col("n") + 1) / F.lit(2.0)) * ((F.col("n") + 1) / F.lit(2.0))
    rho = (F.col("_xy") - mean_square) / F.sqrt((F.col("_xx") - mean_square) * (F.col("_yy") - mean_square))
    out = sums.select(*ks, "n", F.when(F.col("_varied"), rho).alias("rho"))
    return out if keys else out.drop("_all")
