"""Comparing tables and table versions: keys, multisets, fingerprints, exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tideline.operators.evidence import inside_records
from tideline.operators.windows import Calendar


def key_reconciliation(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only left, only right, in both, and duplicated on either side.

    Both sides are reduced to one row per key first, so a hot key cannot blow up the join.
    """
    keys = list(keys)
    a = left.groupBy(*keys).agg(F.count("*").alias("_l"))
    b = right.groupBy(*keys).agg(F.count("*").alias("_r"))
    return a.join(b, keys, "full_outer").agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"),
        F.count_if(F.col("_l") > 1).alias("duplicate_left"), F.count_if(F.col("_r") > 1).alias("duplicate_right"))


def checked_join(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that fails the job when the right side repeats a key.

    The check is a row filter below the join, so it runs whichever columns are selected above. Keys are reduced to their
    count first; a null key matches nothing and may repeat.
    """
    keys = list(keys)
    rest = [c for c in one.columns if c not in keys]
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    unique = one.where(named).groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    guarded = unique.where(F.when(F.col("_n") == 1, True).otherwise(
        F.raise_error(F.lit("right side repeats a key")).cast("boolean"))).select(*keys, *rest)
    return many.join(guarded, keys, how)


def agreement(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column: joined rows that agree and disagree (null-safe)."""
    keys = list(keys)
    b = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    rows = left.join(b, keys)
    return rows.agg(F.array(*[F.struct(
        F.lit(c).alias("column"), F.count_if(F.col(c).eqNullSafe(F.col(f"_r_{c}"))).alias("agree"),
        F.count_if(~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).alias("differ")) for c in columns]).alias("a")) \
        .select(F.inline("a"))


def saved_mismatches(saved: DataFrame, recomputed: DataFrame, keys: Sequence[str],
                     columns: Sequence[str]) -> DataFrame:
    """Long form of every differing cell between a saved and a recomputed table."""
    keys = list(keys)
    side = lambda df, flag, pre: df.select(*keys, F.lit(True).alias(flag), *[F.col(c).cast("string").alias(f"{pre}{c}") for c in columns])
    rows = side(saved, "_s", "s_").join(side(recomputed, "_c", "c_"), keys, "full_outer")
    cells = F.array_compact(F.array(
        F.when(F.col("_s").isNull(), F.struct(F.lit("row_missing_in_saved").alias("field"), F.lit(None).cast("string").alias("saved"), F.lit(None).cast("string").alias("recomputed"))),
        F.when(F.col("_c").isNull(), F.struct(F.lit("row_missing_in_recomputed").alias("field"), F.lit(None).cast("string").alias("saved"), F.lit(None).cast("string").alias("recomputed"))),
        *[F.when(F.col("_s") & F.col("_c") & ~F.col(f"s_{c}").eqNullSafe(F.col(f"c_{c}")),
                 F.struct(F.lit(c).alias("field"), F.col(f"s_{c}").alias("saved"), F.col(f"c_{c}").alias("recomputed"))) for c in columns]))
    return rows.select(*keys, F.inline(cells))


def _defect(name: str, holds: Column, saved: Column | None = None, recomputed: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    return F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("defect"), text(saved).alias("saved"), text(recomputed).alias("recomputed")))


def record_mismatches(saved: DataFrame, observations: DataFrame, calendar: Calendar, fields: Sequence[str]) -> DataFrame:
    """Every way in which saved in-window records differ from the records they claim to be, one row per record and defect.

    ``saved`` has ``entity_id, window_year, record_index, ts`` and ``fields``; ``observations`` the same without the window, one row for
    each record index of an entity. Defects: ``not_in_history`` (no record has that index), ``field:<name>`` (a value or the time differs),
    ``outside_window`` (the saved time is not in the half-open window, or the year has none), ``repeated`` (the window holds the index more than
    once) and ``missing`` (a record of the window was not saved). Without defects the saved indexes are exactly the window's, as a multiset.
    """
    c, key = F.col, ["entity_id", "window_year", "record_index"]
    window = F.filter(calendar.literal_array(), lambda w: w["window_year"] == c("window_year"))[0]
    names = ["ts", *fields]
    raw = observations.select("entity_id", "record_index", F.struct(*names).alias("_raw"))
    rows = saved.select(*key, *names).withColumn("_w", window).join(raw, ["entity_id", "record_index"], "left")
    inside = (c("ts") >= c("_w.window_start")) & (c("ts") < c("_w.window_end"))
    found = rows.select(*key, F.inline(F.array_compact(F.array(
        _defect("not_in_history", c("_raw").isNull()), _defect("outside_window", ~F.coalesce(inside, F.lit(False)), c("ts")),
        *[_defect(f"field:{n}", c("_raw").isNotNull() & ~c(n).eqNullSafe(c(f"_raw.{n}")), c(n), c(f"_raw.{n}")) for n in names]))))
    none = F.lit(None).cast("string")
    repeated = saved.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(
        *key, F.lit("repeated").alias("defect"), c("_n").cast("string").alias("saved"), F.lit("1").alias("recomputed"))
    missing = inside_records(observations, calendar).select(*key).join(saved.select(*key).distinct(), key, "left_anti").select(
        *key, F.lit("missing").alias("defect"), none.alias("saved"), none.alias("recomputed"))
    return found.unionByName(repeated).unionByName(missing)


def lineage_mismatches(saved: DataFrame, used: DataFrame, saved_features: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs whose saved record indexes or last values are not those of the records: counts of indexes and a flag each.

    ``saved`` and ``used`` hold ``entity_id, window_year, record_index`` of the records that a feature row rests on, as saved and as found
    again; both are compared as multisets. The feature tables hold ``prior_price_record_count`` and ``last_observed_price``: the saved count must be
    the number of indexes found, and the saved price (or its absence) that of the last record before the cutoff.
    """
    c, pair = F.col, ["entity_id", "window_year"]
    one = lambda df, s, u: df.select(*pair, "record_index", F.lit(s).alias("_s"), F.lit(u).alias("_u"))
    per_index = one(saved, 1, 0).unionByName(one(used, 0, 1)).groupBy(*pair, "record_index").agg(F.sum("_s").alias("_s"), F.sum("_u").alias("_u"))
    counts = per_index.groupBy(*pair).agg(
        F.sum(F.greatest(c("_u") - c("_s"), F.lit(0))).alias("missing_indexes"), F.sum(F.greatest(c("_s") - c("_u"), F.lit(0))).alias("extra_indexes"),
        F.sum("_u").alias("_n"))
    cols = ("prior_price_record_count", "last_observed_price")
    rows = saved_features.select(*pair, *[c(x).alias(f"_saved_{x}") for x in cols], F.lit(True).alias("_in_saved")) \
        .join(features.select(*pair, c(cols[1]), F.lit(True).alias("_in_found")), pair, "full_outer").join(counts, pair, "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0)).alias(x)
    out = rows.select(
        *pair, zero("missing_indexes"), zero("extra_indexes"),
        (~c(f"_saved_{cols[0]}").eqNullSafe(F.coalesce("_n", F.lit(0)))).alias("count_differs"),
        (~c(f"_saved_{cols[1]}").eqNullSafe(c(cols[1]))).alias("last_price_differs"),
        (c("_in_saved").isNull() | c("_in_found").isNull()).alias("row_unmatched"))
    return out.where("missing_indexes > 0 OR extra_indexes > 0 OR count_differs OR last_price_differs OR row_unmatched")


def version_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], reason: Column) -> DataFrame:
    """Removed rows with a reason and added rows, by full outer join on the record key.

    ``reason`` may use ``old_*`` columns of the removed row.
    """
    keys = list(keys)
    a = old.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in keys])
    b = new.select(*keys, F.lit(True).alias("_new"))
    joined = a.join(b, keys, "full_outer")
    change = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("kept")
    return joined.select(*keys, change.alias("change"), F.when(change == "removed", reason).alias("reason"))


def exclusions(rows: DataFrame, conflict_keys: DataFrame, keys: Sequence[str], home_currency: str = "USD") -> DataFrame:
    """Why a record cannot enter a discount histogram, first reason wins; null = kept."""
    marked = rows.join(conflict_keys.select(*keys).distinct().withColumn("_conflict", F.lit(True)), list(keys), "left")
    comparable = F.coalesce((F.col("price_currency") == home_currency) & (F.col("regular_currency") == home_currency), F.lit(False))
    reason = (F.when(F.col("_conflict"), "conflicting_same_time_records")
              .when(F.col("kind") != "discount", "not_a_discount_observation")
              .when(~comparable, "not_comparable_currency"))
    return marked.withColumn("exclusion", reason).drop("_conflict")


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row multiset comparison from one grouped union: added, removed, identical."""
    names = old.columns
    both = old.select("*", F.lit(1).alias("_o"), F.lit(0).alias("_n")) \
        .unionByName(new.select(*names, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    per_row = both.groupBy(*names).agg(F.sum("_o").alias("o"), F.sum("_n").alias("n"))
    return per_row.agg(
        F.coalesce(F.sum("o"), F.lit(0)).alias("old_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("new_rows"),
        F.coalesce(F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))), F.lit(0)).alias("removed_rows"),
        F.coalesce(F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))), F.lit(0)).alias("added_rows")) \
        .withColumn("identical", (F.col("removed_rows") == 0) & (F.col("added_rows") == 0))


def moved_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Rows present in both versions whose position changed."""
    a = old.select(*keys, F.col(position).alias("old_position"))
    b = new.select(*keys, F.col(position).alias("new_position"))
    return a.join(b, list(keys)).where(F.col("old_position") != F.col("new_position"))


def set_relations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Set equality, nesting and disjointness of two key columns."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    totals = a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("shared"))
    c = F.col
    return totals.select("*", ((c("left_only") == 0) & (c("right_only") == 0)).alias("equal"),
                         (c("left_only") == 0).alias("left_nested"), (c("shared") == 0).alias("disjoint"))


def differing_names(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Rows where only the named column may differ: old and new value."""
    return old.select(key, F.col(column).alias("old_value")).join(
        new.select(key, F.col(column).alias("new_value")), key) \
        .where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent table fingerprint: row count and exact sum of row hashes."""
    parts: list[Column] = []
    for c in sorted(df.columns):
        parts += [F.col(c), F.col(c).isNull()]
    return df.agg(F.count("*").alias("rows"),
                  F.coalesce(F.sum(F.xxhash64(*parts).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def canonical_text(df: DataFrame) -> Column:
    """A row as text that other engines can write alike: columns by name, each as its length and text, null as ``-``.

    Times are ISO texts to the microsecond, fractions are rounded to nine places, arrays are the texts of their elements.
    """
    def text(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return value.cast("double").try_cast("decimal(38,9)").cast("string")
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.transform(value, lambda x: F.coalesce(text(x, kind.elementType), F.lit("-"))), ",")
        return value.cast("string")

    parts = [text(F.col(f"`{f.name}`"), f.dataType) for f in sorted(df.schema, key=lambda f: f.name)]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def neutral_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): sums of four 60-bit slices of each row's sha256, so order does not matter and any engine with sha256 agrees.

    Equal sums for different row multisets need a collision in 240 bits. The slices are added as decimals, map-side first.
    """
    digest = F.sha2(canonical_text(df).cast("binary"), 256)
    sliced = df.select(*[F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)])
    return sliced.agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]).alias("fingerprint"))


def expected_values(actual: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Headline facts (``fact, value``) next to their expected values."""
    table = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    return actual.select("fact", "value", table[F.col("fact")].alias("expected")) \
        .withColumn("matches", F.col("value").eqNullSafe(F.col("expected")))


def fact_reconciliation(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(fact, value, expected, outcome): headline facts held against a table of expected ones.

    Both have ``fact, value``. Outcomes: matches, differs, missing (expected, not found) and unexpected (found, not expected); a fact given
    twice on a side with unlike values is ``contradictory``.
    """
    def one(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("fact").agg(F.max("value").alias(name), (~F.min("value").eqNullSafe(F.max("value")) | (F.count("value") != F.count("*")) & F.max("value").isNotNull()).alias(f"_{name}"),
                                        F.lit(True).alias(f"_has_{name}"))

    rows = one(actual, "value").join(one(expected, "expected"), "fact", "full_outer")
    c = F.col
    outcome = (F.when(c("_has_value").isNull(), "missing").when(c("_has_expected").isNull(), "unexpected")
               .when(c("_value") | c("_expected"), "contradictory").when(c("value").eqNullSafe(c("expected")), "matches").otherwise("differs"))
    return rows.select("fact", "value", "expected", outcome.alias("outcome"))


def resolve_layers(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """First layer that holds a key wins, even when its copy is bad.

    Layers are tagged and the lowest tag per key is found with a partial aggregate.
    """
    tagged = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("layer", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = W.partitionBy(key).orderBy("layer")
    return tagged.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r")


def excess_duplicates(observations: DataFrame) -> DataFrame:
    """Identical records beyond the first, per entity (two-step, skew-safe counts)."""
    names = [c for c in observations.columns if c not in ("entity_id", "record_index", "kind", "issue")]
    copies = observations.groupBy("entity_id", *names).agg(F.count("*").alias("_n"))
    return copies.groupBy("entity_id").agg(F.sum("_n").alias("records"), F.sum(F.col("_n") - 1).alias("identical_duplicates"))
