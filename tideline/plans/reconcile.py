"""Reconciliation, set and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import evidence, features, labels, prefix, reconcile
from tideline.operators.windows import Calendar, Window, _ntz, tag_records
from tideline.plans import bindings as b
from tideline.plans.bindings import ALL_OBS, CONTEXT, ENTITIES, OBS, PAIRS, TAGGED, WIN, with_ctes
from tideline.plans.evidence import (CAL, CONTEXT_CTES, EVIDENCE_CTES, FEATURE_CTES, LABEL_CTES, MODEL_CTES,
                                     context_of, evidence_of, features_of, labels_of)
from tideline.plans.registry import query
from tideline.session import durable
from datetime import timedelta
from functools import reduce

# The older version of the calendar: whole days, one day longer at both ends.
WIDE = Calendar.of([Window(w.year, w.start_date - timedelta(days=1), w.end_date + timedelta(days=1),
                           w.start - timedelta(days=1), w.end + timedelta(days=1)) for w in CAL.windows])

OLD_INSIDE = """old_inside AS (
  SELECT o.*, w.window_year, w.window_start, w.window_end, w.start_date FROM obs o JOIN win w
  ON o.ts >= w.window_start - INTERVAL 1 DAY AND o.ts < w.window_end + INTERVAL 1 DAY)"""


@query("key_reconciliation", "J5", with_ctes(ENTITIES, OBS, body="""
, l AS (SELECT entity_id, count(*) AS n FROM entities GROUP BY 1), r AS (SELECT entity_id, count(*) AS n FROM obs GROUP BY 1)
SELECT count(*) FILTER (WHERE r.n IS NULL) AS only_left, count(*) FILTER (WHERE l.n IS NULL) AS only_right,
  count(*) FILTER (WHERE l.n IS NOT NULL AND r.n IS NOT NULL) AS "both", count(*) FILTER (WHERE l.n > 1) AS duplicate_left,
  count(*) FILTER (WHERE r.n > 1) AS duplicate_right FROM l FULL JOIN r USING (entity_id)""").replace("\n, l AS", ", l AS"))
def key_reconciliation(spark, d):
    return reconcile.key_reconciliation(b.entities(spark, d), b.observations(spark, d), ["entity_id"])


@query("checked_merge", "J6", """
SELECT o_orderkey, o_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""")
def checked_merge(spark, d):
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cust = b.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return reconcile.checked_join(orders, cust, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment", "o_totalprice")


@query("merge_agreement", "J6", with_ctes(*CONTEXT_CTES, INSIDE := b.INSIDE, b.EVIDENCE, body="""
SELECT c."column", count(*) FILTER (WHERE same) AS agree, count(*) FILTER (WHERE NOT same) AS differ FROM (
  SELECT 'category' AS "column", e.category IS NOT DISTINCT FROM x.category AS same FROM evidence e JOIN context x USING (entity_id, window_year)
  UNION ALL SELECT 'window_start', e.window_start IS NOT DISTINCT FROM x.window_start FROM evidence e JOIN context x USING (entity_id, window_year)) c GROUP BY 1"""))
def merge_agreement(spark, d):
    ev = evidence_of(spark, d)
    return reconcile.agreement(ev, context_of(spark, d), ["entity_id", "window_year"], ["category", "window_start"])


@query("saved_evidence_reconciliation", "J8", with_ctes(*EVIDENCE_CTES, body="""
, saved AS (SELECT entity_id, window_year, CASE WHEN entity_id % 50 = 7 THEN records + 1 ELSE records END AS records,
    CASE WHEN entity_id % 70 = 9 THEN 'B' ELSE category END AS category FROM evidence WHERE eligible AND category IS DISTINCT FROM 'C')
SELECT entity_id, window_year, 'records' AS field, CAST(s.records AS VARCHAR) AS saved, CAST(e.records AS VARCHAR) AS recomputed
FROM saved s JOIN evidence e USING (entity_id, window_year) WHERE s.records IS DISTINCT FROM e.records
UNION ALL SELECT entity_id, window_year, 'category', s.category, e.category FROM saved s JOIN evidence e USING (entity_id, window_year) WHERE s.category IS DISTINCT FROM e.category
UNION ALL SELECT entity_id, window_year, 'row_missing_in_saved', NULL, NULL FROM evidence WHERE eligible AND category = 'C'
""").replace("\n, saved", ", saved"))
def saved_evidence_reconciliation(spark, d):
    """A saved table with planted errors and without its C rows, recomputed from the raw records.

    Pairs of unknown histories have no category; the saved table keeps them.
    """
    now = evidence_of(spark, d).where("eligible") \
        .select("entity_id", "window_year", "records", "category")
    k = F.col("entity_id")
    saved = now.where("NOT (category <=> 'C')").select(
        "entity_id", "window_year", F.when(k % 50 == 7, F.col("records") + 1).otherwise(F.col("records")).alias("records"),
        F.when(k % 70 == 9, "B").otherwise(F.col("category")).alias("category"))
    return reconcile.saved_mismatches(saved, now, ["entity_id", "window_year"], ["records", "category"])


FIELDS = ("price", "price_currency", "regular", "cut", "deal_status", "kind")
DEFECT = "SELECT entity_id, window_year, record_index, {0} AS defect, {1} AS saved, {2} AS recomputed FROM {3}"


@query("saved_record_reconciliation", "J8 L5", with_ctes(ALL_OBS, WIN, body="""
, ins AS (SELECT o.*, w.window_year, w.window_start, w.window_end, record_index % 101 AS m FROM all_obs o JOIN win w ON ts >= window_start AND ts < window_end WHERE shop_id = 61),
saved AS (SELECT * REPLACE (CASE WHEN m = 3 THEN -record_index ELSE record_index END AS record_index, CASE WHEN m = 7 THEN price + 1 ELSE price END AS price,
    CASE WHEN m = 11 THEN 'XXX' ELSE price_currency END AS price_currency, CASE WHEN m = 13 THEN window_end ELSE ts END AS ts),
    unnest(CASE m WHEN 17 THEN [1, 2] WHEN 19 THEN []::INTEGER[] ELSE [1] END) AS copy FROM ins),
plain AS (SELECT DISTINCT ON (entity_id, window_year, record_index) * FROM saved)
""" + "\nUNION ALL ".join([
    DEFECT.format("'not_in_history'", "NULL", "NULL", "saved WHERE m = 3"), DEFECT.format("'outside_window'", "'out'", "NULL", "saved WHERE m = 13"),
    DEFECT.format("'field:ts'", "'out'", "'in'", "saved WHERE m = 13"), DEFECT.format("'field:price'", "'raised'", "'as is'", "saved WHERE m = 7 AND price IS NOT NULL"),
    DEFECT.format("'field:price_currency'", "'XXX'", "(SELECT price_currency FROM all_obs o WHERE o.entity_id = s.entity_id AND o.record_index = s.record_index)", "saved s WHERE m = 11"),
    DEFECT.format("'repeated'", "'2'", "'1'", "plain WHERE m = 17"), DEFECT.format("'missing'", "NULL", "NULL", "ins WHERE m IN (3, 19)")])).replace("\n, ins AS", ", ins AS"))
def saved_record_reconciliation(spark, d):
    """Saved evidence records with one defect of each kind planted, held against the history."""
    obs = b.observations(spark, d)
    rows = evidence.inside_records(obs, CAL).withColumn("m", F.col("record_index") % 101)
    c, m = F.col, F.col("m")
    saved = rows.where("m <> 19").withColumns({
        "record_index": F.when(m == 3, -c("record_index")).otherwise(c("record_index")), "price": F.when(m == 7, c("price") + 1).otherwise(c("price")),
        "price_currency": F.when(m == 11, "XXX").otherwise(c("price_currency")), "ts": F.when(m == 13, c("window_end")).otherwise(c("ts"))})
    saved = saved.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(m == 17, 2).otherwise(1))))
    found = reconcile.record_mismatches(saved, obs, CAL, FIELDS)
    # Times and prices are told by name here, so the twin needs no number formats.
    saved_text = F.when(c("defect").isin("outside_window", "field:ts"), "out").when(c("defect") == "field:price", "raised").otherwise(c("saved"))
    other = F.when(c("defect") == "field:ts", "in").when(c("defect") == "field:price", "as is").otherwise(c("recomputed"))
    return found.withColumns({"saved": saved_text, "recomputed": other})


@query("saved_lineage_reconciliation", "L5 L3", with_ctes(*FEATURE_CTES, body="""
, used AS (SELECT t.entity_id, t.window_year, t.record_index FROM tagged t JOIN pairs p USING (entity_id, window_year) WHERE side = 'before' AND kind <> 'ambiguous' AND p.eligible),
c AS (SELECT entity_id, window_year, count(*) FILTER (WHERE record_index % 53 = 5) AS gone, count(*) FILTER (WHERE record_index % 59 = 7) AS again, count(*) AS n FROM used GROUP BY 1, 2),
f AS (SELECT f.*, coalesce(gone, 0) AS gone, coalesce(again, 0) AS again, entity_id % 41 = 3 AS stale, entity_id % 43 = 4 AS miscounted, entity_id % 47 = 5 AS dropped
  FROM feat f LEFT JOIN c USING (entity_id, window_year))
SELECT entity_id, window_year, CAST(gone AS BIGINT) AS missing_indexes, CAST(again AS BIGINT) AS extra_indexes, dropped OR miscounted AS count_differs,
  CASE WHEN dropped THEN last_observed_price IS NOT NULL ELSE stale AND last_observed_price IS NOT NULL END AS last_price_differs, dropped AS row_unmatched FROM f
WHERE gone > 0 OR again > 0 OR dropped OR miscounted OR (stale AND last_observed_price IS NOT NULL)""").replace("\n, used AS", ", used AS"))
def saved_lineage_reconciliation(spark, d):
    """Saved feature rows and their record indexes with planted defects, held against the records."""
    ents, obs, c = b.entities(spark, d), b.observations(spark, d), F.col
    used = features.lineage(ents, obs, CAL).where("used").select("entity_id", "window_year", "record_index")
    saved = used.where("record_index % 53 <> 5").unionByName(used.where("record_index % 59 = 7 AND record_index % 53 <> 5")).unionByName(
        used.where("record_index % 59 = 7 AND record_index % 53 = 5").withColumn("record_index", -c("record_index")))
    now = features_of(spark, d)
    k = c("entity_id")
    kept = now.where("entity_id % 47 <> 5").withColumns({
        "last_observed_price": F.when(k % 41 == 3, c("last_observed_price") + 1).otherwise(c("last_observed_price")),
        "prior_price_record_count": F.when(k % 43 == 4, c("prior_price_record_count") + 1).otherwise(c("prior_price_record_count"))})
    return reconcile.lineage_mismatches(saved, used, kept, now)


VERSION_SQL = OLD_INSIDE + """,
cur AS (SELECT t.entity_id, t.window_year, t.record_index FROM tagged t JOIN pairs p USING (entity_id, window_year) WHERE side = 'inside' AND p.eligible),
old AS (SELECT o.entity_id, o.window_year, o.record_index, o.ts, o.window_start, o.window_end FROM old_inside o WHERE deal_status = 'object'),
chg AS (SELECT coalesce(o.entity_id, c.entity_id) AS entity_id, coalesce(o.window_year, c.window_year) AS window_year,
    coalesce(o.record_index, c.record_index) AS record_index,
    CASE WHEN c.entity_id IS NULL THEN 'removed' WHEN o.entity_id IS NULL THEN 'added' ELSE 'kept' END AS change,
    CASE WHEN c.entity_id IS NULL THEN CASE WHEN o.ts < o.window_start THEN 'before_exact_start' WHEN o.ts >= o.window_end THEN 'at_or_after_exact_end'
      ELSE 'ineligible_release_date' END END AS reason
  FROM old o FULL JOIN cur c ON o.entity_id = c.entity_id AND o.window_year = c.window_year AND o.record_index = c.record_index)"""


def version_changes_of(spark, d):
    obs = b.observations(spark, d)
    # The older version used wider windows and left null deals out.
    old = evidence.inside_records(obs.where("deal_status = 'object'"), WIDE).select(
        "entity_id", "window_year", "record_index", "ts",
        F.timestamp_add("DAY", F.lit(1), F.col("window_start")).alias("exact_start"),
        F.timestamp_add("DAY", F.lit(-1), F.col("window_end")).alias("exact_end"))
    known = b.entities(spark, d).select("entity_id", "release_date")
    new = evidence.inside_records(obs, CAL).join(known, "entity_id").where(F.col("release_date") <= F.col("start_date")) \
        .select("entity_id", "window_year", "record_index")
    reason = (F.when(F.col("old_ts") < F.col("old_exact_start"), "before_exact_start")
              .when(F.col("old_ts") >= F.col("old_exact_end"), "at_or_after_exact_end")
              .otherwise("ineligible_release_date"))
    return reconcile.version_changes(old, new, ["entity_id", "window_year", "record_index"], reason)


@query("boundary_version_changes", "J9", with_ctes(ENTITIES, OBS, WIN, PAIRS, TAGGED, VERSION_SQL, body="""
SELECT * FROM chg WHERE change <> 'kept'"""))
def boundary_version_changes(spark, d):
    return version_changes_of(spark, d).where("change <> 'kept'")


@query("boundary_version_balance", "J9", with_ctes(ENTITIES, OBS, WIN, PAIRS, TAGGED, VERSION_SQL, body="""
SELECT window_year, count(*) FILTER (WHERE change <> 'added') AS old_records, count(*) FILTER (WHERE change = 'removed') AS removed,
  count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change <> 'removed') AS new_records,
  count(*) FILTER (WHERE reason = 'before_exact_start') AS removed_before, count(*) FILTER (WHERE reason = 'at_or_after_exact_end') AS removed_after
FROM chg GROUP BY 1"""))
def boundary_version_balance(spark, d):
    c = F.col("change")
    return version_changes_of(spark, d).groupBy("window_year").agg(
        F.count_if(c != "added").alias("old_records"), F.count_if(c == "removed").alias("removed"),
        F.count_if(c == "added").alias("added"), F.count_if(c != "removed").alias("new_records"),
        F.count_if(F.col("reason") == "before_exact_start").alias("removed_before"),
        F.count_if(F.col("reason") == "at_or_after_exact_end").alias("removed_after"))


@query("discount_exclusions", "J10", with_ctes(OBS, WIN, TAGGED, body="""
, bad AS (SELECT entity_id, ts FROM obs GROUP BY 1, 2 HAVING count(DISTINCT sig) > 1)
SELECT t.entity_id, t.window_year, t.record_index, CASE WHEN bad.entity_id IS NOT NULL THEN 'conflicting_same_time_records'
  WHEN kind <> 'discount' THEN 'not_a_discount_observation' WHEN price_currency <> 'USD' OR regular_currency <> 'USD' THEN 'not_comparable_currency' END AS exclusion
FROM tagged t LEFT JOIN bad ON bad.entity_id = t.entity_id AND bad.ts = t.ts WHERE side = 'inside'""").replace("\n, bad", ", bad"))
def discount_exclusions(spark, d):
    obs = b.observations(spark, d)
    return reconcile.exclusions(evidence.inside_records(obs, CAL), evidence.conflicts(obs), ["entity_id", "ts"]) \
        .select("entity_id", "window_year", "record_index", "exclusion")


@query("table_version_multiset_diff", "U2", """
WITH o AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber <> 7),
n AS (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber = 3 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem),
oc AS (SELECT *, count(*) AS c FROM o GROUP BY ALL), nc AS (SELECT *, count(*) AS c FROM n GROUP BY ALL),
m AS (SELECT coalesce(oc.c, 0) AS a, coalesce(nc.c, 0) AS z FROM oc FULL JOIN nc USING (l_orderkey, l_partkey, l_quantity))
SELECT CAST(sum(a) AS BIGINT) AS old_rows, CAST(sum(z) AS BIGINT) AS new_rows, CAST(sum(greatest(a - z, 0)) AS BIGINT) AS removed_rows,
  CAST(sum(greatest(z - a, 0)) AS BIGINT) AS added_rows, sum(abs(a - z)) = 0 AS identical FROM m""")
def table_version_multiset_diff(spark, d):
    li = b.table(spark, d, "lineitem")
    old = li.where("l_linenumber <> 7").select("l_orderkey", "l_partkey", "l_quantity")
    new = li.select("l_orderkey", "l_partkey", F.when(F.col("l_linenumber") == 3, F.col("l_quantity") + 1)
                    .otherwise(F.col("l_quantity")).alias("l_quantity"))
    return reconcile.multiset_diff(old, new)


@query("moved_rows", "U2", """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, CASE WHEN o_custkey % 50 = 1 THEN -o_orderkey ELSE o_orderkey END) AS p FROM orders)
SELECT o_orderkey, o.p AS old_position, n.p AS new_position FROM o JOIN n USING (o_orderkey) WHERE o.p <> n.p""")
def moved_rows(spark, d):
    orders = b.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.lit(1).alias("all"))
    key = F.when(F.col("o_custkey") % 50 == 1, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    old = prefix.ranked(orders, ["all"], [F.col("o_orderdate"), F.col("o_orderkey")], "p")
    new = prefix.ranked(orders, ["all"], [F.col("o_orderdate"), key], "p")
    return reconcile.moved_rows(old, new, ["o_orderkey"], "p")


@query("key_set_relations", "U3", """
WITH l AS (SELECT DISTINCT c_custkey AS k FROM customer), r AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT count(*) FILTER (WHERE r.k IS NULL) AS left_only, count(*) FILTER (WHERE l.k IS NULL) AS right_only,
  count(*) FILTER (WHERE l.k IS NOT NULL AND r.k IS NOT NULL) AS shared,
  count(*) FILTER (WHERE r.k IS NULL OR l.k IS NULL) = 0 AS equal, count(*) FILTER (WHERE r.k IS NULL) = 0 AS left_nested,
  count(*) FILTER (WHERE l.k IS NOT NULL AND r.k IS NOT NULL) = 0 AS disjoint FROM l FULL JOIN r ON l.k = r.k""")
def key_set_relations(spark, d):
    cust = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return reconcile.set_relations(cust, b.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("equivalence_except_name", "U4", with_ctes(ENTITIES, body="""
SELECT entity_id, name AS old_value, upper(name) AS new_value, true AS other_columns_identical FROM entities WHERE entity_id % 400 = 17"""))
def equivalence_except_name(spark, d):
    old = b.entities(spark, d).select("entity_id", "name", "publisher", "price", "release_date")
    new = old.withColumn("name", F.when(F.col("entity_id") % 400 == 17, F.upper("name")).otherwise(F.col("name")))
    same = reconcile.multiset_diff(old.drop("name"), new.drop("name")).select("identical").scalar()
    return reconcile.differing_names(old, new, "entity_id", "name").withColumn("other_columns_identical", same)


@query("table_fingerprint", "U5")
def table_fingerprint(spark, d):
    parts = [reconcile.fingerprint(b.table(spark, d, n)).select(F.lit(n).alias("table"), "*")
             for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
                       "benchmark", "labels", "conversations")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Columns of the fingerprinted tables with the kind of value they hold.
FINGERPRINTED = {
    "nation": "n_nationkey:i n_name:s n_regionkey:i", "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s", "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:a label:i", "labels": "doc_id:i quality:i toxic:i"}
AS_TEXT = {"i": "CAST({} AS VARCHAR)", "s": "{}", "d": "CAST(CAST({} AS DECIMAL(38,9)) AS VARCHAR)", "t": "strftime({}, '%Y-%m-%d %H:%M:%S.%f')",
           "a": "array_to_string(list_transform({}, lambda x: CAST(CAST(CAST(x AS DOUBLE) AS DECIMAL(38,9)) AS VARCHAR)), ',')"}


def fingerprint_sql(table, columns):
    texts = [AS_TEXT[kind].format(name) for name, kind in sorted(x.split(":") for x in columns.split())]
    row = " || ".join(f"coalesce(CAST(strlen({t}) AS VARCHAR) || ':' || {t}, '-')" for t in texts)
    sums = " || '-' || ".join(f"CAST(coalesce(sum(CAST(CAST('0x' || substring(h, {15 * i + 1}, 15) AS UBIGINT) AS HUGEINT)), 0) AS VARCHAR)" for i in range(4))
    return f"SELECT '{table}' AS \"table\", count(*) AS \"rows\", {sums} AS fingerprint FROM (SELECT sha256({row}) AS h FROM {table})"


@query("table_fingerprint_neutral", "U5", " UNION ALL ".join(fingerprint_sql(t, c) for t, c in FINGERPRINTED.items()))
def table_fingerprint_neutral(spark, d):
    parts = [reconcile.neutral_fingerprint(b.table(spark, d, n)).select(F.lit(n).alias("table"), "*") for n in FINGERPRINTED]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("canonical_order", "K5", with_ctes(*EVIDENCE_CTES, body="""
SELECT entity_id, window_year, category, row_number() OVER (ORDER BY entity_id, window_year) AS position FROM evidence"""))
def canonical_order(spark, d):
    ev = evidence_of(spark, d) \
        .select("entity_id", "window_year", "category").withColumn("_all", F.lit(1))
    return prefix.ranked(ev, ["_all"], [F.col("entity_id"), F.col("window_year")], "position").drop("_all")


@query("identical_duplicates", "A28", with_ctes(b.ALL_OBS, body="""
, c AS (SELECT entity_id, ts, shop_id, shop_name, deal_status, price, price_amount_int, price_currency, regular, regular_amount_int, regular_currency, cut, count(*) AS n
  FROM all_obs GROUP BY ALL)
SELECT entity_id, CAST(sum(n) AS BIGINT) AS records, CAST(sum(n - 1) AS BIGINT) AS identical_duplicates FROM c GROUP BY 1""").replace("\n, c AS", ", c AS"))
def identical_duplicates(spark, d):
    return reconcile.excess_duplicates(b.all_observations(spark, d))


@query("layered_resolution", "S8", """
WITH a AS (SELECT l_partkey AS k, min(l_quantity) AS q FROM lineitem WHERE l_discount = 0 GROUP BY 1),
z AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS q FROM part)
SELECT k, q, 0 AS layer FROM a UNION ALL SELECT k, q, 1 FROM z WHERE k NOT IN (SELECT k FROM a)""")
def layered_resolution(spark, d):
    first = b.table(spark, d, "lineitem").where("l_discount = 0").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_quantity").alias("q"))
    second = b.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("q"))
    return reconcile.resolve_layers([first, second], "k")


@query("raw_support_mismatches", "L5", with_ctes(*FEATURE_CTES, body="""
SELECT entity_id, window_year, 'prior_discount_count' AS field, CAST(prior_discount_count + 1 AS VARCHAR) AS saved, CAST(prior_discount_count AS VARCHAR) AS recomputed
FROM feat WHERE entity_id % 60 = 13"""))
def raw_support_mismatches(spark, d):
    """Saved feature counts (with planted errors) against counts taken from the raw records."""
    f = features_of(spark, d)
    k = F.col("entity_id")
    saved = f.select("entity_id", "window_year", "prior_price_record_count",
                     F.when(k % 60 == 13, F.col("prior_discount_count") + 1).otherwise(F.col("prior_discount_count")).alias("prior_discount_count"))
    lines = features.lineage_summary(b.entities(spark, d), b.observations(spark, d), CAL)
    raw = f.select("entity_id", "window_year").join(lines, ["entity_id", "window_year"], "left").select(
        "entity_id", "window_year", F.coalesce("valid_records", F.lit(0)).alias("prior_price_record_count"),
        F.coalesce("discount_records", F.lit(0)).alias("prior_discount_count"))
    return reconcile.saved_mismatches(saved, raw, ["entity_id", "window_year"], ["prior_price_record_count", "prior_discount_count"])


@query("headline_facts", "L7", with_ctes(*MODEL_CTES, body="""
, facts AS (
  SELECT 'pairs' AS fact, count(*) AS value FROM lab UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM lab
  UNION ALL SELECT 'positives', count(*) FILTER (WHERE discount_observed = 1) FROM lab UNION ALL SELECT 'zeros', count(*) FILTER (WHERE discount_observed = 0) FROM lab
  UNION ALL SELECT 'unknown_histories', count(*) FILTER (WHERE eligibility_status = 'unknown_history') FROM lab
  UNION ALL SELECT 'records_in_windows', CAST(sum(records) AS BIGINT) FROM lab UNION ALL SELECT 'feature_rows', count(*) FROM feat)
SELECT fact, CASE WHEN fact = 'published_elsewhere' THEN NULL ELSE value END AS value,
  CASE fact WHEN 'zeros' THEN NULL WHEN 'records_in_windows' THEN value + 1 ELSE value END AS expected,
  CASE fact WHEN 'zeros' THEN 'unexpected' WHEN 'records_in_windows' THEN 'differs' WHEN 'published_elsewhere' THEN 'missing' ELSE 'matches' END AS outcome
FROM (SELECT * FROM facts UNION ALL SELECT 'published_elsewhere', 7)""").replace("\n, facts", ", facts"))
def headline_facts(spark, d):
    """Facts from the operators against facts counted on the plain tables, with one missing, one unexpected and one wrong."""
    lab, y = durable(labels_of(spark, d)), F.col("discount_observed")
    fact = lambda rows, name, value: rows.agg(F.lit(name).alias("fact"), F.coalesce(value, F.lit(0)).cast("bigint").alias("value"))
    actual = reduce(lambda p, q: p.unionByName(q), [
        fact(lab, "pairs", F.count("*")), fact(lab, "entities", F.count_distinct("entity_id")), fact(lab, "positives", F.count_if(y == 1)),
        fact(lab, "zeros", F.count_if(y == 0)), fact(lab, "unknown_histories", F.count_if(F.col("eligibility_status") == "unknown_history")),
        fact(lab, "records_in_windows", F.sum("records")), fact(features_of(spark, d), "feature_rows", F.count("*"))])
    ents, years = b.known_entities(spark, d), len(CAL.windows)
    early = CAL.each_window(ents).where("release_date <= start_date")
    status = F.coalesce("history_status", F.lit("absent"))
    seen = CAL.each_window(b.observations(spark, d).join(ents.select("entity_id", "release_date", status.alias("s")), "entity_id")) \
        .where("ts >= window_start AND ts < window_end AND release_date <= start_date AND s IN ('valid', 'partial')")
    hits = seen.where("kind = 'discount' AND s = 'valid'").select("entity_id", "window_year").distinct()
    expected = reduce(lambda p, q: p.unionByName(q), [
        fact(ents, "pairs", F.count("*") * years), fact(ents, "entities", F.count("*")), fact(hits, "positives", F.count("*")),
        fact(early.where(status != "valid"), "unknown_histories", F.count("*")), fact(seen, "records_in_windows", F.count("*") + 1),
        fact(early, "feature_rows", F.count("*")), fact(ents, "published_elsewhere", F.min(F.lit(7)))])
    return reconcile.fact_reconciliation(actual, expected)


@query("headline_reconciliation", "L7", with_ctes(*MODEL_CTES, body="""
, facts AS (
  SELECT 'pairs' AS fact, count(*) AS value FROM lab UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM lab
  UNION ALL SELECT 'positives', count(*) FILTER (WHERE discount_observed = 1) FROM lab
  UNION ALL SELECT 'label_category_mismatch', count(*) FILTER (WHERE model_eligible AND (category = 'A') <> (discount_observed = 1)) FROM lab
  UNION ALL SELECT 'missing_last_price', count(*) - count(last_observed_price) FROM feat)
SELECT fact, value, CASE fact WHEN 'label_category_mismatch' THEN CAST(0 AS BIGINT) END AS expected,
  value IS NOT DISTINCT FROM CASE fact WHEN 'label_category_mismatch' THEN CAST(0 AS BIGINT) END AS matches FROM facts""").replace("\n, facts", ", facts"))
def headline_reconciliation(spark, d):
    lab = labels_of(spark, d)
    y = F.col("discount_observed")
    per_entity = lab.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.count_if(y == 1).alias("pos"),
        F.count_if(F.col("model_eligible") & ((F.col("category") == "A") != (y == 1))).alias("bad"))
    facts = per_entity.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("*").alias("entities"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("bad"), F.lit(0)).alias("label_category_mismatch")) \
        .unpivot([], ["pairs", "entities", "positives", "label_category_mismatch"], "fact", "value")
    missing = features_of(spark, d).agg(F.lit("missing_last_price").alias("fact"),
                                        F.count_if(F.col("last_observed_price").isNull()).alias("value"))
    return reconcile.expected_values(facts.unionByName(missing), {"label_category_mismatch": 0})
