"""Journal, manifest, ledger and scalar-function queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import intake, observations as obs_ops, prefix
from tideline.operators.windows import Calendar, Window
from tideline.plans import bindings as b
from tideline.plans.bindings import ALL_OBS, ENTITIES, WIN, with_ctes
from tideline.plans.evidence import CAL
from tideline.plans.registry import query
from tideline.session import durable


def journal(spark, d):
    """The events table as an attempt journal with a few planted defects."""
    e = b.table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "attempt").when(F.col("event_type") == "signup", "round").otherwise("result")
    rows = e.select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("entity_id"), kind.alias("kind"), F.lit(1).alias("all"),
        F.when(F.col("value") < 20, "lookup").otherwise("history").alias("endpoint"),
        F.when(F.col("event_type") == "purchase", 200).when(F.col("event_type") == "error", F.when(F.col("event_id") % 50 == 1, 999).otherwise(500)).alias("http_status"))
    order = [F.col("pos")]
    counted = prefix.prefix_sums(rows, ["all"], order, {"attempts": F.when(F.col("kind") == "attempt", 1).otherwise(0).cast("bigint")})
    counted = prefix.prefix_sums(counted, ["entity_id"], order, {"rounds": F.when(F.col("kind") == "round", 1).otherwise(0).cast("bigint")})
    slip = F.when(F.col("pos") % 101 == 5, 1).otherwise(0)
    # The derived numbers are written once, as a real journal would hold them.
    return durable(counted.select(
        "pos", "entity_id", "kind", "endpoint", "http_status",
        F.when(F.col("kind") == "attempt", F.col("attempts_before") + 1 + slip)
        .when(F.col("kind") == "result", F.greatest(F.lit(1), F.col("attempts_before") - F.col("pos") % 5)).cast("bigint").alias("sequence"),
        F.when(F.col("kind") == "round", F.col("rounds_before") + 1 + slip).when(F.col("kind") == "attempt", F.col("rounds_before")).cast("bigint").alias("round")))


JOURNAL = """j0 AS (
  SELECT event_id AS pos, user_id AS entity_id, CASE WHEN event_type IN ('click', 'view') THEN 'attempt' WHEN event_type = 'signup' THEN 'round' ELSE 'result' END AS kind,
    CASE WHEN value < 20 THEN 'lookup' ELSE 'history' END AS endpoint,
    CASE WHEN event_type = 'purchase' THEN 200 WHEN event_type = 'error' THEN CASE WHEN event_id % 50 = 1 THEN 999 ELSE 500 END END AS http_status FROM events),
j1 AS (
  SELECT *, coalesce(count(*) FILTER (WHERE kind = 'attempt') OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ab,
    coalesce(count(*) FILTER (WHERE kind = 'round') OVER (PARTITION BY entity_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb FROM j0),
journal AS (
  SELECT pos, entity_id, kind, endpoint, http_status, rb,
    CASE WHEN kind = 'attempt' THEN ab + 1 + CASE WHEN pos % 101 = 5 THEN 1 ELSE 0 END WHEN kind = 'result' THEN greatest(1, ab - pos % 5) END AS sequence,
    CASE WHEN kind = 'round' THEN rb + 1 + CASE WHEN pos % 101 = 5 THEN 1 ELSE 0 END WHEN kind = 'attempt' THEN rb END AS round FROM j1)"""


@query("journal_counts", "A31", with_ctes(JOURNAL, body="""
SELECT count(*) FILTER (WHERE kind = 'attempt') AS attempts, count(*) FILTER (WHERE kind = 'result' AND http_status = 200) AS successful,
  count(*) FILTER (WHERE kind = 'result' AND http_status <> 200) AS failed,
  count(*) FILTER (WHERE kind = 'attempt') - count(*) FILTER (WHERE kind = 'result') AS unknown_outcome FROM journal"""))
def journal_counts(spark, d):
    return intake.journal_counts(journal(spark, d))


@query("journal_integrity", "W13", with_ctes(JOURNAL, body="""
, att AS (SELECT *, row_number() OVER (ORDER BY pos) AS expected FROM journal WHERE kind = 'attempt'),
res AS (SELECT sequence, count(*) AS n, min(pos) AS first_pos FROM journal WHERE kind = 'result' GROUP BY 1),
made AS (SELECT sequence, min(pos) AS made FROM journal WHERE kind = 'attempt' GROUP BY 1)
SELECT 'attempt_sequence' AS rule, count(*) FILTER (WHERE sequence <> expected) AS violations FROM att
UNION ALL SELECT 'round_sequence', count(*) FILTER (WHERE kind = 'round' AND round <> rb + 1) FROM journal
UNION ALL SELECT 'attempt_round', count(*) FILTER (WHERE kind = 'attempt' AND round <> rb) FROM journal
UNION ALL SELECT 'http_status', count(*) FILTER (WHERE kind = 'result' AND NOT http_status BETWEEN 100 AND 599) FROM journal
UNION ALL SELECT 'repeated_result', CAST(sum(n - 1) AS BIGINT) FROM res
UNION ALL SELECT 'result_without_earlier_attempt', count(*) FILTER (WHERE made IS NULL OR made > first_pos) FROM res LEFT JOIN made USING (sequence)
""").replace("\n, att", ", att"))
def journal_integrity(spark, d):
    return intake.journal_violations(journal(spark, d))


@query("attempt_usage", "W14", with_ctes(JOURNAL, body="""
SELECT entity_id, endpoint, round, pos, row_number() OVER (PARTITION BY entity_id, endpoint, round ORDER BY pos) AS use, row_number() OVER (ORDER BY pos) AS overall,
  row_number() OVER (PARTITION BY entity_id, endpoint, round ORDER BY pos) > 3 OR row_number() OVER (ORDER BY pos) > 3000 AS over_cap
FROM journal WHERE kind = 'attempt'"""))
def attempt_usage(spark, d):
    return intake.attempt_usage(journal(spark, d), 3, 3000)


def cohort_status(spark, d):
    k = F.col("entity_id")
    status = F.when(k % 10 < 6, "valid").when(k % 10 == 6, "invalid").when(k % 10 <= 8, "incomplete").otherwise("absent")
    return b.entities(spark, d).select(
        k.alias("position"), "entity_id", status.alias("status"),
        F.when(k % 10 == 8, "matched").when(k % 10 == 7, "lookup_error").alias("lookup_status"),
        F.when(k % 20 == 8, "not_requested").when(k % 20 == 18, "request_failed").alias("history_status"), (k % 33 == 4).alias("stale"))


PLAN = """st AS (SELECT entity_id, CASE WHEN entity_id % 10 < 6 THEN 'valid' WHEN entity_id % 10 = 6 THEN 'invalid' WHEN entity_id % 10 <= 8 THEN 'incomplete' ELSE 'absent' END AS status,
    entity_id % 10 = 8 AS matched, entity_id % 20 = 8 AS interrupted, entity_id % 33 = 4 AS stale FROM entities),
todo AS (SELECT *, status = 'incomplete' AND matched AND NOT stale AS reuse_lookup FROM st WHERE stale OR status = 'absent' OR (status = 'incomplete' AND ({retry} OR interrupted)))
SELECT entity_id AS position, entity_id, reuse_lookup, stale OR ({retry} AND status = 'incomplete' AND NOT interrupted) AS new_round, CASE WHEN reuse_lookup THEN 1 ELSE 2 END AS requests FROM todo"""


@query("work_plan", "W15", "WITH " + ENTITIES + ",\n" + PLAN.format(retry="false"))
def work_plan(spark, d):
    return intake.plan_work(cohort_status(spark, d), retry_failed=False)


@query("work_plan_retry_first_twenty", "W15", "WITH " + ENTITIES + ",\n" + PLAN.format(retry="true") + " ORDER BY entity_id LIMIT 20")
def work_plan_retry_first_twenty(spark, d):
    return intake.plan_work(cohort_status(spark, d), retry_failed=True, limit=20)


def manifest(spark, d):
    k = F.col("entity_id")
    return obs_ops.history_diagnostics(b.all_observations(spark, d), b.SHOP).select(
        "*", F.when(k % 25 == 3, "not_found").otherwise("matched").alias("lookup_status"),
        F.when(k % 25 == 3, "lookup_not_found").when(k % 40 == 7, "request_failed").when(k % 60 == 9, "empty_history")
        .otherwise("history_received").alias("history_status"))


MANIFEST = """manifest AS (
  SELECT entity_id, count(*) AS records, count(*) FILTER (WHERE shop_id = 61) AS own_shop_records, count(*) FILTER (WHERE shop_id <> 61) AS other_shop_records,
    min(ts) FILTER (WHERE shop_id = 61) AS first_ts, max(ts) FILTER (WHERE shop_id = 61) AS last_ts,
    CASE WHEN entity_id % 25 = 3 THEN 'not_found' ELSE 'matched' END AS lookup_status,
    CASE WHEN entity_id % 25 = 3 THEN 'lookup_not_found' WHEN entity_id % 40 = 7 THEN 'request_failed' WHEN entity_id % 60 = 9 THEN 'empty_history' ELSE 'history_received' END AS history_status
  FROM all_obs GROUP BY entity_id)"""


@query("manifest_rollup", "A30", with_ctes(ALL_OBS, MANIFEST, body="""
SELECT count(*) AS entities, count(*) FILTER (WHERE lookup_status = 'matched') AS matched, count(*) FILTER (WHERE lookup_status = 'not_found') AS not_found,
  count(*) FILTER (WHERE history_status IN ('history_received', 'empty_history')) AS successful, count(*) FILTER (WHERE history_status = 'history_received') AS nonempty,
  count(*) FILTER (WHERE history_status = 'empty_history') AS empty, count(*) FILTER (WHERE history_status = 'request_failed') AS failed,
  CAST(sum(records) AS BIGINT) AS records, CAST(sum(own_shop_records) AS BIGINT) AS own_shop_records, CAST(sum(other_shop_records) AS BIGINT) AS other_shop_records,
  min(first_ts) FILTER (WHERE history_status = 'history_received') AS earliest_from, max(first_ts) FILTER (WHERE history_status = 'history_received') AS earliest_to,
  min(last_ts) FILTER (WHERE history_status = 'history_received') AS latest_from, max(last_ts) FILTER (WHERE history_status = 'history_received') AS latest_to,
  min(records) FILTER (WHERE history_status IN ('history_received', 'empty_history')) AS fewest, max(records) FILTER (WHERE history_status IN ('history_received', 'empty_history')) AS most,
  round(quantile_cont(records, 0.5) FILTER (WHERE history_status IN ('history_received', 'empty_history')), 6) AS median_records FROM manifest"""))
def manifest_rollup(spark, d):
    return intake.manifest_rollup(manifest(spark, d))


@query("manifest_boundaries", "A30", with_ctes(ALL_OBS, MANIFEST, WIN, body="""
SELECT window_year, count(*) FILTER (WHERE CAST(first_ts AS DATE) < start_date) AS observed_before_start,
  count(*) FILTER (WHERE CAST(last_ts AS DATE) > end_date) AS observed_after_end
FROM manifest CROSS JOIN win WHERE history_status IN ('history_received', 'empty_history') GROUP BY 1"""))
def manifest_boundaries(spark, d):
    return intake.boundary_coverage(manifest(spark, d), CAL)


@query("snapshot_receipts", "P23", """
SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-11-21' AS received_before_cutoff,
  round(epoch_us(o_orderdate) / 86400e6 - epoch_us(TIMESTAMP '1998-11-21') / 86400e6, 6) AS days_after_cutoff,
  CASE WHEN o_orderdate < TIMESTAMP '1998-11-21' THEN 'receipt_before_cutoff' ELSE 'later_snapshot_proves_nothing' END AS interpretation FROM orders""")
def snapshot_receipts(spark, d):
    rows = b.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return intake.receipt_evidence(rows, "o_orderdate", F.lit("1998-11-21").cast("timestamp_ntz")).drop("o_orderdate")


# ------------------------------------------------------------------ evidence ledger
LEDGER_WINDOWS = Calendar.of([Window(2024, date(2024, 1, 5), date(2024, 1, 20), datetime(2024, 1, 5), datetime(2024, 1, 20))])


def ledger(spark, d):
    e, k = b.table(spark, d, "events"), F.col("event_id")
    seen, claims = k % 4 != 0, (k % 4 != 0) & (F.col("event_type") == "purchase")
    full = k % 16 == 7
    span = lambda day: F.when(full, F.lit(day).cast("timestamp_ntz"))
    return e.select(
        k.alias("attempt_id"), F.col("user_id").alias("entity_id"), F.lit(2024).alias("window_year"),
        F.concat(F.when(k % 70 == 3, "http://").otherwise("https://"), F.lit("example.org/"), (k % 10).cast("string")).alias("source_url"),
        F.when(seen, F.col("ts")).alias("observed_ts"), F.when(seen, F.col("value")).alias("observed_price"),
        F.when(seen, F.col("value") + k % 3).alias("regular_price"), F.when(seen, 10.0).alias("discount_percent"),
        F.when(seen | (k % 90 == 4), "USD").alias("currency"), F.when(seen, "US").alias("region"),
        (k % 5 != 0).alias("page_accessible"), seen.alias("observation_available"), claims.alias("supports_discount"),
        full.alias("supports_absence"), (k % 11 == 2).alias("contradicts"),
        span("2024-01-01").alias("coverage_start"), F.when(full, F.when(k % 32 == 7, F.lit("2024-01-25").cast("timestamp_ntz"))
                                                         .otherwise(F.lit("2024-01-15").cast("timestamp_ntz"))).alias("coverage_end"),
        F.when(k % 20 == 13, F.when(k % 60 == 13, k - 10).otherwise(k - 3)).alias("reuse_of"))


def ledger_pairs(spark, d):
    """Users with a large event, and overdrawn suppliers, for which nothing was recorded."""
    return b.table(spark, d, "events").where("value > 60").select(F.col("user_id").alias("entity_id")).distinct() \
        .withColumn("window_year", F.lit(2024)).unionByName(
            b.table(spark, d, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") + 1000000).alias("entity_id"), F.lit(2024).alias("window_year")))


LEDGER = """ledger AS (
  SELECT event_id AS attempt_id, user_id AS entity_id, CASE WHEN event_id % 70 = 3 THEN 'http://' ELSE 'https://' END || 'example.org/' || (event_id % 10) AS source_url,
    CASE WHEN event_id % 4 <> 0 THEN ts END AS observed_ts, CASE WHEN event_id % 4 <> 0 THEN value END AS observed_price,
    CASE WHEN event_id % 4 <> 0 THEN value + event_id % 3 END AS regular_price, event_id % 4 <> 0 AS seen,
    CASE WHEN event_id % 4 <> 0 OR event_id % 90 = 4 THEN 'USD' END AS currency,
    event_id % 5 <> 0 AS page_accessible, event_id % 4 <> 0 AND event_type = 'purchase' AS supports_discount, event_id % 16 = 7 AS supports_absence,
    event_id % 11 = 2 AS contradicts, CASE WHEN event_id % 16 = 7 THEN CASE WHEN event_id % 32 = 7 THEN TIMESTAMP '2024-01-25' ELSE TIMESTAMP '2024-01-15' END END AS coverage_end,
    CASE WHEN event_id % 20 = 13 THEN CASE WHEN event_id % 60 = 13 THEN event_id - 10 ELSE event_id - 3 END END AS reuse_of FROM events),
lp AS (SELECT DISTINCT user_id AS entity_id FROM events WHERE value > 60 UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_acctbal < 0)"""


@query("ledger_validation", "P22", with_ctes(LEDGER, body="""
SELECT 'source_address' AS rule, count(*) FILTER (WHERE source_url NOT LIKE 'https://%') AS violations FROM ledger
UNION ALL SELECT 'future_observation', count(*) FILTER (WHERE observed_ts >= TIMESTAMP '2024-02-01') FROM ledger
UNION ALL SELECT 'fabricated_fields', count(*) FILTER (WHERE NOT seen AND currency IS NOT NULL) FROM ledger
UNION ALL SELECT 'unsupported_claim', count(*) FILTER (WHERE NOT seen AND (supports_discount OR supports_absence)) FROM ledger
UNION ALL SELECT 'inaccessible_observation', count(*) FILTER (WHERE seen AND NOT page_accessible) FROM ledger
UNION ALL SELECT 'observation_without_time', CAST(0 AS BIGINT)
UNION ALL SELECT 'discount_claim', count(*) FILTER (WHERE supports_discount AND NOT (observed_ts >= TIMESTAMP '2024-01-05' AND observed_ts < TIMESTAMP '2024-01-20' AND observed_price < regular_price)) FROM ledger
UNION ALL SELECT 'absence_claim', count(*) FILTER (WHERE supports_absence AND NOT coverage_end >= TIMESTAMP '2024-01-20') FROM ledger
UNION ALL SELECT 'reuse_reference', count(*) FILTER (WHERE b.attempt_id IS NULL OR a.source_url <> b.source_url) FROM ledger a LEFT JOIN ledger b ON b.attempt_id = a.reuse_of WHERE a.reuse_of IS NOT NULL
UNION ALL SELECT 'duplicate_attempt', count(*) - count(DISTINCT attempt_id) FROM ledger
UNION ALL SELECT 'outside_selected_pairs', count(*) FILTER (WHERE entity_id NOT IN (SELECT entity_id FROM lp)) FROM ledger
UNION ALL SELECT 'pair_without_attempt', count(*) FILTER (WHERE entity_id NOT IN (SELECT entity_id FROM ledger)) FROM lp"""))
def ledger_validation(spark, d):
    return intake.ledger_violations(ledger(spark, d), ledger_pairs(spark, d), LEDGER_WINDOWS, F.lit("2024-02-01").cast("timestamp_ntz"))


def reviewed_ledger(spark, d):
    """The ledger with provenance and with claims in several pieces; each rule is broken by some attempts."""
    k = F.col("attempt_id")
    seen, full = F.col("observation_available"), F.col("supports_absence")
    day = lambda text: F.lit(text).cast("timestamp_ntz")
    return ledger(spark, d).withColumns({
        "supports_absence": k % 4 == 3,
        "source_id": F.concat(F.lit("s"), (k % 10).cast("string")),
        "conflict": F.when(k % 13 == 5, "MAYBE").when(~seen & (k % 7 != 4), "NOT_ASSESSABLE").when(F.col("contradicts"), "YES").otherwise("NO"),
        "store_explicit": seen & (k % 17 != 3), "verifiable": F.when(seen | (k % 29 == 8), k % 19 != 4).otherwise(False),
        "purchase_scope": F.when(seen & (k % 23 != 6), "base"),
        "coverage_kind": F.when(k % 31 == 9, "sampled").otherwise("continuous_documented_complete"),
        "completeness_url": F.concat(F.when(k % 37 == 10, "http").otherwise("https"), F.lit("://example.org/complete")),
        "coverage_proof": F.when(k % 41 == 11, " ").otherwise("log"),
        "coverage_start": F.when(k % 3 == 0, day("2024-01-01")).when(k % 3 == 1, day("2024-01-09")).otherwise(day("2024-01-14")),
        "coverage_end": F.when(k % 3 == 0, day("2024-01-10")).when(k % 3 == 1, F.when(k % 8 == 3, day("2024-01-14")).otherwise(day("2024-01-13"))).when(k % 43 == 2, day("2024-03-01")).otherwise(day("2024-01-25"))})


REVIEWED = LEDGER + """,
rev AS (SELECT attempt_id, entity_id, 2024 AS window_year, seen, supports_discount, attempt_id % 4 = 3 AS absent, attempt_id % 10 AS source,
    CASE WHEN attempt_id % 13 = 5 THEN 'MAYBE' WHEN NOT seen AND attempt_id % 7 <> 4 THEN 'NOT_ASSESSABLE' WHEN contradicts THEN 'YES' ELSE 'NO' END AS conflict,
    seen AND attempt_id % 17 <> 3 AS store, (seen OR attempt_id % 29 = 8) AND attempt_id % 19 <> 4 AS verifiable, seen AND attempt_id % 23 <> 6 AS scoped, currency,
    attempt_id % 31 <> 9 AND attempt_id % 37 <> 10 AND attempt_id % 41 <> 11 AS documented,
    CASE attempt_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-01' WHEN 1 THEN TIMESTAMP '2024-01-09' ELSE TIMESTAMP '2024-01-14' END AS a,
    CASE attempt_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-10' WHEN 1 THEN CASE WHEN attempt_id % 8 = 3 THEN TIMESTAMP '2024-01-14' ELSE TIMESTAMP '2024-01-13' END
      ELSE CASE WHEN attempt_id % 43 = 2 THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-01-25' END END AS z FROM ledger)"""


@query("ledger_provenance", "P22", with_ctes(REVIEWED, body="""
SELECT 'conflict_value' AS rule, count(*) FILTER (WHERE conflict = 'MAYBE') AS violations FROM rev
UNION ALL SELECT 'conflict_without_observation', count(*) FILTER (WHERE NOT seen AND conflict <> 'NOT_ASSESSABLE') FROM rev
UNION ALL SELECT 'verified_without_observation', count(*) FILTER (WHERE NOT seen AND verifiable) FROM rev
UNION ALL SELECT 'discount_scope', count(*) FILTER (WHERE supports_discount AND NOT (store AND verifiable AND scoped)) FROM rev
UNION ALL SELECT 'absence_scope', count(*) FILTER (WHERE absent AND NOT (store AND verifiable AND scoped)) FROM rev
UNION ALL SELECT 'absence_documentation', count(*) FILTER (WHERE absent AND NOT documented) FROM rev
UNION ALL SELECT 'unknown_source', count(*) FILTER (WHERE source = 9) FROM rev
UNION ALL SELECT 'repeated_source', CAST(1 AS BIGINT)"""))
def ledger_provenance(spark, d):
    """Sources s0 to s8 are in the inventory, s4 twice."""
    sources = b.table(spark, d, "events").select((F.col("event_id") % 10).alias("s")).distinct().where("s < 9") \
        .select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("source_id"), F.explode(F.sequence(F.lit(1), F.when(F.col("s") == 4, 2).otherwise(1))))
    return intake.ledger_provenance_violations(reviewed_ledger(spark, d), sources)


@query("ledger_absence_coverage", "P22", with_ctes(REVIEWED, body="""
, iv AS (SELECT entity_id, greatest(a, TIMESTAMP '2024-01-05') AS a, least(z, TIMESTAMP '2024-01-20') AS z FROM rev
  WHERE absent AND store AND verifiable AND scoped AND documented AND z <= TIMESTAMP '2024-02-01'),
isl AS (SELECT *, a > max(z) OVER (PARTITION BY entity_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fresh FROM iv),
num AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY entity_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM isl),
run AS (SELECT entity_id, island, min(a) AS a, max(z) AS z FROM num GROUP BY 1, 2), head AS (SELECT * FROM run WHERE island = 0)
SELECT p.entity_id, 2024 AS window_year, coalesce(h.a = TIMESTAMP '2024-01-05' AND h.z = TIMESTAMP '2024-01-20', false) AS covered,
  CASE WHEN h.a IS NULL OR h.a > TIMESTAMP '2024-01-05' THEN TIMESTAMP '2024-01-05' WHEN h.z < TIMESTAMP '2024-01-20' THEN h.z END AS first_gap
FROM (SELECT DISTINCT entity_id FROM rev WHERE absent) p LEFT JOIN head h USING (entity_id)""").replace("\n, iv AS", ", iv AS"))
def ledger_absence_coverage(spark, d):
    return intake.absence_coverage(reviewed_ledger(spark, d), LEDGER_WINDOWS, F.lit("2024-02-01").cast("timestamp_ntz"))


@query("ledger_summary", "A32", with_ctes(LEDGER, body="""
, f AS (SELECT entity_id, bool_or(page_accessible) AS a, bool_or(seen) AS o, bool_or(supports_discount) AS s, bool_or(supports_absence) AS n, bool_or(contradicts) AS c FROM ledger GROUP BY 1)
SELECT count(*) AS pairs, count(*) FILTER (WHERE a) AS accessible_pairs, count(*) FILTER (WHERE o) AS observed_pairs, count(*) FILTER (WHERE s) AS positive_pairs,
  count(*) FILTER (WHERE n) AS absence_pairs, count(*) FILTER (WHERE o AND NOT s AND NOT n) AS partial_pairs, count(*) FILTER (WHERE c) AS conflicting_pairs,
  count(*) FILTER (WHERE NOT coalesce(o, false)) AS not_verifiable_pairs FROM lp LEFT JOIN f USING (entity_id)""").replace("\n, f AS", ", f AS"))
def ledger_summary(spark, d):
    return intake.ledger_summary(ledger(spark, d), ledger_pairs(spark, d))


# ------------------------------------------------------------------ scalar functions
@query("string_functions", "F1", """
SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, array_to_string(string_split(p_name, ' '), ';') AS joined,
  CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS brand_number, regexp_full_match(p_brand, 'Brand#[0-9]') AS short_brand,
  lower(p_type) AS lowered, starts_with(p_name, 'red') AS red, replace(p_name, ' ', '_') AS slug, substring(p_brand, 1, 5) AS head FROM part""")
def string_functions(spark, d):
    c = F.col
    return b.table(spark, d, "part").select(
        "p_partkey", F.trim(F.concat(F.lit("  "), c("p_name"), F.lit(" "))).alias("trimmed"),
        F.array_join(F.split("p_name", " "), ";").alias("joined"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint").alias("brand_number"),
        c("p_brand").rlike("^Brand#[0-9]$").alias("short_brand"), F.lower("p_type").alias("lowered"), c("p_name").startswith("red").alias("red"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("slug"), F.substring("p_brand", 1, 5).alias("head"))


@query("date_functions", "F3", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS utc_text, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS days,
  CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(quarter(ts) AS INTEGER) AS q, ts + CASE WHEN ts >= TIMESTAMP '2024-03-10 03:00:00' AND ts < TIMESTAMP '2024-11-03 02:00:00' THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS from_pacific FROM events""")
def date_functions(spark, d):
    ts = F.col("ts")
    return b.table(spark, d, "events").select(
        "event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc_text"), F.datediff(ts, F.lit(date(2024, 1, 1))).alias("days"),
        F.year(ts).alias("y"), F.month(ts).alias("m"), F.quarter(ts).alias("q"),
        F.convert_timezone(F.lit("America/Los_Angeles"), F.lit("UTC"), ts).alias("from_pacific"))


@query("http_date_parse", "F3", """
SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR AS parsed FROM orders""")
def http_date_parse(spark, d):
    header = F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy"), F.lit(" 01:00:00 GMT"))
    return b.table(spark, d, "orders").select("o_orderkey", rules.http_date(header).alias("parsed"))


@query("math_functions", "F4", """
SELECT s_suppkey, abs(s_acctbal) AS magnitude, round(sqrt(abs(s_acctbal)), 6) AS root, CAST(floor(s_acctbal) AS BIGINT) AS whole,
  isfinite(s_acctbal) AS finite, abs(s_acctbal * 3 - s_acctbal - s_acctbal - s_acctbal) <= 1e-9 * abs(s_acctbal) AS close,
  least(s_acctbal, 5000) AS lesser, round(1 / (1 + exp(-s_acctbal / 1e4)), 9) AS sigmoid FROM supplier""")
def math_functions(spark, d):
    v = F.col("s_acctbal")
    return b.table(spark, d, "supplier").select(
        "s_suppkey", F.abs(v).alias("magnitude"), F.round(F.sqrt(F.abs(v)), 6).alias("root"), F.floor(v).alias("whole"),
        (~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"), (F.abs(v * 3 - v - v - v) <= 1e-9 * F.abs(v)).alias("close"),
        F.least(v, F.lit(5000.0)).alias("lesser"), F.round(1 / (1 + F.exp(-v / 1e4)), 9).alias("sigmoid"))


@query("array_functions", "F5", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ';') AS sorted_tokens, len(string_split(p_name, ' ')) AS n_tokens,
  list_contains(string_split(p_name, ' '), 'red') AS has_red, list_has_any(string_split(p_name, ' '), ['red', 'blue']) AS has_either,
  len(list_filter(string_split(p_name, ' '), lambda t: length(t) > 3)) > 0 AS any_long,
  len(list_filter(string_split(p_name, ' '), lambda t: length(t) > 3)) = len(string_split(p_name, ' ')) AS all_long FROM part""")
def array_functions(spark, d):
    t = F.split("p_name", " ")
    return b.table(spark, d, "part").select(
        "p_partkey", F.array_join(F.sort_array(F.array_distinct(t)), ";").alias("sorted_tokens"), F.size(t).cast("bigint").alias("n_tokens"),
        F.array_contains(t, "red").alias("has_red"), F.arrays_overlap(t, F.array(F.lit("red"), F.lit("blue"))).alias("has_either"),
        F.exists(t, lambda x: F.length(x) > 3).alias("any_long"), F.forall(t, lambda x: F.length(x) > 3).alias("all_long"))


@query("json_functions", "F6", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent, true AS valid_json,
  '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS row_json FROM events""")
def json_functions(spark, d):
    return b.table(spark, d, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.get_json_object("props", "$.absent").alias("absent"),
        F.try_parse_json("props").isNotNull().alias("valid_json"), F.to_json(F.struct("event_type", "user_id")).alias("row_json"))


@query("null_functions", "F7", """
SELECT event_id, nullif(event_type, 'view') AS blanked, coalesce(nullif(event_type, 'view'), 'none') AS filled, coalesce(CAST(NULL AS DOUBLE), value) AS kept FROM events""")
def null_functions(spark, d):
    blank = F.nullif("event_type", F.lit("view"))
    return b.table(spark, d, "events").select(
        "event_id", blank.alias("blanked"), F.coalesce(blank, F.lit("none")).alias("filled"), F.nvl(F.lit(None).cast("double"), "value").alias("kept"))
