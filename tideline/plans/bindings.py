"""How the driver tables stand in for catalog, observation history and calendar.

Every binding exists twice: as DataFrame code and as SQL text for the oracle.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.operators import observations as obs_ops
from tideline.operators.windows import Calendar, Window

SHOP = 61
CALENDAR = Calendar.of([
    Window(y, date(y, 11, 21), date(y, 12, 19), datetime(y, 11, 21), datetime(y, 12, 19))
    for y in (1998, 1999, 2000)])
CALENDAR_2001 = Calendar.of([Window(2001, date(2001, 6, 1), date(2001, 6, 29),
                                    datetime(2001, 6, 1), datetime(2001, 6, 29))])
HISTORY_END = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    release = F.date_add(F.lit(date(1993, 1, 1)), ((F.col("p_partkey") * 37) % 2900).cast("int"))
    return part.select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("publisher"), F.col("p_type").alias("genre"),
        F.col("p_size").alias("activity"), F.col("p_retailprice").alias("price"),
        release.alias("release_date"))


def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the status of their history; some are planted as absent, invalid or partly parsed."""
    status = F.expr("CASE entity_id % 40 WHEN 17 THEN 'invalid' WHEN 27 THEN 'partial' WHEN 7 THEN NULL ELSE 'valid' END")
    return entities(spark, sf_dir).withColumn("history_status", status)


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as a history document holds them."""
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    price = c("l_extendedprice") * (1 - c("l_discount"))
    units = lambda x: F.floor(x * 100 + 0.5).cast("bigint")
    foreign = (c("l_returnflag") == "R") & (c("l_linenumber") == 7)
    money = lambda amount, cur: F.struct(amount.alias("amount"), units(amount).alias("amountInt"),
                                         cur.alias("currency"))
    deal = F.struct(
        money(price, F.when(foreign, "EUR").otherwise("USD")).alias("price"),
        money(c("l_extendedprice"),
              F.when(foreign & (c("l_quantity") >= 25), "EUR").otherwise("USD")).alias("regular"),
        F.floor(c("l_discount") * 100 + 0.5).cast("double").alias("cut"))
    return li.select(
        c("l_partkey").alias("entity_id"),
        (c("l_orderkey") * 10000000 + c("l_linenumber") * 1000000 + (c("l_suppkey") % 10000) * 100
         + F.floor(c("l_quantity"))).cast("bigint").alias("record_index"),
        c("l_shipdate").alias("timestamp"),
        F.struct(F.when(c("l_suppkey") % 10 == 0, 35).otherwise(SHOP).alias("id"),
                 F.when(c("l_suppkey") % 10 == 0, "other").otherwise("main").alias("name")).alias("shop"),
        F.when(c("l_tax") != 0, deal).alias("deal"))


def all_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs_ops.type_records(raw_records(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs_ops.of_shop(all_observations(spark, sf_dir), SHOP)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores of two models over the documents that have labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    base = labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("entity_id"), F.col("quality").alias("actual"), "toxic", "lang",
        "source", "n_chars")
    p = lambda width: F.least(F.lit(1.0), F.floor(F.col("n_chars") / F.lit(width)) / F.lit(1e2))
    return base.select("*", F.inline(F.array(
        F.struct(F.lit("short_scale").alias("model"), p(5e1).alias("p")),
        F.struct(F.lit("long_scale").alias("model"), p(2e2).alias("p"))))) \
        .withColumn("predicted", (F.col("p") >= 0.5).cast("int"))


# ---------------------------------------------------------------------------- SQL twins
ENTITIES = """entities AS (
  SELECT p_partkey AS entity_id, p_name AS name, p_brand AS publisher, p_type AS genre,
         p_size AS activity, p_retailprice AS price,
         CAST(DATE '1993-01-01' + CAST((p_partkey * 37) % 2900 AS INTEGER) AS DATE) AS release_date
  FROM part),
history_of AS (
  SELECT p_partkey AS entity_id, CASE p_partkey % 40 WHEN 7 THEN 'absent' WHEN 17 THEN 'invalid' WHEN 27 THEN 'partial' ELSE 'valid' END AS history_status
  FROM part)"""

ALL_OBS = """flat_obs AS (
  SELECT l_partkey AS entity_id,
         l_orderkey * 10000000 + l_linenumber * 1000000 + (l_suppkey % 10000) * 100
           + CAST(floor(l_quantity) AS BIGINT) AS record_index,
         l_shipdate AS ts, CASE WHEN l_suppkey % 10 = 0 THEN 35 ELSE 61 END AS shop_id,
         CASE WHEN l_suppkey % 10 = 0 THEN 'other' ELSE 'main' END AS shop_name,
         CASE WHEN l_tax = 0 THEN 'null' ELSE 'object' END AS deal_status,
         CASE WHEN l_tax <> 0 THEN l_extendedprice * (1 - l_discount) END AS price,
         CASE WHEN l_tax <> 0 THEN CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) END AS price_amount_int,
         CASE WHEN l_tax <> 0 THEN CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'EUR' ELSE 'USD' END END AS price_currency,
         CASE WHEN l_tax <> 0 THEN l_extendedprice END AS regular,
         CASE WHEN l_tax <> 0 THEN CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) END AS regular_amount_int,
         CASE WHEN l_tax <> 0 THEN CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 AND l_quantity >= 25 THEN 'EUR' ELSE 'USD' END END AS regular_currency,
         CASE WHEN l_tax <> 0 THEN floor(l_discount * 100 + 0.5) END AS cut
  FROM lineitem),
all_obs AS (
  SELECT *, CASE WHEN issue IS NOT NULL THEN 'ambiguous' WHEN cut > 0 THEN 'discount' ELSE 'full_price' END AS kind
  FROM (SELECT *, CASE WHEN deal_status <> 'object' THEN 'deal_' || deal_status
                       WHEN price IS NULL OR regular IS NULL OR cut IS NULL OR price < 0 OR regular < 0 OR cut < 0 OR cut > 100
                         THEN 'missing_or_invalid_price_regular_cut'
                       WHEN price_currency <> regular_currency THEN 'missing_or_mismatched_currency'
                       WHEN NOT ((cut > 0 AND price < regular) OR (cut = 0 AND price = regular)) THEN 'price_regular_cut_disagree'
                  END AS issue FROM flat_obs))"""

OBS = ALL_OBS + """,
obs AS (SELECT *, struct_pack(a := price, b := price_amount_int, c := price_currency, d := regular,
               e := regular_amount_int, f := regular_currency, g := cut, h := deal_status) AS sig
        FROM all_obs WHERE shop_id = 61)"""

WIN = """win(window_year, start_date, end_date, window_start, window_end) AS (VALUES
  (1998, DATE '1998-11-21', DATE '1998-12-19', TIMESTAMP '1998-11-21', TIMESTAMP '1998-12-19'),
  (1999, DATE '1999-11-21', DATE '1999-12-19', TIMESTAMP '1999-11-21', TIMESTAMP '1999-12-19'),
  (2000, DATE '2000-11-21', DATE '2000-12-19', TIMESTAMP '2000-11-21', TIMESTAMP '2000-12-19'))"""

WIN_2001 = """win(window_year, start_date, end_date, window_start, window_end) AS (VALUES
  (2001, DATE '2001-06-01', DATE '2001-06-29', TIMESTAMP '2001-06-01', TIMESTAMP '2001-06-29'))"""

PAIRS = """pairs AS (
  SELECT e.entity_id, e.release_date, w.*,
         CASE WHEN release_date < start_date THEN 'before_start_date' WHEN release_date = start_date THEN 'on_start_date'
              WHEN release_date < end_date THEN 'interior_sale_dates' WHEN release_date = end_date THEN 'on_end_date'
              ELSE 'after_end_date' END AS release_timing,
         CASE WHEN release_date = start_date THEN 'uncertain_release_hour'
              WHEN release_date < start_date THEN 'eligible_by_release_date'
              ELSE 'ineligible_by_release_date' END AS eligibility_status,
         release_date <= start_date AS eligible
  FROM entities e CROSS JOIN win w)"""

TAGGED = """tagged AS (
  SELECT o.*, w.*, CASE WHEN ts < window_start THEN 'before' WHEN ts < window_end THEN 'inside' ELSE 'after' END AS side
  FROM obs o CROSS JOIN win w)"""

INSIDE = """inside AS (
  SELECT entity_id, window_year, count(*) AS records,
    count(*) FILTER (WHERE kind = 'discount') AS discounts, count(*) FILTER (WHERE kind = 'full_price') AS full_prices,
    count(*) FILTER (WHERE kind = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE deal_status = 'null') AS null_deals,
    count(*) FILTER (WHERE CAST(ts AS DATE) = start_date) AS on_start_date,
    count(*) FILTER (WHERE CAST(ts AS DATE) = end_date) AS on_end_date,
    min(ts) AS first_ts, max(ts) AS last_ts, max(cut) AS max_cut,
    coalesce(string_agg(DISTINCT price_currency, ';' ORDER BY price_currency), '') AS currencies,
    CASE WHEN count(DISTINCT price_currency) = 1 AND count(DISTINCT regular_currency) = 1
          AND min(price_currency) = min(regular_currency) THEN min(price) END AS min_price,
    CASE WHEN count(DISTINCT price_currency) = 1 AND count(DISTINCT regular_currency) = 1
          AND min(price_currency) = min(regular_currency) THEN max(regular) END AS max_regular
  FROM tagged WHERE side = 'inside' GROUP BY 1, 2)"""

EVIDENCE = """evidence AS (
  SELECT p.* REPLACE (CASE WHEN p.eligible AND h.history_status <> 'valid' THEN 'unknown_history' ELSE p.eligibility_status END AS eligibility_status),
    CASE WHEN eligible AND history_status IN ('valid', 'partial') THEN coalesce(records, 0) END AS records,
    CASE WHEN eligible AND history_status IN ('valid', 'partial') THEN coalesce(discounts, 0) END AS discounts,
    CASE WHEN eligible AND history_status IN ('valid', 'partial') THEN coalesce(full_prices, 0) END AS full_prices,
    CASE WHEN eligible AND history_status IN ('valid', 'partial') THEN coalesce(ambiguous, 0) END AS ambiguous,
    CASE WHEN eligible AND history_status IN ('valid', 'partial') THEN coalesce(null_deals, 0) END AS null_deals,
    CASE WHEN eligible AND history_status = 'valid' THEN CASE WHEN coalesce(records, 0) = 0 THEN 'D' WHEN discounts > 0 THEN 'A'
         WHEN full_prices = records THEN 'B' ELSE 'C' END END AS category
  FROM pairs p JOIN history_of h ON h.entity_id = p.entity_id
  LEFT JOIN inside i ON i.entity_id = p.entity_id AND i.window_year = p.window_year)"""

LABELS = """labels0 AS (
  SELECT *, CASE WHEN category = 'A' THEN 1 WHEN category IN ('B', 'D') THEN 0 END AS discount_observed,
    CASE WHEN category IS NULL THEN 'unknown' WHEN category = 'A' THEN 'positive' ELSE 'unlabeled' END AS pu_status,
    coalesce(category = 'C', true) AS ambiguity_flag,
    (coalesce(category = 'C', true) OR eligibility_status <> 'eligible_by_release_date') AS requires_review
  FROM evidence),
lab AS (SELECT *, coalesce(category IN ('A', 'B', 'D'), false) AS model_eligible FROM labels0)"""

CONTEXT = """grp AS (
  SELECT entity_id, ts, count(*) AS ties, count(DISTINCT sig) > 1 AS conflict,
    CASE WHEN bool_or(kind = 'ambiguous') OR count(DISTINCT sig) > 1 THEN 'ambiguous' ELSE min(kind) END AS state,
    min(record_index) AS lowest_index
  FROM obs GROUP BY 1, 2),
side_n AS (
  SELECT entity_id, window_year,
    count(*) FILTER (WHERE side = 'before') AS before_n, count(*) FILTER (WHERE side = 'inside') AS inside_n,
    count(*) FILTER (WHERE side = 'after') AS after_n,
    count(*) FILTER (WHERE side = 'before' AND kind = 'discount') AS before_n_discount,
    count(*) FILTER (WHERE side = 'inside' AND kind = 'discount') AS inside_n_discount,
    count(*) FILTER (WHERE side = 'after' AND kind = 'discount') AS after_n_discount,
    count(*) FILTER (WHERE side = 'before' AND kind = 'full_price') AS before_n_full,
    count(*) FILTER (WHERE side = 'inside' AND kind = 'full_price') AS inside_n_full,
    count(*) FILTER (WHERE side = 'after' AND kind = 'full_price') AS after_n_full,
    count(*) FILTER (WHERE side = 'before' AND kind = 'ambiguous') AS before_n_ambiguous,
    count(*) FILTER (WHERE side = 'inside' AND kind = 'ambiguous') AS inside_n_ambiguous,
    count(*) FILTER (WHERE side = 'after' AND kind = 'ambiguous') AS after_n_ambiguous,
    count(*) FILTER (WHERE side = 'before' AND deal_status = 'null') AS before_n_null_deal,
    count(*) FILTER (WHERE side = 'inside' AND deal_status = 'null') AS inside_n_null_deal,
    count(*) FILTER (WHERE side = 'after' AND deal_status = 'null') AS after_n_null_deal,
    max(ts) FILTER (WHERE side = 'before') AS pre_ts, min(ts) FILTER (WHERE side = 'after') AS post_ts,
    min(ts) AS history_first_ts, max(ts) AS history_last_ts
  FROM tagged GROUP BY 1, 2),
side_c AS (
  SELECT g.entity_id, w.window_year,
    count(*) FILTER (WHERE conflict AND ts < window_start) AS before_n_conflicts,
    count(*) FILTER (WHERE conflict AND ts >= window_start AND ts < window_end) AS inside_n_conflicts,
    count(*) FILTER (WHERE conflict AND ts >= window_end) AS after_n_conflicts
  FROM grp g CROSS JOIN win w GROUP BY 1, 2),
context AS (
  SELECT p.entity_id, p.window_year, p.release_date, p.release_timing, p.eligibility_status, p.eligible,
    p.window_start, p.window_end,
    coalesce(before_n, 0) AS before_n, coalesce(inside_n, 0) AS inside_n, coalesce(after_n, 0) AS after_n,
    coalesce(before_n_discount, 0) AS before_n_discount, coalesce(inside_n_discount, 0) AS inside_n_discount, coalesce(after_n_discount, 0) AS after_n_discount,
    coalesce(before_n_full, 0) AS before_n_full, coalesce(inside_n_full, 0) AS inside_n_full, coalesce(after_n_full, 0) AS after_n_full,
    coalesce(before_n_ambiguous, 0) AS before_n_ambiguous, coalesce(inside_n_ambiguous, 0) AS inside_n_ambiguous, coalesce(after_n_ambiguous, 0) AS after_n_ambiguous,
    coalesce(before_n_null_deal, 0) AS before_n_null_deal, coalesce(inside_n_null_deal, 0) AS inside_n_null_deal, coalesce(after_n_null_deal, 0) AS after_n_null_deal,
    coalesce(before_n_conflicts, 0) AS before_n_conflicts, coalesce(inside_n_conflicts, 0) AS inside_n_conflicts, coalesce(after_n_conflicts, 0) AS after_n_conflicts,
    pre_ts, post_ts, history_first_ts, history_last_ts,
    coalesce(a.state, 'missing') AS pre_observed_state, coalesce(b.state, 'missing') AS post_observed_state,
    a.ties AS pre_ties, b.ties AS post_ties, a.lowest_index AS pre_index, b.lowest_index AS post_index,
    epoch_us(p.window_start) / 86400e6 - epoch_us(pre_ts) / 86400e6 AS pre_gap_days,
    epoch_us(post_ts) / 86400e6 - epoch_us(p.window_end) / 86400e6 AS post_gap_days,
    epoch_us(post_ts) / 86400e6 - epoch_us(pre_ts) / 86400e6 AS surrounding_days,
    CASE WHEN p.eligible AND h.history_status = 'valid' THEN CASE WHEN coalesce(inside_n, 0) = 0 THEN 'D' WHEN inside_n_discount > 0 THEN 'A'
         WHEN inside_n_full = inside_n THEN 'B' ELSE 'C' END END AS category
  FROM pairs p JOIN history_of h USING (entity_id) LEFT JOIN side_n s USING (entity_id, window_year) LEFT JOIN side_c c USING (entity_id, window_year)
  LEFT JOIN grp a ON a.entity_id = p.entity_id AND a.ts = s.pre_ts
  LEFT JOIN grp b ON b.entity_id = p.entity_id AND b.ts = s.post_ts)"""

FEATURES = """prior AS (SELECT * FROM tagged WHERE side = 'before'),
valid AS (SELECT * FROM prior WHERE kind <> 'ambiguous'),
vagg AS (
  SELECT entity_id, window_year, count(*) AS n, count(*) FILTER (WHERE kind = 'discount') AS d,
    max(ts) AS vts, max(ts) FILTER (WHERE kind = 'discount') AS dts,
    max(cut) FILTER (WHERE kind = 'discount') AS cmax, avg(cut) FILTER (WHERE kind = 'discount') AS cavg,
    count(DISTINCT price_currency) AS ncur, min(price_currency) AS cur
  FROM valid GROUP BY 1, 2),
vlast AS (
  SELECT v.entity_id, v.window_year, count(DISTINCT v.sig) > 1 AS vconflict, max(v.price) AS lprice, max(v.cut) AS lcut
  FROM valid v JOIN vagg a ON v.entity_id = a.entity_id AND v.window_year = a.window_year AND v.ts = a.vts GROUP BY 1, 2),
feat AS (
  SELECT p.entity_id, p.window_year, p.window_start AS prediction_cutoff,
    CAST(date_diff('day', release_date, start_date) AS INTEGER) AS game_age_days,
    CAST(year(release_date) AS INTEGER) AS release_year, CAST(month(release_date) AS INTEGER) AS release_month,
    CAST(quarter(release_date) AS INTEGER) AS release_quarter,
    coalesce(n, 0) AS prior_price_record_count, coalesce(d, 0) AS prior_discount_count,
    CAST(d AS DOUBLE) / n AS prior_discount_rate,
    epoch_us(p.window_start) / 86400e6 - epoch_us(vts) / 86400e6 AS days_since_last_price_record,
    epoch_us(p.window_start) / 86400e6 - epoch_us(dts) / 86400e6 AS days_since_last_discount,
    cmax AS max_prior_discount_pct, cavg AS mean_prior_discount_pct,
    CASE WHEN n > 0 AND ncur = 1 AND cur = 'USD' AND NOT vconflict THEN lprice END AS last_observed_price,
    CASE WHEN NOT vconflict THEN lcut END AS last_observed_discount_pct,
    CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS has_prior_price_history,
    CASE WHEN coalesce(d, 0) > 0 THEN 1 ELSE 0 END AS has_prior_discount_observation,
    CASE WHEN release_date = start_date THEN 1 ELSE 0 END AS audit_release_hour_uncertain,
    CASE WHEN coalesce(n, 0) = 0 THEN 'no_valid_prior_price' WHEN ncur > 1 THEN 'mixed_prior_currencies'
         WHEN cur <> 'USD' THEN 'non_home_prior_currency' WHEN vconflict THEN 'conflicting_latest_timestamp' END AS money_issue
  FROM pairs p LEFT JOIN vagg USING (entity_id, window_year) LEFT JOIN vlast USING (entity_id, window_year)
  WHERE p.eligible)"""

SCORES = """scores AS (
  SELECT l.doc_id AS entity_id, quality AS actual, toxic, lang, source, n_chars, m.model,
    least(1e0, floor(n_chars / m.width) / 1e2) AS p,
    CASE WHEN least(1e0, floor(n_chars / m.width) / 1e2) >= 0.5 THEN 1 ELSE 0 END AS predicted
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
  CROSS JOIN (VALUES ('short_scale', 5e1), ('long_scale', 2e2)) AS m(model, width))"""


# Context of eligible pairs only.
ELIGIBLE_CONTEXT = CONTEXT.replace("context AS (", "every_context AS (", 1) + ",\ncontext AS (SELECT * FROM every_context WHERE eligible)"


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
