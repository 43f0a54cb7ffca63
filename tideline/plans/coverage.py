"""Coverage diagnostics: gaps, sensitivity slices, transitions, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import coverage
from tideline.plans import bindings as b
from tideline.plans.bindings import OBS, TAGGED, WIN, ENTITIES, with_ctes
from tideline.plans.evidence import CAL, ELIGIBLE_CTES, context_of
from tideline.plans.registry import query

QUANTILES = ", ".join(
    f"round(quantile_cont({{v}}, {f}), 6) AS \"{{p}}{n}\"" for n, f in coverage.GAP_FRACTIONS.items())


def quantile_sql(value: str, prefix: str = "") -> str:
    return QUANTILES.format(v=value, p=prefix)


@query("gap_statistics", "A7", with_ctes(*ELIGIBLE_CTES, body=f"""
SELECT metric, count(days) AS n, count(*) - count(days) AS missing, round(avg(days), 6) AS mean,
  {quantile_sql('days')}
FROM (SELECT 'pre_gap_days' AS metric, pre_gap_days AS days FROM context
      UNION ALL SELECT 'post_gap_days', post_gap_days FROM context
      UNION ALL SELECT 'surrounding_days', surrounding_days FROM context) GROUP BY 1"""))
def gap_statistics(spark, d):
    return coverage.gap_stats(coverage.melt_gaps(context_of(spark, d).where("eligible")), ["metric"], "days")


AXES_SQL = f"""
, long AS (
  SELECT window_year, category, pre_observed_state, post_observed_state, m.metric,
    CASE m.metric WHEN 'pre_gap_days' THEN pre_gap_days WHEN 'post_gap_days' THEN post_gap_days ELSE surrounding_days END AS days
  FROM context CROSS JOIN (VALUES ('pre_gap_days'), ('post_gap_days'), ('surrounding_days')) AS m(metric)),
axes AS (
  SELECT 'window_year' AS group_axis, CAST(window_year AS VARCHAR) AS group_value, metric, days FROM long
  UNION ALL SELECT 'category', category, metric, days FROM long
  UNION ALL SELECT 'pre_observed_state', pre_observed_state, metric, days FROM long
  UNION ALL SELECT 'post_observed_state', post_observed_state, metric, days FROM long
  UNION ALL SELECT window_year || ':category', category, metric, days FROM long
  UNION ALL SELECT window_year || ':pre_observed_state', pre_observed_state, metric, days FROM long
  UNION ALL SELECT window_year || ':post_observed_state', post_observed_state, metric, days FROM long),
vals(axis, val) AS (VALUES ('category', 'A'), ('category', 'B'), ('category', 'C'), ('category', 'D'),
  ('pre_observed_state', 'full_price'), ('pre_observed_state', 'discount'), ('pre_observed_state', 'ambiguous'), ('pre_observed_state', 'missing'),
  ('post_observed_state', 'full_price'), ('post_observed_state', 'discount'), ('post_observed_state', 'ambiguous'), ('post_observed_state', 'missing')),
grid AS (
  SELECT group_axis, group_value, metric FROM (
    SELECT 'window_year' AS group_axis, CAST(window_year AS VARCHAR) AS group_value FROM win
    UNION ALL SELECT axis, val FROM vals
    UNION ALL SELECT window_year || ':' || axis, val FROM win CROSS JOIN vals)
  CROSS JOIN (VALUES ('pre_gap_days'), ('post_gap_days'), ('surrounding_days')) AS m(metric))
SELECT g.group_axis, g.group_value, g.metric, count(days) AS n, count(a.metric) - count(days) AS missing,
  round(avg(days), 6) AS mean, {quantile_sql('days')}
FROM grid g LEFT JOIN axes a ON a.group_axis = g.group_axis AND a.group_value = g.group_value AND a.metric = g.metric
GROUP BY 1, 2, 3"""


@query("grouped_gap_statistics", "A8", with_ctes(*ELIGIBLE_CTES, body=AXES_SQL).replace("\n, long", ", long"))
def grouped_gap_statistics(spark, d):
    return coverage.grouped_gap_stats(context_of(spark, d), CAL.years)


def _crosstab_sql(by: str, side: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {side}_observed_state = '{s}') AS {s}"
                       for s in ("full_price", "discount", "ambiguous", "missing"))
    return with_ctes(*ELIGIBLE_CTES, body=f"SELECT {by}, count(*) AS pairs, {counts} FROM context GROUP BY 1")


@query("state_by_year", "A9", _crosstab_sql("window_year", "pre"))
def state_by_year(spark, d):
    return coverage.state_crosstab(context_of(spark, d), "window_year", "pre")


@query("state_by_category", "A9", _crosstab_sql("category", "post"))
def state_by_category(spark, d):
    return coverage.state_crosstab(context_of(spark, d), "category", "post")


SLICES_SQL = """
, lim(scenario, limit_days) AS (VALUES ('pre_within_7_days', 7), ('pre_within_14_days', 14), ('pre_within_30_days', 30),
  ('pre_within_60_days', 60), ('pre_within_90_days', 90), ('unrestricted', NULL)),
pool AS (
  SELECT c.entity_id, c.window_year, scenario, limit_days, y.slice_year, k.slice_category, pre_observed_state,
    post_observed_state, pre_gap_days, post_gap_days,
    coalesce(limit_days IS NULL OR pre_gap_days <= limit_days, false) AS matches
  FROM context c CROSS JOIN lim
  CROSS JOIN LATERAL (SELECT unnest(['all', CAST(c.window_year AS VARCHAR)]) AS slice_year) y
  CROSS JOIN LATERAL (SELECT unnest(['all_non_A', c.category]) AS slice_category) k
  WHERE c.category <> 'A')"""


@query("sensitivity_slices", "A6", with_ctes(*ELIGIBLE_CTES, body=SLICES_SQL + f""",
grid AS (SELECT scenario, y.slice_year, k.slice_category, s.pre_observed_state FROM lim
  CROSS JOIN (VALUES ('all'), ('1998'), ('1999'), ('2000')) AS y(slice_year)
  CROSS JOIN (VALUES ('all_non_A'), ('B'), ('C'), ('D')) AS k(slice_category)
  CROSS JOIN (VALUES ('full_price'), ('discount'), ('ambiguous'), ('missing')) AS s(pre_observed_state))
SELECT g.scenario, g.slice_year, g.slice_category, g.pre_observed_state, count(p.entity_id) AS pool_pairs,
  count(*) FILTER (WHERE matches) AS matching_pairs,
  count(*) FILTER (WHERE matches AND post_gap_days IS NOT NULL) AS post_seen,
  count(*) FILTER (WHERE matches AND post_gap_days IS NULL) AS post_missing,
  count(*) FILTER (WHERE matches AND pre_gap_days IS NOT NULL AND post_gap_days IS NOT NULL
     AND (limit_days IS NULL OR post_gap_days <= limit_days)) AS both_within_limit,
  count(*) FILTER (WHERE matches AND post_observed_state = 'full_price') AS post_full_price,
  count(*) FILTER (WHERE matches AND post_observed_state = 'discount') AS post_discount,
  count(*) FILTER (WHERE matches AND post_observed_state = 'ambiguous') AS post_ambiguous,
  count(*) FILTER (WHERE matches AND post_observed_state = 'missing') AS post_missing_state,
  count(CASE WHEN matches THEN post_gap_days END) AS gap_n,
  count(*) FILTER (WHERE matches AND post_gap_days IS NULL) AS gap_missing,
  round(avg(CASE WHEN matches THEN post_gap_days END), 6) AS gap_mean,
  {quantile_sql('CASE WHEN matches THEN post_gap_days END', 'gap_')}
FROM grid g LEFT JOIN pool p USING (scenario, slice_year, slice_category, pre_observed_state)
GROUP BY 1, 2, 3, 4""").replace("\n, lim", ", lim"))
def sensitivity_slices(spark, d):
    return coverage.sensitivity_table(context_of(spark, d), CAL.years)


@query("sensitivity_members", "A6", with_ctes(*ELIGIBLE_CTES, body=SLICES_SQL + """
SELECT scenario, slice_year, slice_category, pre_observed_state, entity_id, window_year FROM pool WHERE matches"""
).replace("\n, lim", ", lim"))
def sensitivity_members(spark, d):
    return coverage.sensitivity_members(context_of(spark, d)).where("matches").select(
        "scenario", "slice_year", "slice_category", "pre_observed_state", "entity_id", "window_year")


LINKS_SQL = """g0 AS (
  SELECT entity_id, ts, count(*) AS n, min(kind) AS kind, min(price) AS price, min(price_currency) AS cur,
    min(cut) AS cut, min(sig) AS sig, list(DISTINCT sig) AS sigs FROM obs GROUP BY 1, 2),
links AS (
  SELECT *, lead(ts) OVER w AS next_ts, lead(n) OVER w AS next_n, lead(kind) OVER w AS next_kind,
    lead(price) OVER w AS next_price, lead(cur) OVER w AS next_cur, lead(cut) OVER w AS next_cut,
    lead(sig) OVER w AS next_sig, lead(sigs) OVER w AS next_sigs
  FROM g0 WINDOW w AS (PARTITION BY entity_id ORDER BY ts))"""


@query("state_transitions", "W8", with_ctes(OBS, LINKS_SQL, body="""
SELECT kind AS from_kind, next_kind AS to_kind, count(*) AS pairs FROM links
WHERE next_ts IS NOT NULL AND n = 1 AND next_n = 1 GROUP BY 1, 2"""))
def state_transitions(spark, d):
    return coverage.transition_matrix(coverage.consecutive_groups(b.observations(spark, d)))


@query("consecutive_group_facts", "W8", with_ctes(OBS, LINKS_SQL, body="""
SELECT count(*) AS adjacent_groups, count(*) FILTER (WHERE n = 1 AND next_n = 1) AS singleton_pairs,
  count(*) FILTER (WHERE NOT (n = 1 AND next_n = 1)) AS excluded_pairs,
  count(*) FILTER (WHERE n = 1 AND next_n = 1 AND price IS NOT DISTINCT FROM next_price AND cur IS NOT DISTINCT FROM next_cur) AS same_price,
  count(*) FILTER (WHERE n = 1 AND next_n = 1 AND cut = 0 AND next_cut = 0) AS consecutive_zero_cut,
  count(*) FILTER (WHERE n = 1 AND next_n = 1 AND cut = 0 AND next_cut = 0 AND sig = next_sig) AS identical_zero_cut,
  round(sum(epoch_us(next_ts) / 86400e6 - epoch_us(ts) / 86400e6), 6) AS total_gap_days
FROM links WHERE next_ts IS NOT NULL"""))
def consecutive_group_facts(spark, d):
    return coverage.consecutive_facts(coverage.consecutive_groups(b.observations(spark, d)))


@query("shared_state_groups", "W8", with_ctes(OBS, LINKS_SQL, body="""
SELECT count(*) FILTER (WHERE list_has_any(sigs, next_sigs)) AS sharing_pairs FROM links WHERE next_ts IS NOT NULL"""))
def shared_state_groups(spark, d):
    obs = b.observations(spark, d)
    return coverage.shared_state_links(obs, coverage.consecutive_groups(obs, coverage.STATE_COLUMNS))


@query("history_totals", "W8", with_ctes(OBS, body="""
, g AS (SELECT entity_id, ts, count(*) AS n, count(DISTINCT sig) AS states FROM obs GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT entity_id) FROM obs) AS entities, count(*) AS records, count(*) FILTER (WHERE deal_status = 'null') AS null_deals,
  count(*) FILTER (WHERE kind = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE kind = 'full_price') AS full_prices, count(*) FILTER (WHERE kind = 'discount') AS discounts,
  count(*) FILTER (WHERE price = 0 AND regular = 0) AS zero_prices, count(*) FILTER (WHERE ts = TIMESTAMP '1995-06-01') AS at_request_boundary,
  (SELECT count(*) FILTER (WHERE n > 1) FROM g) AS duplicate_groups, (SELECT count(*) FILTER (WHERE states > 1) FROM g) AS conflict_groups FROM obs""").replace("\n, g AS", ", g AS"))
def history_totals(spark, d):
    return coverage.history_totals(b.observations(spark, d), F.lit("1995-06-01").cast("timestamp_ntz"))


@query("newest_first_check", "W9", with_ctes(OBS, body="""
SELECT entity_id, CAST(sum(1) AS BIGINT) AS records, bool_and(ok) AS newest_first FROM (
  SELECT entity_id, coalesce(lag(ts) OVER (PARTITION BY entity_id ORDER BY record_index) >= ts, true) AS ok FROM obs)
GROUP BY 1"""))
def newest_first_check(spark, d):
    return coverage.newest_first(b.observations(spark, d))


@query("event_sequence", "W11", with_ctes(ENTITIES, OBS, WIN, TAGGED, body="""
, merged AS (
  SELECT entity_id, window_year, side AS event, ts, 1 AS late, record_index FROM tagged WHERE entity_id IN (SELECT entity_id FROM entities)
  UNION ALL SELECT entity_id, window_year, 'window_start', window_start, 0, -1 FROM entities CROSS JOIN win
  UNION ALL SELECT entity_id, window_year, 'window_end', window_end, 0, -1 FROM entities CROSS JOIN win)
SELECT entity_id, window_year, event, ts, record_index,
  row_number() OVER (PARTITION BY entity_id, window_year ORDER BY ts, late, record_index) AS position FROM merged
""").replace("\n, merged", ", merged"))
def event_sequence(spark, d):
    return coverage.event_sequence(b.entities(spark, d), b.observations(spark, d), CAL)


@query("context_extremes", "K4", with_ctes(*ELIGIBLE_CTES, body="""
, two AS (SELECT entity_id, window_year, round(pre_gap_days + post_gap_days, 6) AS gap_sum,
    row_number() OVER (PARTITION BY window_year ORDER BY pre_gap_days + post_gap_days, entity_id) AS near,
    row_number() OVER (PARTITION BY window_year ORDER BY pre_gap_days + post_gap_days DESC, entity_id DESC) AS far
  FROM context WHERE eligible AND inside_n = 0 AND pre_gap_days IS NOT NULL AND post_gap_days IS NOT NULL)
SELECT window_year, 'closest' AS example, entity_id, gap_sum FROM two WHERE near = 1
UNION ALL SELECT window_year, 'farthest', entity_id, gap_sum FROM two WHERE far = 1""").replace("\n, two", ", two"))
def context_extremes(spark, d):
    return coverage.context_extremes(context_of(spark, d))
