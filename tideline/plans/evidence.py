"""Evidence, context, features, labels and leakage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import coverage, evidence, features, labels
from tideline.operators import observations as obs_ops
from tideline.operators.windows import entity_windows, tag_records
from tideline.plans import bindings as b
from tideline.plans.bindings import (ALL_OBS, CONTEXT, ENTITIES, EVIDENCE, FEATURES, INSIDE, LABELS,
                                     OBS, PAIRS, TAGGED, WIN, WIN_2001, with_ctes)
from tideline.plans.registry import query
from tideline.session import durable

CAL = b.CALENDAR
EVIDENCE_CTES = (ENTITIES, OBS, WIN, PAIRS, TAGGED, INSIDE, EVIDENCE)
LABEL_CTES = (*EVIDENCE_CTES, LABELS)
CONTEXT_CTES = (ENTITIES, OBS, WIN, PAIRS, TAGGED, CONTEXT)
ELIGIBLE_CTES = (ENTITIES, OBS, WIN, PAIRS, TAGGED, b.ELIGIBLE_CONTEXT)
FEATURE_CTES = (ENTITIES, OBS, WIN, PAIRS, TAGGED, FEATURES)


def context_of(spark, d):
    return evidence.pair_context(b.known_entities(spark, d), b.observations(spark, d), CAL)


def evidence_of(spark, d):
    return evidence.direct_evidence(b.known_entities(spark, d), b.observations(spark, d), CAL)


def labels_of(spark, d):
    ev = evidence_of(spark, d)
    return labels.with_policy(labels.label_rows(ev))


def segments_of(spark, d):
    """The one scan of the records that context, features and labels share, written."""
    return durable(evidence.segment_summary(b.observations(spark, d), CAL))


def modeling_rows(spark, d):
    """Features and targets of all eligible pairs, from one scan of the records."""
    segments = segments_of(spark, d)
    context = evidence.pair_context(b.known_entities(spark, d), None, CAL, segments)
    return labels.modeling_table(features.features(b.entities(spark, d), None, CAL, segments=segments),
                                 labels.with_policy(labels.label_rows(context)))


def features_of(spark, d, **kw):
    return features.features(b.entities(spark, d), b.observations(spark, d), CAL, **kw)


# ------------------------------------------------------------------ observations
@query("typed_observations", "P10", with_ctes(ALL_OBS, body="""
SELECT entity_id, record_index, ts, shop_id, deal_status, price, price_amount_int, price_currency,
       regular, regular_amount_int, regular_currency, cut, kind, issue FROM all_obs"""))
def typed_observations(spark, d):
    return b.all_observations(spark, d).drop("shop_name")


@query("observation_issue_counts", "P10 P11", with_ctes(ALL_OBS, body="""
SELECT shop_id, deal_status, kind, coalesce(issue, 'none') AS issue, count(*) AS records
FROM all_obs GROUP BY ALL"""))
def observation_issue_counts(spark, d):
    return b.all_observations(spark, d).groupBy(
        "shop_id", "deal_status", "kind", F.coalesce("issue", F.lit("none")).alias("issue")) \
        .agg(F.count("*").alias("records"))


@query("history_parse_counts", "P11", with_ctes(ALL_OBS, body="""
SELECT CASE WHEN shop_id <> 61 THEN 'other_shop' ELSE 'kept' END AS outcome, count(*) AS records
FROM all_obs GROUP BY 1"""))
def history_parse_counts(spark, d):
    return obs_ops.parse_counts(b.all_observations(spark, d), b.SHOP)


@query("history_diagnostics", "P12", with_ctes(ALL_OBS, body="""
SELECT entity_id, count(*) AS records, count(*) FILTER (WHERE shop_id = 61) AS own_shop_records,
  count(*) FILTER (WHERE shop_id <> 61) AS other_shop_records,
  count(*) FILTER (WHERE deal_status = 'null') AS null_deals,
  count(*) FILTER (WHERE deal_status = 'object' AND (cut < 0 OR cut > 100 OR price < 0 OR regular < 0
     OR price_amount_int < 0 OR regular_amount_int < 0)) AS invalid_records,
  min(ts) FILTER (WHERE shop_id = 61) AS first_ts, max(ts) FILTER (WHERE shop_id = 61) AS last_ts
FROM all_obs GROUP BY 1"""))
def history_diagnostics(spark, d):
    return obs_ops.history_diagnostics(b.all_observations(spark, d), b.SHOP)


# ------------------------------------------------------------------ windows
@query("entity_window_pairs", "J1 P13", with_ctes(ENTITIES, WIN, PAIRS, body="""
SELECT entity_id, window_year, release_date, release_timing, eligibility_status, eligible,
       window_start, window_end FROM pairs"""))
def entity_window_pairs(spark, d):
    return entity_windows(b.entities(spark, d).select("entity_id", "release_date"), CAL) \
        .drop("start_date", "end_date")


@query("release_timing_counts", "P13 A17", with_ctes(ENTITIES, WIN, PAIRS, body="""
SELECT window_year, release_timing, count(*) AS entities FROM pairs GROUP BY 1, 2"""))
def release_timing_counts(spark, d):
    return entity_windows(b.entities(spark, d).select("entity_id", "release_date"), CAL) \
        .groupBy("window_year", "release_timing").agg(F.count("*").alias("entities"))


@query("range_join_sides", "J2", with_ctes(OBS, WIN, TAGGED, body="""
SELECT entity_id, window_year, side, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts
FROM tagged GROUP BY 1, 2, 3"""))
def range_join_sides(spark, d):
    # Segments first: each observation is shuffled once, windows expand the small result.
    seg = b.observations(spark, d).groupBy("entity_id", CAL.segment(F.col("ts")).alias("segment")) \
        .agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    from tideline.operators.windows import segment_side
    rows = CAL.each_window(seg, segments=True)
    side = segment_side(F.col("segment"), F.col("first_segment"), F.col("last_segment"))
    return rows.groupBy("entity_id", "window_year", side.alias("side")).agg(
        F.sum("n").alias("records"), F.min("a").alias("first_ts"), F.max("z").alias("last_ts"))


@query("window_records", "J2 U1", with_ctes(OBS, WIN, TAGGED, body="""
SELECT entity_id, window_year, record_index, ts, kind, price, cut FROM tagged WHERE side = 'inside'"""))
def window_records(spark, d):
    return evidence.inside_records(b.observations(spark, d), CAL).select(
        "entity_id", "window_year", "record_index", "ts", "kind", "price", "cut")


@query("window_evidence_counts", "A1", with_ctes(OBS, WIN, TAGGED, INSIDE, body="SELECT * FROM inside"))
def window_evidence_counts(spark, d):
    return evidence.inside_counts(b.observations(spark, d), CAL)


@query("evidence_categories", "A2 P13 J7", with_ctes(*EVIDENCE_CTES, body="""
SELECT entity_id, window_year, eligibility_status, records, discounts, full_prices, ambiguous,
       null_deals, category FROM evidence"""))
def evidence_categories(spark, d):
    return evidence_of(spark, d).select(
        "entity_id", "window_year", "eligibility_status", "records", "discounts", "full_prices",
        "ambiguous", "null_deals", "category")


# ------------------------------------------------------------------ context
@query("nearest_context", "J3", with_ctes(*CONTEXT_CTES, body="""
SELECT entity_id, window_year, pre_ts, post_ts, pre_ties, post_ties, pre_index, post_index,
       round(pre_gap_days, 6) AS pre_gap_days, round(post_gap_days, 6) AS post_gap_days FROM context"""))
def nearest_context(spark, d):
    return context_of(spark, d).select(
        "entity_id", "window_year", "pre_ts", "post_ts", "pre_ties", "post_ties", "pre_index",
        "post_index", F.round("pre_gap_days", 6).alias("pre_gap_days"),
        F.round("post_gap_days", 6).alias("post_gap_days"))


@query("nearest_tied_records", "J3", with_ctes(*CONTEXT_CTES, body="""
SELECT c.entity_id, c.window_year, s.side, o.record_index, o.ts, o.kind, o.price, o.cut,
       CASE s.side WHEN 'before' THEN pre_ties ELSE post_ties END AS ties,
       o.record_index = CASE s.side WHEN 'before' THEN pre_index ELSE post_index END AS representative
FROM context c CROSS JOIN (VALUES ('before'), ('after')) AS s(side)
JOIN obs o ON o.entity_id = c.entity_id AND o.ts = CASE s.side WHEN 'before' THEN pre_ts ELSE post_ts END"""))
def nearest_tied_records(spark, d):
    return evidence.nearest_records(b.observations(spark, d), context_of(spark, d)).select(
        "entity_id", "window_year", "side", "record_index", "ts", "kind", "price", "cut", "ties",
        "representative")


@query("nearest_states", "J4", with_ctes(*CONTEXT_CTES, body="""
SELECT entity_id, window_year, pre_observed_state, post_observed_state,
       round(surrounding_days, 6) AS surrounding_days FROM context"""))
def nearest_states(spark, d):
    return context_of(spark, d).select(
        "entity_id", "window_year", "pre_observed_state", "post_observed_state",
        F.round("surrounding_days", 6).alias("surrounding_days"))


@query("side_summary", "A4", with_ctes(*ELIGIBLE_CTES, body="""
SELECT entity_id, window_year, category, history_first_ts, history_last_ts, """ + ", ".join(
    f"{s}_{c}" for s in ("before", "inside", "after")
    for c in ("n", "n_discount", "n_full", "n_ambiguous", "n_null_deal", "n_conflicts")) + """
FROM context"""))
def side_summary(spark, d):
    return context_of(spark, d).where("eligible").select(
        "entity_id", "window_year", "category", "history_first_ts", "history_last_ts",
        *[f"{s}_{c}" for s in evidence.SIDES
          for c in ("n", "n_discount", "n_full", "n_ambiguous", "n_null_deal", "n_conflicts")])


@query("side_record_indices", "A4 L3", with_ctes(OBS, WIN, TAGGED, body="""
SELECT entity_id, window_year, side, record_index FROM tagged"""))
def side_record_indices(spark, d):
    return tag_records(b.observations(spark, d).select("entity_id", "record_index", "ts"), CAL) \
        .select("entity_id", "window_year", "side", "record_index")


@query("timestamp_conflicts", "A5", with_ctes(OBS, body="""
SELECT entity_id, ts, count(*) AS records, min(record_index) AS lowest_index
FROM obs GROUP BY 1, 2 HAVING count(DISTINCT sig) > 1"""))
def timestamp_conflicts(spark, d):
    return evidence.conflicts(b.observations(spark, d))


@query("interpretation_cues", "P24", with_ctes(*ELIGIBLE_CTES, body="""
, sets AS (
  SELECT c.entity_id, c.window_year,
    (SELECT list_sort(list(DISTINCT CAST(o.sig AS VARCHAR))) FROM obs o WHERE o.entity_id = c.entity_id AND o.ts = c.pre_ts) AS pre_set,
    (SELECT list_sort(list(DISTINCT CAST(o.sig AS VARCHAR))) FROM obs o WHERE o.entity_id = c.entity_id AND o.ts = c.post_ts) AS post_set
  FROM context c),
hist AS (SELECT entity_id, count(*) AS n FROM grp WHERE conflict GROUP BY 1),
cues AS (
  SELECT c.*, concat_ws(';',
    CASE WHEN pre_observed_state = 'missing' OR post_observed_state = 'missing' THEN 'missing_surrounding_observation' END,
    CASE WHEN pre_observed_state = 'ambiguous' OR post_observed_state = 'ambiguous' OR inside_n_ambiguous > 0 THEN 'ambiguous_observed_information' END,
    CASE WHEN pre_ts IS NOT NULL AND post_ts IS NOT NULL AND pre_set <> post_set THEN 'surrounding_observed_values_differ' END,
    CASE WHEN coalesce(h.n, 0) > 0 THEN 'same_timestamp_history_conflict' END,
    CASE WHEN release_timing = 'on_start_date' THEN 'release_hour_unknown' END) AS cues
  FROM context c JOIN sets USING (entity_id, window_year) LEFT JOIN hist h ON h.entity_id = c.entity_id)
SELECT entity_id, window_year, cues, cues <> '' AS requires_review, inside_n_discount > 0 AS direct_discount,
  pre_observed_state = 'discount' AND inside_n_discount = 0 AS pre_discount_only,
  pre_observed_state = 'full_price' AND inside_n_discount = 0 AS pre_full_price_only,
  pre_observed_state IN ('missing', 'ambiguous') AS no_clear_pre_state
FROM cues""").replace("\n, sets AS", ", sets AS"))
def interpretation_cues(spark, d):
    segments = segments_of(spark, d)
    context = evidence.pair_context(b.known_entities(spark, d), None, CAL, segments)
    return evidence.interpretation_cues(b.observations(spark, d), context, evidence.history_conflict_counts(segments))


# ------------------------------------------------------------------ features
FEATURE_SELECT = """
SELECT entity_id, window_year, prediction_cutoff, game_age_days, release_year, release_month, release_quarter,
  prior_price_record_count, prior_discount_count, round(prior_discount_rate, 9) AS prior_discount_rate,
  round(days_since_last_price_record, 6) AS days_since_last_price_record,
  round(days_since_last_discount, 6) AS days_since_last_discount, max_prior_discount_pct,
  round(mean_prior_discount_pct, 9) AS mean_prior_discount_pct, last_observed_price, last_observed_discount_pct,
  has_prior_price_history, has_prior_discount_observation, audit_release_hour_uncertain, money_issue FROM feat"""


@query("prior_price_features", "A3 W10 P14", with_ctes(*FEATURE_CTES, body=FEATURE_SELECT))
def prior_price_features(spark, d):
    rows = features_of(spark, d, with_diagnostics=True)
    for c, n in (("prior_discount_rate", 9), ("mean_prior_discount_pct", 9),
                 ("days_since_last_price_record", 6), ("days_since_last_discount", 6)):
        rows = rows.withColumn(c, F.round(c, n))
    return rows.select("entity_id", "window_year", "prediction_cutoff", *features.PREDICTORS,
                       "audit_release_hour_uncertain", "money_issue")


@query("static_date_features", "P14", with_ctes(ENTITIES, WIN, PAIRS, body="""
SELECT entity_id, window_year, CAST(date_diff('day', release_date, start_date) AS INTEGER) AS game_age_days,
  CAST(year(release_date) AS INTEGER) AS release_year, CAST(month(release_date) AS INTEGER) AS release_month,
  CAST(quarter(release_date) AS INTEGER) AS release_quarter,
  CASE WHEN release_date = start_date THEN 1 ELSE 0 END AS audit_release_hour_uncertain
FROM pairs WHERE eligible"""))
def static_date_features(spark, d):
    rows = entity_windows(b.entities(spark, d).select("entity_id", "release_date"), CAL).where("eligible")
    return rows.select("entity_id", "window_year",
                       *features.static_features(F.col("release_date"), F.col("start_date")))


@query("latest_valid_value", "W10", with_ctes(*FEATURE_CTES, body="""
SELECT f.entity_id, f.window_year, a.vts AS latest_valid_ts, coalesce(l.vconflict, false) AS latest_valid_conflict,
  last_observed_price, last_observed_discount_pct, money_issue
FROM feat f LEFT JOIN vagg a USING (entity_id, window_year) LEFT JOIN vlast l USING (entity_id, window_year)"""))
def latest_valid_value(spark, d):
    return features_of(spark, d, with_diagnostics=True).select(
        "entity_id", "window_year", "latest_valid_ts", "latest_valid_conflict", "last_observed_price",
        "last_observed_discount_pct", "money_issue")


@query("feature_contract_violations", "P18", with_ctes(*FEATURE_CTES, body="""
SELECT rule, violations FROM (
  SELECT 'required_feature_null' AS rule, count(*) FILTER (WHERE game_age_days IS NULL OR prior_price_record_count IS NULL) AS violations FROM feat
  UNION ALL SELECT 'negative_or_infinite', count(*) FILTER (WHERE game_age_days < 0 OR last_observed_price < 0 OR days_since_last_price_record < 0) FROM feat
  UNION ALL SELECT 'release_parts', count(*) FILTER (WHERE NOT (release_year BETWEEN 1 AND window_year AND release_quarter = (release_month + 2) // 3)) FROM feat
  UNION ALL SELECT 'discounts_exceed_records', count(*) FILTER (WHERE prior_discount_count > prior_price_record_count) FROM feat
  UNION ALL SELECT 'history_flags', count(*) FILTER (WHERE (prior_price_record_count > 0) <> (has_prior_price_history = 1) OR (prior_discount_count > 0) <> (has_prior_discount_observation = 1)) FROM feat
  UNION ALL SELECT 'discount_rate', count(*) FILTER (WHERE (prior_price_record_count = 0) <> (prior_discount_rate IS NULL)) FROM feat
  UNION ALL SELECT 'recency_not_prior', count(*) FILTER (WHERE days_since_last_price_record <= 0 OR days_since_last_discount <= 0) FROM feat
  UNION ALL SELECT 'percent_range', count(*) FILTER (WHERE max_prior_discount_pct > 100 OR mean_prior_discount_pct > 100) FROM feat
  UNION ALL SELECT 'filled_without_history', count(*) FILTER (WHERE prior_price_record_count = 0 AND (last_observed_price IS NOT NULL OR days_since_last_price_record IS NOT NULL)) FROM feat
  UNION ALL SELECT 'filled_without_discount', count(*) FILTER (WHERE prior_discount_count = 0 AND (max_prior_discount_pct IS NOT NULL OR days_since_last_discount IS NOT NULL)) FROM feat)"""))
def feature_contract_violations(spark, d):
    return features.contract_violations(features_of(spark, d))


# ------------------------------------------------------------------ labels
@query("operational_labels", "P15 P16", with_ctes(*LABEL_CTES, body="""
SELECT entity_id, window_year, category, discount_observed, pu_status, ambiguity_flag, requires_review,
  model_eligible, coalesce(category IN ('A', 'B') AND NOT requires_review, false) AS conservative_eligible FROM lab"""))
def operational_labels(spark, d):
    lab = labels_of(spark, d)
    strict = labels.with_policy(lab.drop("model_eligible", "evidence_sufficiency"), "conservative")
    return strict.withColumnRenamed("model_eligible", "conservative_eligible") \
        .withColumn("model_eligible", F.coalesce(F.col("category").isin("A", "B", "D"), F.lit(False))) \
        .select("entity_id", "window_year", "category", "discount_observed", "pu_status",
                "ambiguity_flag", "requires_review", "model_eligible", "conservative_eligible")


@query("labelability_view", "P17", with_ctes(*LABEL_CTES, body="""
SELECT entity_id, window_year, CASE WHEN model_eligible THEN discount_observed END AS discount_observed,
  CASE WHEN model_eligible AND discount_observed = 1 THEN 'usable_observed_discount'
       WHEN model_eligible THEN 'usable_observed_full_price' ELSE 'unknown_or_excluded' END AS labelability_status
FROM lab"""))
def labelability_view(spark, d):
    return labels.labelability(labels_of(spark, d))


@query("label_distribution", "A10", with_ctes(*LABEL_CTES, body="""
SELECT window_year, count(*) AS "rows", count(*) FILTER (WHERE category = 'A') AS category_a,
  count(*) FILTER (WHERE category = 'B') AS category_b, count(*) FILTER (WHERE category = 'C') AS category_c,
  count(*) FILTER (WHERE category = 'D') AS category_d, count(*) FILTER (WHERE discount_observed = 1) AS label_1,
  count(*) FILTER (WHERE discount_observed = 0) AS label_0, count(*) FILTER (WHERE discount_observed IS NULL) AS label_null,
  count(*) FILTER (WHERE pu_status = 'positive') AS pu_positive, count(*) FILTER (WHERE pu_status = 'unlabeled') AS pu_unlabeled,
  count(*) FILTER (WHERE requires_review) AS review_required,
  count(*) FILTER (WHERE eligibility_status = 'uncertain_release_hour') AS release_hour_uncertain
FROM lab GROUP BY ROLLUP (window_year)"""))
def label_distribution(spark, d):
    return labels.distribution(labels_of(spark, d))


@query("yearly_quality", "A11", with_ctes(*LABEL_CTES, body="""
SELECT window_year, count(*) AS target_entities, count(*) FILTER (WHERE category = 'A') AS category_a,
  count(*) FILTER (WHERE category = 'B') AS category_b, count(*) FILTER (WHERE category = 'C') AS category_c,
  count(*) FILTER (WHERE category = 'D') AS category_d, count(*) FILTER (WHERE category IS NULL) AS category_unknown,
  count(*) FILTER (WHERE model_eligible) AS usable_labels, count(*) FILTER (WHERE NOT model_eligible) AS unusable_labels,
  count(*) FILTER (WHERE eligibility_status = 'ineligible_by_release_date') AS ineligible,
  count(*) FILTER (WHERE entity_id IN (SELECT entity_id FROM obs)) AS entities_with_usable_history
FROM lab GROUP BY 1"""))
def yearly_quality(spark, d):
    usable = b.observations(spark, d).select("entity_id").distinct()
    return labels.yearly_quality(labels_of(spark, d), usable)


@query("yearly_labelability", "A29", with_ctes(*LABEL_CTES, body="""
, conf AS (SELECT DISTINCT entity_id, window_year FROM (
    SELECT entity_id, window_year, ts FROM tagged WHERE side = 'inside' GROUP BY 1, 2, 3 HAVING count(DISTINCT sig) > 1))
SELECT l.window_year, count(*) AS pairs, count(*) FILTER (WHERE category = 'A') AS category_a,
  count(*) FILTER (WHERE category = 'B') AS category_b, count(*) FILTER (WHERE category = 'C') AS category_c,
  count(*) FILTER (WHERE category = 'D') AS category_d, count(*) FILTER (WHERE category IS NULL) AS not_classified,
  count(*) FILTER (WHERE model_eligible AND discount_observed = 1) AS usable_positive,
  count(*) FILTER (WHERE model_eligible AND discount_observed = 0) AS usable_negative,
  count(*) FILTER (WHERE NOT model_eligible) AS unknown_or_excluded,
  round(100e0 * count(*) FILTER (WHERE model_eligible) / count(*), 6) AS usable_percent,
  count(*) FILTER (WHERE eligibility_status = 'ineligible_by_release_date') AS ineligible,
  count(*) FILTER (WHERE eligibility_status = 'uncertain_release_hour') AS release_hour_uncertain,
  count(conf.entity_id) AS conflict_pairs
FROM lab l LEFT JOIN conf ON conf.entity_id = l.entity_id AND conf.window_year = l.window_year
GROUP BY 1""").replace("\n, conf AS", ", conf AS"))
def yearly_labelability(spark, d):
    inside = evidence.inside_records(b.observations(spark, d), CAL)
    bad = evidence.conflicts(inside, "window_year").select("entity_id", "window_year").distinct()
    return labels.yearly_labelability(labels_of(spark, d), bad)


@query("positive_year_recurrence", "A19", with_ctes(*LABEL_CTES, body="""
, per AS (SELECT entity_id, CAST(sum(coalesce(discount_observed, 0)) AS INTEGER) AS positive_years FROM lab GROUP BY 1),
dense AS (SELECT CAST(range AS INTEGER) AS positive_years FROM range(0, 4))
SELECT d.positive_years, count(per.entity_id) AS entities,
  round(CAST(count(per.entity_id) AS DOUBLE) / (SELECT count(*) FROM per), 9) AS share
FROM dense d LEFT JOIN per USING (positive_years) GROUP BY 1""").replace("\n, per AS", ", per AS"))
def positive_year_recurrence(spark, d):
    return labels.recurrence(labels_of(spark, d), 3)


MODEL_CTES = (ENTITIES, OBS, WIN, PAIRS, TAGGED, INSIDE, EVIDENCE, LABELS, FEATURES)


@query("modeling_table", "J7 P19", with_ctes(*MODEL_CTES, body="""
SELECT f.entity_id, f.window_year, f.prediction_cutoff, l.category, l.discount_observed, l.model_eligible,
  f.prior_price_record_count, f.prior_discount_count, f.last_observed_price, f.game_age_days
FROM feat f JOIN lab l ON f.entity_id = l.entity_id AND f.window_year = l.window_year AND f.prediction_cutoff = l.window_start"""))
def modeling_table(spark, d):
    return modeling_rows(spark, d).select(
        "entity_id", "window_year", "prediction_cutoff", "category", "discount_observed",
        "model_eligible", "prior_price_record_count", "prior_discount_count", "last_observed_price",
        "game_age_days")


# ------------------------------------------------------------------ leakage audits
UNCHANGED = """SELECT window_year, count(*) AS compared_rows, CAST(0 AS BIGINT) AS changed_rows
FROM pairs WHERE eligible GROUP BY 1"""


@query("future_removal_invariance", "L1", with_ctes(ENTITIES, WIN, PAIRS, body=UNCHANGED))
def future_removal_invariance(spark, d):
    return features.future_removal_differences(b.entities(spark, d), b.observations(spark, d), CAL)


@query("boundary_insertion_invariance", "L2", with_ctes(ENTITIES, WIN, PAIRS, body=UNCHANGED))
def boundary_insertion_invariance(spark, d):
    return features.boundary_insertion_differences(
        b.entities(spark, d), b.observations(spark, d), CAL, b.SHOP)


@query("feature_lineage", "L3", with_ctes(ENTITIES, OBS, WIN, PAIRS, TAGGED, body="""
SELECT t.entity_id, t.window_year, count(*) FILTER (WHERE kind <> 'ambiguous') AS valid_records,
  count(*) FILTER (WHERE kind = 'ambiguous') AS ambiguous_records,
  count(*) FILTER (WHERE kind = 'discount') AS discount_records,
  count(*) FILTER (WHERE kind <> 'ambiguous' AND CAST(ts AS DATE) < release_date) AS records_before_release,
  count(*) FILTER (WHERE ts >= t.window_start) AS cutoff_violations,
  max(ts) FILTER (WHERE kind <> 'ambiguous') AS latest_valid_ts
FROM tagged t JOIN pairs p ON p.entity_id = t.entity_id AND p.window_year = t.window_year
WHERE side = 'before' AND p.eligible GROUP BY 1, 2"""))
def feature_lineage(spark, d):
    return features.lineage_summary(b.entities(spark, d), b.observations(spark, d), CAL)


@query("old_filter_impact", "L4 P23", with_ctes(ENTITIES, OBS, WIN_2001, PAIRS, TAGGED, body="""
, recent AS (SELECT DISTINCT t.entity_id FROM tagged t JOIN pairs p USING (entity_id)
  WHERE p.eligible AND side = 'before' AND kind <> 'ambiguous' AND ts >= TIMESTAMP '2001-01-01')
SELECT (SELECT count(*) FROM recent) AS changed_entities,
  count(*) FILTER (WHERE side = 'inside') AS in_window_records,
  count(*) FILTER (WHERE side = 'after') AS after_window_records,
  count(*) FILTER (WHERE side <> 'before') AS excluded_records FROM tagged""").replace("\n, recent AS", ", recent AS"))
def old_filter_impact(spark, d):
    return features.old_filter_impact(b.entities(spark, d), b.observations(spark, d), b.CALENDAR_2001,
                                      F.lit(b.HISTORY_END).cast("timestamp_ntz"))
