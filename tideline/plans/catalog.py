"""Catalog cleaning, profiling and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import catalog, evidence, labels, sampling
from tideline.plans import bindings as b
from tideline.plans.bindings import ENTITIES, OBS, PAIRS, TAGGED, WIN, with_ctes
from tideline.plans.evidence import CAL, FEATURE_CTES, LABEL_CTES, features_of, labels_of
from tideline.plans.registry import query


def raw_catalog(spark, d):
    """The part table as a text catalog with the usual defects spread over it."""
    part = b.entities(spark, d)
    k = F.col("entity_id")
    ident = F.when(k % 101 == 9, k - 1).otherwise(k).cast("string")
    day = F.col("release_date")
    bad_date = F.when(k % 41 == 3, "2021-02-29").when(k % 43 == 5, F.date_format(day, "MMM d, yyyy")) \
        .when(k % 83 == 4, "2020-1-01").when(k % 103 == 6, "").otherwise(day.cast("string"))
    return part.select(
        k.alias("row_key"),
        F.when(k % 97 == 5, F.concat(F.lit("0"), ident)).when(k % 89 == 7, F.concat(ident, F.lit(".0")))
        .when(k % 107 == 3, "").otherwise(ident).alias("id_text"),
        F.when(k % 53 == 11, "   ").otherwise(F.col("name")).alias("name"),
        bad_date.alias("release_text"),
        F.when(k % 47 == 2, "1900").otherwise(F.year(day).cast("string")).alias("release_year_text"),
        F.when(k % 37 == 2, "0").when(k % 31 == 4, "-1.5").when(k % 59 == 1, "n/a")
        .otherwise(F.col("price").cast("string")).alias("price_text"),
        F.when(k % 61 == 2, "50 - 20").when(k % 67 == 3, "unknown").when(k % 71 == 1, "0 - 0")
        .otherwise(F.concat_ws(" - ", (F.col("activity") * 1000).cast("string"), (F.col("activity") * 2000).cast("string")))
        .alias("owners_text"),
        F.concat_ws(", ", F.col("publisher"), F.when(k % 4 == 1, F.lit("Brand#1")), F.lit(" ")).alias("publishers"),
        F.col("publisher").alias("developers"), F.concat_ws(",", F.split("name", " ")).alias("tags"),
        F.col("genre"), F.col("activity"), F.col("price"), F.col("release_date"))


RAW = """raw AS (
  SELECT entity_id AS row_key,
    CASE WHEN entity_id % 97 = 5 THEN '0' || ident WHEN entity_id % 89 = 7 THEN ident || '.0' WHEN entity_id % 107 = 3 THEN '' ELSE ident END AS id_text,
    CASE WHEN entity_id % 53 = 11 THEN '   ' ELSE name END AS name,
    CASE WHEN entity_id % 41 = 3 THEN '2021-02-29' WHEN entity_id % 43 = 5 THEN strftime(release_date, '%b %-d, %Y')
         WHEN entity_id % 83 = 4 THEN '2020-1-01' WHEN entity_id % 103 = 6 THEN '' ELSE CAST(release_date AS VARCHAR) END AS release_text,
    CASE WHEN entity_id % 47 = 2 THEN '1900' ELSE CAST(year(release_date) AS VARCHAR) END AS release_year_text,
    CASE WHEN entity_id % 37 = 2 THEN '0' WHEN entity_id % 31 = 4 THEN '-1.5' WHEN entity_id % 59 = 1 THEN 'n/a' ELSE CAST(price AS VARCHAR) END AS price_text,
    CASE WHEN entity_id % 61 = 2 THEN '50 - 20' WHEN entity_id % 67 = 3 THEN 'unknown' WHEN entity_id % 71 = 1 THEN '0 - 0'
         ELSE (activity * 1000) || ' - ' || (activity * 2000) END AS owners_text,
    concat_ws(', ', publisher, CASE WHEN entity_id % 4 = 1 THEN 'Brand#1' END, ' ') AS publishers,
    publisher AS developers, replace(name, ' ', ',') AS tags, genre, activity, price, release_date
  FROM (SELECT *, CAST(CASE WHEN entity_id % 101 = 9 THEN entity_id - 1 ELSE entity_id END AS VARCHAR) AS ident FROM entities)),
typed AS (
  SELECT *, try_cast(id_text AS DOUBLE) AS id_num, try_cast(price_text AS DOUBLE) AS price_num,
    CASE WHEN release_text SIMILAR TO '[0-9]{4}-[0-9]{2}-[0-9]{2}' THEN CAST(try_strptime(release_text, '%Y-%m-%d') AS DATE)
         WHEN release_text SIMILAR TO '[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}' THEN CAST(try_strptime(release_text, '%b %d, %Y') AS DATE) END AS mixed_day,
    CASE WHEN release_text SIMILAR TO '[0-9]{4}-[0-9]{2}-[0-9]{2}' THEN CAST(try_strptime(release_text, '%Y-%m-%d') AS DATE) END AS strict_day,
    (id_text SIMILAR TO '[1-9][0-9]*' AND length(id_text) <= 10 AND coalesce(try_cast(id_text AS BIGINT), 0) <= 4294967295) AS strict_id,
    CASE WHEN owners_text SIMILAR TO '\\s*[0-9]+\\s*-\\s*[0-9]+\\s*' THEN CAST(regexp_extract(owners_text, '(\\d+)\\s*-\\s*(\\d+)', 1) AS BIGINT) END AS lo0,
    CASE WHEN owners_text SIMILAR TO '\\s*[0-9]+\\s*-\\s*[0-9]+\\s*' THEN CAST(regexp_extract(owners_text, '(\\d+)\\s*-\\s*(\\d+)', 2) AS BIGINT) END AS hi0,
    list_distinct(list_filter(list_transform(string_split(publishers, ','), lambda t: trim(t)), lambda t: t <> '')) AS pubs,
    list_distinct(list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> '')) AS tag_list
  FROM raw),
flags AS (
  SELECT *, NOT coalesce(id_num > 0 AND id_num <= 4294967295 AND id_num = floor(id_num), false) AS f0,
    trim(name) = '' AS f1, mixed_day IS NULL AS f2, price_num IS NULL AS f3, coalesce(price_num <= 0, true) AS f4 FROM typed),
master AS (SELECT CAST(id_num AS BIGINT) AS entity_id, trim(name) AS name, mixed_day AS release_date,
    CAST(year(mixed_day) AS INTEGER) AS release_year, price_num AS price FROM flags WHERE NOT (f0 OR f1 OR f2 OR f3 OR f4))"""
CAT = (ENTITIES, RAW)


def master_of(spark, d):
    return catalog.clean(raw_catalog(spark, d), catalog.rule_columns())


# ------------------------------------------------------------------ cleaning
@query("catalog_identity_columns", "P1", with_ctes(*CAT, body="SELECT id_text, release_text, release_year_text FROM raw"))
def catalog_identity_columns(spark, d):
    return raw_catalog(spark, d).select("id_text", "release_text", "release_year_text")


@query("cleaning_rule_audit", "P1", with_ctes(*CAT, body="""
SELECT 0 AS step, 'invalid_id' AS rule, count(*) FILTER (WHERE f0) AS failing, count(*) FILTER (WHERE f0) AS removed FROM flags
UNION ALL SELECT 1, 'missing_name', count(*) FILTER (WHERE f1), count(*) FILTER (WHERE f1 AND NOT f0) FROM flags
UNION ALL SELECT 2, 'invalid_release_date', count(*) FILTER (WHERE f2), count(*) FILTER (WHERE f2 AND NOT (f0 OR f1)) FROM flags
UNION ALL SELECT 3, 'invalid_price', count(*) FILTER (WHERE f3), count(*) FILTER (WHERE f3 AND NOT (f0 OR f1 OR f2)) FROM flags
UNION ALL SELECT 4, 'non_positive_price', count(*) FILTER (WHERE f4), count(*) FILTER (WHERE f4 AND NOT (f0 OR f1 OR f2 OR f3)) FROM flags"""))
def cleaning_rule_audit(spark, d):
    return catalog.rule_audit(raw_catalog(spark, d), catalog.rule_columns())


@query("cleaned_catalog", "P1 P5", with_ctes(*CAT, body="SELECT * FROM master"))
def cleaned_catalog(spark, d):
    return master_of(spark, d)


@query("id_domain", "P2", with_ctes(*CAT, body="SELECT row_key, id_text, strict_id AS valid FROM typed"))
def id_domain(spark, d):
    return raw_catalog(spark, d).select("row_key", "id_text", rules.valid_id(F.col("id_text")).alias("valid"))


@query("strict_dates", "P3", with_ctes(*CAT, body="SELECT row_key, release_text, strict_day AS day FROM typed"))
def strict_dates(spark, d):
    return raw_catalog(spark, d).select("row_key", "release_text", rules.strict_date(F.col("release_text")).alias("day"))


@query("mixed_date_report", "P4", with_ctes(*CAT, body="""
SELECT count(*) AS "rows", count(*) FILTER (WHERE release_text IS NULL) AS nulls, count(*) FILTER (WHERE release_text = '') AS empty,
  count(mixed_day) AS parsed, count(*) FILTER (WHERE mixed_day IS NULL) AS failed, min(mixed_day) AS earliest, max(mixed_day) AS latest FROM typed"""))
def mixed_date_report(spark, d):
    return catalog.date_report(raw_catalog(spark, d), "release_text")


@query("mixed_date_failures", "P4", with_ctes(*CAT, body="""
SELECT release_text AS value, count(*) AS "rows" FROM typed WHERE mixed_day IS NULL GROUP BY 1"""))
def mixed_date_failures(spark, d):
    return catalog.date_failures(raw_catalog(spark, d), "release_text")


@query("numeric_coercion", "P5", with_ctes(*CAT, body="""
SELECT 'id_text' AS "column", count(id_text) AS present, count(*) FILTER (WHERE id_num IS NULL) AS not_numeric, min(id_num) AS low, max(id_num) AS high FROM typed
UNION ALL SELECT 'price_text', count(price_text), count(*) FILTER (WHERE price_num IS NULL), min(price_num), max(price_num) FROM typed"""))
def numeric_coercion(spark, d):
    return catalog.coercion_report(raw_catalog(spark, d), ["id_text", "price_text"])


@query("master_contract", "P6", with_ctes(*CAT, body="""
SELECT 'id_range' AS rule, count(*) FILTER (WHERE NOT entity_id BETWEEN 1 AND 4294967295) AS violations FROM master
UNION ALL SELECT 'blank_name', count(*) FILTER (WHERE trim(name) = '') FROM master
UNION ALL SELECT 'date_year', count(*) FILTER (WHERE year(release_date) <> release_year) FROM master
UNION ALL SELECT 'price', count(*) FILTER (WHERE NOT price > 0) FROM master
UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT entity_id FROM master GROUP BY 1 HAVING count(*) > 1)"""))
def master_contract(spark, d):
    return catalog.master_violations(master_of(spark, d))


# ------------------------------------------------------------------ bands
@query("price_quartile_bands", "P7", with_ctes(ENTITIES, body="""
, q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3 FROM entities)
SELECT entity_id, price, CASE WHEN price <= q1 THEN 'Low price' WHEN price <= q2 THEN 'Lower-mid price'
  WHEN price <= q3 THEN 'Upper-mid price' ELSE 'High price' END AS price_band FROM entities, q""").replace("\n, q AS", ", q AS"))
def price_quartile_bands(spark, d):
    return catalog.quartile_bands(b.entities(spark, d).select("entity_id", "price"), "price")


STRATA = ("early_90s", "mid_90s", "late_90s", "around_2000")
STRATUM_SQL = """CASE WHEN year(release_date) < 1995 THEN 'early_90s' WHEN year(release_date) < 1997 THEN 'mid_90s'
  WHEN year(release_date) < 1999 THEN 'late_90s' WHEN year(release_date) < 2002 THEN 'around_2000' ELSE 'outside_historical_frame' END"""


def stratum_column():
    return catalog.release_stratum(F.col("release_date"), (1995, 1997, 1999, 2002), STRATA)


@query("fixed_bands", "P8", with_ctes(*CAT, body=f"""
SELECT row_key, {STRATUM_SQL} AS stratum,
  CASE WHEN hi = 0 THEN 'zero' WHEN hi <= 20000 THEN 'low' WHEN hi <= 50000 THEN 'middle' WHEN hi IS NOT NULL THEN 'high' END AS owner_group,
  CASE WHEN activity = 0 THEN '0' WHEN activity <= 9 THEN '1-9' WHEN activity <= 29 THEN '10-29' ELSE '30+' END AS activity_band,
  CASE WHEN year(release_date) <= 1994 THEN 'era 1' WHEN year(release_date) <= 1997 THEN 'era 2' ELSE 'era 3' END AS era
FROM (SELECT *, CASE WHEN lo0 <= hi0 THEN hi0 END AS hi FROM typed)"""))
def fixed_bands(spark, d):
    _, high = rules.range_bounds(F.col("owners_text"))
    return raw_catalog(spark, d).select(
        "row_key", stratum_column().alias("stratum"), catalog.owner_group(high).alias("owner_group"),
        rules.coverage_group(F.col("activity")).alias("activity_band"),
        rules.band(F.year("release_date"), (1994, 1997), ("era 1", "era 2", "era 3")).alias("era"))


@query("owner_ranges", "P9", with_ctes(*CAT, body="""
SELECT row_key, owners_text, CASE WHEN lo0 <= hi0 THEN lo0 END AS low, CASE WHEN lo0 <= hi0 THEN hi0 END AS high FROM typed"""))
def owner_ranges(spark, d):
    low, high = rules.range_bounds(F.col("owners_text"))
    return raw_catalog(spark, d).select("row_key", "owners_text", low.alias("low"), high.alias("high"))


@query("activity_percentile_class", "A27", with_ctes(ENTITIES, body="""
, c AS (SELECT quantile_cont(activity, 0.9) AS q FROM entities WHERE activity > 0)
SELECT entity_id, activity, CASE WHEN activity = 0 THEN 'zero' WHEN activity < q THEN 'below_high' ELSE 'high' END AS activity_group
FROM entities, c""").replace("\n, c AS", ", c AS"))
def activity_percentile_class(spark, d):
    return catalog.activity_classes(b.entities(spark, d).select("entity_id", "activity"), "activity")


@query("cohort_contract", "P20", with_ctes(*CAT, body="""
SELECT 'invalid_id' AS rule, count(*) FILTER (WHERE NOT strict_id) AS violations FROM typed
UNION ALL SELECT 'blank_name', count(*) FILTER (WHERE trim(name) = '') FROM typed
UNION ALL SELECT 'date_not_canonical', count(*) FILTER (WHERE strict_day IS NULL) FROM typed
UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id_text FROM typed GROUP BY 1 HAVING count(*) > 1)"""))
def cohort_contract(spark, d):
    from tideline.operators.features import count_violations

    raw = raw_catalog(spark, d)
    dup = raw.groupBy("id_text").agg(F.count("*").alias("n")).agg(
        F.lit("duplicate_id").alias("rule"), F.count_if(F.col("n") > 1).alias("violations"))
    return count_violations(raw, {
        "invalid_id": ~rules.valid_id(F.col("id_text")), "blank_name": F.trim("name") == "",
        "date_not_canonical": rules.strict_date(F.col("release_text")).isNull()}).unionByName(dup)


# ------------------------------------------------------------------ profiles
@query("null_profile", "A13", with_ctes(*CAT, body="\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round(100e0 * (count(*) - count({c})) / count(*), 6) AS null_percent, "
    f"count(*) FILTER (WHERE {c} = '') AS empty FROM raw"
    for c in ("id_text", "name", "release_text", "price_text", "owners_text"))))
def null_profile(spark, d):
    return catalog.null_profile(raw_catalog(spark, d).select("id_text", "name", "release_text", "price_text", "owners_text"))


@query("categorical_profile", "A14", with_ctes(ENTITIES, body="""
, long AS (SELECT 'genre' AS "column", genre AS value FROM entities UNION ALL SELECT 'activity', CAST(activity AS VARCHAR) FROM entities
  UNION ALL SELECT 'publisher', publisher FROM entities),
c AS (SELECT "column", value, count(*) AS n, count(*) OVER (PARTITION BY "column") AS distinct_values FROM long GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS hi, row_number() OVER (PARTITION BY "column" ORDER BY n, value DESC) AS lo FROM c)
SELECT "column", value, n AS "rows", distinct_values, 'top' AS part, CAST(hi AS INTEGER) AS position FROM r WHERE (distinct_values <= 30 AND hi <= 30) OR hi <= 10
UNION ALL SELECT "column", value, n, distinct_values, 'bottom', CAST(lo AS INTEGER) FROM r WHERE distinct_values > 30 AND lo <= 3
""").replace("\n, long", ", long"))
def categorical_profile(spark, d):
    return catalog.categorical_profile(b.entities(spark, d), ["genre", "activity", "publisher"])


@query("numeric_profile", "A15", """
SELECT "column", count(v) AS n, count(*) - count(v) AS nulls, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  min(v) AS low, max(v) AS high, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75
FROM (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
      UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY 1""")
def numeric_profile(spark, d):
    return catalog.numeric_profile(b.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("suspicious_values", "A15", """
SELECT 'zero_discount' AS flag, count(*) FILTER (WHERE l_discount = 0) AS "rows" FROM lineitem
UNION ALL SELECT 'negative_price', count(*) FILTER (WHERE l_extendedprice < 0) FROM lineitem
UNION ALL SELECT 'high_price', count(*) FILTER (WHERE l_extendedprice > 90000) FROM lineitem""")
def suspicious_values(spark, d):
    c = F.col
    return catalog.suspicious_counts(b.table(spark, d, "lineitem"), {
        "zero_discount": c("l_discount") == 0, "negative_price": c("l_extendedprice") < 0,
        "high_price": c("l_extendedprice") > 90000})


@query("five_largest_orders", "K2", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def five_largest_orders(spark, d):
    return catalog.n_largest(b.table(spark, d, "orders"), "o_totalprice", 5, "o_orderkey")


@query("duplicate_report", "A16", """
WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate FROM lineitem),
f AS (SELECT count(*) AS n FROM r GROUP BY l_orderkey, l_partkey, l_linenumber, l_shipdate), k AS (SELECT l_orderkey, count(*) AS n FROM r GROUP BY 1)
SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM f) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS repeated_ids,
  CAST(sum(n - 1) AS BIGINT) AS excess_id_rows, count(*) AS distinct_ids FROM k""")
def duplicate_report(spark, d):
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    return catalog.duplicate_report(rows, "l_orderkey")


@query("top_repeated_ids", "A16", """
SELECT l_orderkey, count(*) AS "rows" FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def top_repeated_ids(spark, d):
    return catalog.top_repeated(b.table(spark, d, "lineitem"), "l_orderkey")


@query("catalog_audit", "A17", with_ctes(*CAT, body="""
, ids AS (SELECT id_text, count(*) AS n FROM typed WHERE strict_id GROUP BY 1)
SELECT count(*) AS records, count(*) FILTER (WHERE trim(id_text) = '') AS missing_ids,
  count(*) FILTER (WHERE NOT strict_id AND trim(id_text) <> '') AS invalid_ids,
  count(*) FILTER (WHERE trim(release_text) = '') AS missing_dates,
  count(*) FILTER (WHERE strict_day IS NULL AND trim(release_text) <> '') AS invalid_dates,
  count(*) FILTER (WHERE strict_day IS NOT NULL AND release_year_text <> CAST(year(strict_day) AS VARCHAR)) AS year_mismatches,
  (SELECT count(*) FROM ids) AS unique_ids, (SELECT count(*) FROM ids WHERE n > 1) AS duplicate_ids,
  (SELECT CAST(sum(n - 1) AS BIGINT) FROM ids) AS excess_rows FROM typed""").replace("\n, ids", ", ids"))
def catalog_audit(spark, d):
    return catalog.catalog_audit(raw_catalog(spark, d))


@query("eligible_for_every_window", "A17", with_ctes(*CAT, body="""
SELECT count(*) FILTER (WHERE strict_day <= DATE '1998-11-21') AS eligible_all,
  count(*) FILTER (WHERE strict_day < DATE '1998-11-21') AS strictly_before_all FROM typed"""))
def eligible_for_every_window(spark, d):
    return catalog.eligible_everywhere(raw_catalog(spark, d), CAL)


@query("release_year_counts", "A21 A17", with_ctes(ENTITIES, body="""
, y AS (SELECT unnest(range(min(year(release_date)), max(year(release_date)) + 1)) AS release_year FROM entities)
SELECT CAST(y.release_year AS INTEGER) AS release_year, count(e.entity_id) AS entities FROM y LEFT JOIN entities e ON year(e.release_date) = y.release_year GROUP BY 1
""").replace("\n, y AS", ", y AS"))
def release_year_counts(spark, d):
    return catalog.yearly_counts_dense(b.entities(spark, d))


@query("history_coverage_summary", "A18", with_ctes(OBS, WIN, TAGGED, body="""
, per AS (SELECT entity_id, window_year, side, count(*) AS n, count(*) FILTER (WHERE kind <> 'ambiguous') AS v, count(*) FILTER (WHERE kind = 'discount') AS d FROM tagged GROUP BY 1, 2, 3
  UNION ALL SELECT entity_id, NULL, 'all', count(*), count(*) FILTER (WHERE kind <> 'ambiguous'), count(*) FILTER (WHERE kind = 'discount') FROM obs GROUP BY 1)
SELECT window_year, side, count(*) AS entities_with_records, count(*) FILTER (WHERE v > 0) AS entities_with_valid,
  count(*) FILTER (WHERE d > 0) AS entities_with_discount, CAST(sum(n) AS BIGINT) AS records, CAST(sum(v) AS BIGINT) AS valid_records, CAST(sum(d) AS BIGINT) AS discount_records
FROM per GROUP BY 1, 2""").replace("\n, per", ", per"))
def history_coverage_summary(spark, d):
    return catalog.coverage_summary(b.observations(spark, d), CAL)


@query("discount_histogram", "A20", """
SELECT b.bin, lower, upper, upper_closed, count(l_quantity) AS n FROM (
  SELECT CAST(range AS INTEGER) AS bin, range * 5e0 AS lower, range * 5e0 + 5 AS upper, range = 9 AS upper_closed FROM range(0, 10)) b
LEFT JOIN lineitem ON l_quantity >= lower AND (l_quantity < upper OR (upper_closed AND l_quantity <= upper)) GROUP BY 1, 2, 3, 4""")
def discount_histogram(spark, d):
    return catalog.histogram(b.table(spark, d, "lineitem"), "l_quantity", [5.0 * i for i in range(11)])


# ------------------------------------------------------------------ tokens
PUB_TOKENS = lambda: rules.tokens(F.col("publishers"))


@query("developer_publisher_overlap", "J12 F5", with_ctes(*CAT, body="""
SELECT row_key, list_has_any([developers], pubs) AS self_published, list_has_any(pubs, ['Brand#1']) AS has_brand_one FROM typed"""))
def developer_publisher_overlap(spark, d):
    return raw_catalog(spark, d).select(
        "row_key", F.arrays_overlap(rules.tokens(F.col("developers")), PUB_TOKENS()).alias("self_published"),
        F.arrays_overlap(PUB_TOKENS(), F.array(F.lit("Brand#1"))).alias("has_brand_one"))


@query("token_frequencies", "A26", with_ctes(*CAT, body="""
SELECT token, count(*) AS entities FROM (SELECT unnest(tag_list) AS token FROM typed) GROUP BY 1"""))
def token_frequencies(spark, d):
    return catalog.token_counts(raw_catalog(spark, d), rules.tokens(F.col("tags")))


PORTFOLIO_SQL = """
, owned AS (SELECT token, count(*) AS size FROM (SELECT unnest(pubs) AS token FROM typed) GROUP BY 1)"""


@query("owner_portfolios", "A26", with_ctes(*CAT, body=PORTFOLIO_SQL + """
SELECT row_key AS entity_id, coalesce(max(size), 0) AS portfolio FROM (SELECT row_key, unnest(pubs) AS token FROM typed) t
LEFT JOIN owned USING (token) GROUP BY 1""").replace("\n, owned", ", owned"))
def owner_portfolios(spark, d):
    return catalog.portfolio_sizes(raw_catalog(spark, d).withColumnRenamed("row_key", "entity_id"), PUB_TOKENS())


@query("portfolio_threshold", "A26", with_ctes(*CAT, body=PORTFOLIO_SQL + """
SELECT round(quantile_cont(size, 0.95), 6) AS threshold FROM owned""").replace("\n, owned", ", owned"))
def portfolio_threshold(spark, d):
    return catalog.portfolio_threshold(raw_catalog(spark, d), PUB_TOKENS()).select(F.round("threshold", 6).alias("threshold"))


# ------------------------------------------------------------------ sampling
@query("hash_priority", "W1 F2", with_ctes(ENTITIES, body="""
SELECT entity_id, sha256('42:' || entity_id) AS pilot_key, sha256('42|' || entity_id) AS sample_key,
  sha256('window-split|42|' || entity_id) AS split_key FROM entities"""))
def hash_priority(spark, d):
    k = F.col("entity_id")
    return b.entities(spark, d).select(
        "entity_id", rules.hash_priority(k, "42:").alias("pilot_key"), rules.hash_priority(k, "42|").alias("sample_key"),
        rules.hash_priority(k, "window-split|42|").alias("split_key"))


SPLIT_SQL = """split AS (
  SELECT entity_id, CASE WHEN list_sum(list_transform(string_split(sha256('window-split|42|' || entity_id), ''),
    lambda c: strpos('0123456789abcdef', c) - 1)) % 5 = 0 THEN 'evaluation' ELSE 'development' END AS evaluation_group FROM entities)"""


@query("stable_hash_split", "W2", with_ctes(ENTITIES, SPLIT_SQL, body="SELECT * FROM split"))
def stable_hash_split(spark, d):
    return b.entities(spark, d).select("entity_id", rules.evaluation_group(F.col("entity_id"), "window-split|42|").alias("evaluation_group"))


INTERLEAVE_SQL = f"""strat AS (
  SELECT entity_id, {STRATUM_SQL} AS stratum, sha256('42|' || entity_id) AS priority FROM entities),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY priority, entity_id) AS stratum_rank, count(*) OVER (PARTITION BY stratum) AS stratum_size
  FROM strat WHERE stratum <> 'outside_historical_frame'),
sampled AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * stratum_rank - 1 AS DECIMAL(38, 18)) / (2 * stratum_size), stratum, priority, entity_id) AS sample_rank FROM ranked)"""


def sampled_of(spark, d):
    rows = sampling.with_priority(b.entities(spark, d).select("entity_id", stratum_column().alias("stratum")))
    return sampling.interleave(rows, "stratum", STRATA)


@query("stratified_interleave", "W3", with_ctes(ENTITIES, INTERLEAVE_SQL, body="""
SELECT entity_id, stratum, priority, stratum_rank, stratum_size, sample_rank FROM sampled"""))
def stratified_interleave(spark, d):
    return sampled_of(spark, d).select("entity_id", "stratum", "priority", "stratum_rank", "stratum_size", "sample_rank")


SIZES = (50, 100, 1000)


@query("nested_cohorts", "W4", with_ctes(ENTITIES, INTERLEAVE_SQL, body="""
SELECT entity_id, sample_rank, CASE WHEN sample_rank <= 40 THEN 1 ELSE 0 END AS included_in_50,
  CASE WHEN sample_rank <= 90 THEN 1 ELSE 0 END AS included_in_100, CASE WHEN sample_rank <= 990 THEN 1 ELSE 0 END AS included_in_1000 FROM sampled"""))
def nested_cohorts(spark, d):
    return sampling.nested_cohorts(sampled_of(spark, d), SIZES, always=10).select(
        "entity_id", "sample_rank", *[f"included_in_{n}" for n in SIZES])


@query("cohort_composition", "W4", with_ctes(ENTITIES, INTERLEAVE_SQL, body="""
SELECT stratum, stratum_size, n AS cohort_size, count(*) FILTER (WHERE sample_rank <= n - 10) AS members,
  round(CAST(count(*) FILTER (WHERE sample_rank <= n - 10) AS DOUBLE) / stratum_size, 9) AS inclusion_probability
FROM sampled CROSS JOIN (VALUES (50), (100), (1000)) AS c(n) GROUP BY 1, 2, 3"""))
def cohort_composition(spark, d):
    return sampling.cohort_composition(sampled_of(spark, d), "stratum", SIZES, always=10)


QUOTA_SQL = """
, sz AS (SELECT genre, count(*) AS entities FROM entities GROUP BY 1),
ex AS (SELECT *, 80 * sqrt(entities) / sum(sqrt(entities)) OVER () AS exact FROM sz),
pl AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, genre) AS place, 80 - sum(floor(exact)) OVER () AS left_over FROM ex),
era_quota AS (SELECT genre, entities, CAST(floor(exact) + CASE WHEN place <= left_over THEN 1 ELSE 0 END AS INTEGER) AS quota FROM pl)"""


def era_quotas(spark, d):
    sizes = b.entities(spark, d).groupBy("genre").agg(F.count("*").alias("entities"))
    return sampling.sqrt_quotas(sizes, 80, "genre", "entities")


@query("sqrt_quotas", "W5", with_ctes(ENTITIES, body=QUOTA_SQL + " SELECT * FROM era_quota").replace("\n, sz", ", sz"))
def sqrt_quotas(spark, d):
    return era_quotas(spark, d)


CELL_SQL = QUOTA_SQL + f""",
cells AS (SELECT genre, {STRATUM_SQL} AS band, count(*) AS cell_size FROM entities GROUP BY 1, 2),
cex AS (SELECT c.*, e.quota AS total, e.quota * sqrt(cell_size) / sum(sqrt(cell_size)) OVER (PARTITION BY c.genre) AS exact FROM cells c JOIN era_quota e USING (genre)),
cpl AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY exact - floor(exact) DESC, band) AS place, total - sum(floor(exact)) OVER (PARTITION BY genre) AS left_over FROM cex),
cell_quota AS (SELECT genre, band, cell_size, CAST(floor(exact) + CASE WHEN place <= left_over THEN 1 ELSE 0 END AS INTEGER) AS quota FROM cpl)"""


def cell_quotas(spark, d):
    cells = b.entities(spark, d).groupBy("genre", stratum_column().alias("band")).agg(F.count("*").alias("cell_size"))
    totals = era_quotas(spark, d).select("genre", F.col("quota").alias("total"))
    return sampling.sqrt_quotas(cells.join(totals, "genre"), F.col("total"), "band", "cell_size", ["genre"]).drop("total")


@query("two_level_quotas", "W5", with_ctes(ENTITIES, body=CELL_SQL + " SELECT * FROM cell_quota").replace("\n, sz", ", sz"))
def two_level_quotas(spark, d):
    return cell_quotas(spark, d)


@query("capped_stratified_pick", "W6", with_ctes(ENTITIES, body=CELL_SQL + f""",
cand AS (SELECT entity_id, genre, publisher || '/' || activity AS owner, {STRATUM_SQL} AS band, sha256('42:' || entity_id) AS priority FROM entities),
cap AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY priority, entity_id) AS o FROM cand),
rk AS (SELECT *, row_number() OVER (PARTITION BY genre, band ORDER BY priority, entity_id) AS pick FROM cap WHERE o <= 2)
SELECT entity_id, genre, band, owner, pick FROM rk JOIN cell_quota USING (genre, band) WHERE pick <= quota""").replace("\n, sz", ", sz"))
def capped_stratified_pick(spark, d):
    cand = sampling.with_priority(b.entities(spark, d).select(
        "entity_id", "genre", F.concat_ws("/", "publisher", F.col("activity").cast("string")).alias("owner"),
        stratum_column().alias("band")), prefix_text="42:")
    return sampling.capped_pick(cand, cell_quotas(spark, d), ["genre", "band"], "owner").select(
        "entity_id", "genre", "band", "owner", "pick")


@query("extreme_case_tags", "W7", with_ctes(ENTITIES, body="""
, e AS (SELECT *, sha256('42:' || entity_id) AS h FROM entities),
p AS (
  SELECT 'edge_high_price' AS reason, (SELECT entity_id FROM e ORDER BY price DESC, h LIMIT 1) AS entity_id
  UNION ALL SELECT 'edge_low_price', (SELECT entity_id FROM e ORDER BY price, h LIMIT 1)
  UNION ALL SELECT 'edge_oldest', (SELECT entity_id FROM e ORDER BY release_date, h LIMIT 1)
  UNION ALL SELECT 'edge_near_cutoff', (SELECT entity_id FROM e ORDER BY release_date DESC, h LIMIT 1)
  UNION ALL SELECT 'edge_high_activity', (SELECT entity_id FROM e ORDER BY activity DESC, h LIMIT 1)
  UNION ALL SELECT 'edge_low_key', (SELECT entity_id FROM e WHERE price = (SELECT min(price) FROM e) ORDER BY h LIMIT 1))
SELECT entity_id, string_agg(reason, ';' ORDER BY reason) AS reasons FROM p GROUP BY 1""").replace("\n, e AS", ", e AS"))
def extreme_case_tags(spark, d):
    rows = sampling.with_priority(b.entities(spark, d), prefix_text="42:")
    c, h, every = F.col, F.col("priority"), F.lit(True)
    low = lambda x: F.struct(x.cast("double"), h)
    return sampling.extreme_cases(rows, {
        "edge_high_price": (every, low(-c("price"))), "edge_low_price": (every, low(c("price"))),
        "edge_oldest": (every, low(F.unix_date("release_date"))),
        "edge_near_cutoff": (every, low(-F.unix_date("release_date"))),
        "edge_high_activity": (every, low(-c("activity"))), "edge_low_key": (every, low(c("price")))})


EDGES = {  # reason: condition, order (smallest first, ties by hash), both as SQL over the entities below
    "edge_high_price": ("true", "-price"), "edge_low_price": ("true", "price"), "edge_oldest": ("true", "days"), "edge_near_cutoff": ("true", "-days"),
    "edge_high_activity": ("true", "-activity"), "edge_high_extras": ("true", "-extras"), "edge_high_owners": ("owners > 0", "-owners"),
    "edge_zero_owners": ("owners = 0", "0 * price"), "edge_zero_activity": ("activity % 25 = 0", "0 * price"), "edge_missing_tags": ("tags IS NULL", "0 * price"),
    "edge_missing_genre": ("genre IS NULL", "0 * price"), "edge_missing_publisher": ("publisher IS NULL AND price > 1e9", "0 * price")}
EDGE_COLUMNS = ("entity_id", "price", "activity", "entity_id * 13 % 37 AS extras", "entity_id % 29 * 1000 AS owners", "CASE WHEN entity_id % 31 = 6 THEN NULL ELSE name END AS tags",
                "CASE WHEN entity_id % 41 = 7 THEN NULL ELSE genre END AS genre", "publisher")


@query("conditional_extreme_tags", "W7", with_ctes(ENTITIES, body=f"""
, e AS (SELECT {', '.join(EDGE_COLUMNS)}, date_diff('day', DATE '1970-01-01', release_date) AS days, sha256('42:' || entity_id) AS h FROM entities),
p AS (""" + "\n  UNION ALL ".join(f"SELECT '{r}' AS reason, (SELECT entity_id FROM e WHERE {w} ORDER BY {o}, h LIMIT 1) AS entity_id" for r, (w, o) in EDGES.items()) + """)
SELECT entity_id, string_agg(reason, ';' ORDER BY reason) AS reasons FROM p WHERE entity_id IS NOT NULL GROUP BY 1""").replace("\n, e AS", ", e AS"))
def conditional_extreme_tags(spark, d):
    """Twelve criteria, some over the rows that meet a condition only; one that nothing meets picks nothing."""
    rows = sampling.with_priority(b.entities(spark, d), prefix_text="42:").selectExpr(*EDGE_COLUMNS, "unix_date(release_date) AS days", "priority")
    return sampling.extreme_cases(rows, {r: (F.expr(w), F.struct(F.expr(o).cast("double"), F.col("priority"))) for r, (w, o) in EDGES.items()})


@query("sample_and_extremes", "K3", with_ctes(ENTITIES, body="""
, e AS (SELECT *, sha256('42|' || entity_id) AS h FROM entities)
SELECT * FROM (SELECT 'sample' AS selection, entity_id, price FROM e ORDER BY h, entity_id LIMIT 4)
UNION ALL SELECT * FROM (SELECT 'high_price', entity_id, price FROM e ORDER BY price DESC, entity_id LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'high_activity', entity_id, price FROM e ORDER BY activity DESC, entity_id LIMIT 1)""").replace("\n, e AS", ", e AS"))
def sample_and_extremes(spark, d):
    e = sampling.with_priority(b.entities(spark, d))
    pick = lambda name, order, n: e.orderBy(*order).limit(n).select(F.lit(name).alias("selection"), "entity_id", "price")
    return pick("sample", ["priority", "entity_id"], 4) \
        .unionByName(pick("high_price", [F.desc("price"), "entity_id"], 1)) \
        .unionByName(pick("high_activity", [F.desc("activity"), "entity_id"], 1))


@query("sample_membership", "J11 U3", with_ctes(ENTITIES, INTERLEAVE_SQL, body="""
SELECT (SELECT count(*) FROM sampled WHERE sample_rank <= 40 AND entity_id NOT IN (SELECT entity_id FROM sampled WHERE sample_rank <= 90)) AS missing,
  CAST(0 AS BIGINT) AS duplicate_keys"""))
def sample_membership(spark, d):
    s = sampling.nested_cohorts(sampled_of(spark, d), SIZES, always=10)
    inner = s.where("included_in_50 = 1").select("entity_id")
    return sampling.membership_checks(inner, s.where("included_in_100 = 1").select("entity_id"))


@query("split_disjointness", "J11 M2", with_ctes(ENTITIES, SPLIT_SQL, body="""
SELECT evaluation_group, count(*) AS entities, (SELECT count(*) FROM split a JOIN split e USING (entity_id)
  WHERE a.evaluation_group = 'development' AND e.evaluation_group = 'evaluation') AS shared FROM split GROUP BY 1"""))
def split_disjointness(spark, d):
    s = stable_hash_split(spark, d)
    shared = sampling.overlap_count(s.where("evaluation_group = 'development'"), s.where("evaluation_group = 'evaluation'"))
    return s.groupBy("evaluation_group").agg(F.count("*").alias("entities")).withColumn("shared", shared.scalar())
