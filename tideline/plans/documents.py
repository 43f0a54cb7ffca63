"""Queries that go from saved history documents to statuses, evidence and labels.

Every order stands for an entity and its lines for the records of one document in the published layout. Defects are planted by
order key, one kind for each remainder, so every reason of the provenance checks occurs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import evidence, labels, observations as obs_ops
from tideline.plans import bindings as b
from tideline.plans.registry import query
from tideline.session import durable
from tideline.sources import history

SINCE = "1990-01-01T00:00:00Z"
CONFIG = dict(country="US", shop_id=b.SHOP, since=SINCE, **history.PUBLISHED_ENDPOINTS, check_parameters=True)


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def lines(spark, d):
    """(k, line, json): one JSON record for each line, with records that cannot be used planted on first lines."""
    c, m = F.col, F.col("l_orderkey") % 97
    first = c("l_linenumber") == 1
    units = lambda x: F.floor(x * 100 + 0.5).cast("bigint")
    money = lambda x: F.struct(x.alias("amount"), units(x).alias("amountInt"), F.lit("USD").alias("currency"))
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.concat(stamp, F.when(first & (m == 71), "").otherwise("Z"))
    own = c("l_suppkey") % 10 != 0
    shop = F.struct(F.when(own, b.SHOP).otherwise(35).alias("id"), F.when(own, "main").otherwise("other").alias("name"))
    deal = F.struct(money(c("l_extendedprice") * (1 - c("l_discount"))).alias("price"), money(c("l_extendedprice")).alias("regular"),
                    F.floor(c("l_discount") * 100 + 0.5).alias("cut"))
    whole = _json(timestamp=stamp, shop=shop, deal=F.when(c("l_tax") != 0, deal))
    text = (F.when(first & (m == 61), "5")
            .when(first & (m == 67), _json(timestamp=stamp, shop=F.struct(F.lit("61").alias("id"))))
            .when(first & (m == 73), _json(timestamp=stamp, shop=F.lit(None).cast("string")))
            .when((c("l_tax") == 0) & (c("l_linenumber") % 2 == 1), _json(timestamp=stamp, shop=shop)).otherwise(whole))
    return b.table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("line"), text.alias("json"))


def documents(spark, d):
    """(path, text) of the documents and their manifest. An order has a few lines, so its records fit one document."""
    gathered = lines(spark, d).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("line", "json"))).alias("r"))
    keys = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 97).alias("m"))
    records = F.coalesce(F.col("r.json"), F.array().cast("array<string>"))
    # Never broadcast: the rows must be spread like the records, not like the small file of orders.
    rows = keys.join(gathered.hint("merge"), "k", "left").select(
        "k", "m", F.size(records).cast("bigint").alias("n"), F.concat(F.lit("["), F.array_join(records, ","), F.lit("]")).alias("history"))
    # The manifest knows the number of records only, so it moves none of them.
    counted = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    listed = keys.join(counted, "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    m = F.col("m")
    put = lambda defect, wrong, right: F.when(m == defect, wrong).otherwise(right)
    provider = F.concat(F.lit("g"), F.col("k").cast("string"))
    status = F.when(F.col("n") > 0, "history_received").otherwise("empty_history")
    parts = {
        "steam_appid": F.when(m == 47, F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('"'))).otherwise(F.col("k").cast("string")),
        "itad_game_id": F.concat(F.lit('"'), provider, F.lit('"')),
        "request_configuration": _json(
            country=put(7, "DE", "US"), steam_shop_id=F.lit(b.SHOP), requested_since=F.lit(SINCE),
            history_endpoint=put(11, "/games/history/v1", "/games/history/v2"), lookup_endpoint=F.lit("/games/lookup/v1")),
        "lookup_response": _json(found=put(16, F.lit(False), F.lit(True)), game=F.struct(F.when(m == 17, "other").otherwise(provider).alias("id"))),
        "history_evidence": _json(
            http_status=put(23, 500, 200), body=put(31, "[]", F.col("history")),
            params=F.struct(provider.alias("id"), F.lit("US").alias("country"), put(29, "62", "61").alias("shops"), F.lit(SINCE).alias("since"))),
        "history_response": F.col("history"),
        "collection_metadata": _json(
            lookup_status=put(13, "lookup_error", "matched"),
            history_status=F.when(m == 19, "request_failed").when(m == 37, "empty_history").otherwise(status)),
    }
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in parts.items()]), F.lit("}"))
    text = F.when(m == 3, '{"steam_appid":1,"steam_appid":2}').otherwise(body)
    docs = rows.where("k % 31 <> 5").select(F.concat(F.lit("documents/"), F.col("k").cast("string"), F.lit(".json")).alias("path"), text.alias("text"))
    manifest = listed.where("m <> 53").select(
        F.col("k").alias("entity_id"), F.when(m == 43, "other").otherwise(provider).alias("provider_id"),
        (F.col("n") + F.when(m == 41, 1).otherwise(0)).alias("records"), status.alias("history_status"))
    return docs, manifest


def resolved(spark, d):
    """Checked documents, one for each order that has one; written, as statuses and records both read them.

    Bodies and canonical texts end with the checks: only the fields that later steps read are moved and written.
    """
    docs, manifest = documents(spark, d)
    checked = history.document_status(history.parse_documents(docs, history.PUBLISHED), **CONFIG).select(
        "path", "status", "reason", F.struct("doc.entity_id", "doc.provider_id", "doc.history_status", "doc.records").alias("doc"))
    checked = history.against_manifest(checked, manifest)
    return durable(checked.select("status", "reason", "doc", F.regexp_extract("path", r"([0-9]+)\.json$", 1).cast("bigint").alias("entity_id")))


def orders(spark, d):
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderdate").cast("date").alias("release_date"))


STATUS = """rec AS (
  SELECT l_orderkey AS k, l_shipdate AS ts, CASE WHEN l_linenumber = 1 AND l_orderkey % 97 IN (61, 67, 73) THEN 'problem' WHEN l_suppkey % 10 = 0 THEN 'other_shop'
      WHEN l_linenumber = 1 AND l_orderkey % 97 = 71 THEN 'problem' ELSE 'kept' END AS outcome,
    CASE WHEN l_tax = 0 THEN 'ambiguous' WHEN floor(l_discount * 100 + 0.5) > 0 AND l_extendedprice * (1 - l_discount) < l_extendedprice THEN 'discount'
      WHEN floor(l_discount * 100 + 0.5) = 0 AND l_extendedprice * (1 - l_discount) = l_extendedprice THEN 'full_price' ELSE 'ambiguous' END AS kind FROM lineitem),
out AS (SELECT k, count(*) AS records, count(*) FILTER (WHERE outcome = 'kept') AS kept, count(*) FILTER (WHERE outcome = 'other_shop') AS other_shop,
    count(*) FILTER (WHERE outcome = 'problem') AS problems FROM rec GROUP BY 1),
doc AS (SELECT o_orderkey AS entity_id, CAST(o_orderdate AS DATE) AS release_date, coalesce(records, 0) AS records, coalesce(kept, 0) AS kept,
    coalesce(other_shop, 0) AS other_shop, coalesce(problems, 0) AS problems,
    CASE WHEN o_orderkey % 31 = 5 THEN NULL ELSE CASE o_orderkey % 97 WHEN 3 THEN 'invalid_json' WHEN 47 THEN 'missing_entity' WHEN 7 THEN 'request_configuration'
      WHEN 11 THEN 'request_endpoint' WHEN 13 THEN 'lookup_error' WHEN 16 THEN 'lookup_mismatch' WHEN 17 THEN 'lookup_mismatch' WHEN 19 THEN 'history_incomplete' WHEN 23 THEN 'history_http_status'
      WHEN 29 THEN 'request_parameters' WHEN 31 THEN CASE WHEN records > 0 THEN 'body_mismatch' END WHEN 37 THEN CASE WHEN records > 0 THEN 'history_status' END
      WHEN 53 THEN 'manifest_missing' WHEN 43 THEN 'manifest_provider' WHEN 41 THEN 'manifest_record_count' END END AS reason
  FROM orders LEFT JOIN out ON k = o_orderkey),
status AS (SELECT entity_id, release_date, reason, CASE WHEN entity_id % 31 = 5 THEN 'absent' WHEN reason IN ('lookup_error', 'history_incomplete') THEN 'incomplete' WHEN reason IS NOT NULL THEN 'invalid'
    WHEN problems > 0 THEN 'partial' ELSE 'valid' END AS history_status, records, kept, other_shop, problems FROM doc)"""


@query("document_statuses", "S5 S6 S7 P11", "WITH " + STATUS + """
SELECT entity_id, history_status, reason, CASE WHEN ok THEN records END AS records, CASE WHEN ok THEN kept END AS kept,
  CASE WHEN ok THEN other_shop END AS other_shop, CASE WHEN ok THEN problems END AS problems FROM (SELECT *, history_status IN ('valid', 'partial') AS ok FROM status)""")
def document_statuses(spark, d):
    """Every order's history status from its document, with the reason and the outcomes of its records."""
    return history.history_statuses(orders(spark, d), resolved(spark, d), b.SHOP)


EVIDENCE = STATUS + ",\n" + b.WIN + """,
ins AS (SELECT k AS entity_id, window_year, count(*) AS n, count(*) FILTER (WHERE kind = 'discount') AS disc, count(*) FILTER (WHERE kind = 'full_price') AS full_n
  FROM rec JOIN win ON ts >= window_start AND ts < window_end WHERE outcome = 'kept' GROUP BY 1, 2),
ev AS (SELECT s.entity_id, w.window_year, CASE WHEN history_status <> 'valid' THEN 'unknown_history' WHEN release_date = start_date THEN 'uncertain_release_hour'
    ELSE 'eligible_by_release_date' END AS eligibility_status, CASE WHEN history_status IN ('valid', 'partial') THEN coalesce(n, 0) END AS records,
    CASE WHEN history_status = 'valid' THEN CASE WHEN coalesce(n, 0) = 0 THEN 'D' WHEN disc > 0 THEN 'A' WHEN full_n = n THEN 'B' ELSE 'C' END END AS category
  FROM status s CROSS JOIN win w LEFT JOIN ins i ON i.entity_id = s.entity_id AND i.window_year = w.window_year WHERE release_date <= start_date)"""


def document_evidence_of(spark, d):
    checked = resolved(spark, d)
    rows = durable(history.records(checked).drop("raw_json"))  # statuses and evidence read them
    known = history.with_history_status(orders(spark, d), checked, b.SHOP, rows)
    seen = obs_ops.of_shop(history.typed_observations(checked, rows), b.SHOP)
    return evidence.direct_evidence(known, seen, b.CALENDAR).where("eligible")


@query("document_evidence", "S5 S7 A2 P13", "WITH " + EVIDENCE + "\nSELECT * FROM ev")
def document_evidence(spark, d):
    """From documents to evidence: an unread history has no category, a partly read one only counts."""
    return document_evidence_of(spark, d).select("entity_id", "window_year", "eligibility_status", "records", "category")


@query("document_labels", "S7 A2 P15 P16", "WITH " + EVIDENCE + """
SELECT window_year, CASE WHEN category = 'A' THEN 1 WHEN category IN ('B', 'D') THEN 0 END AS discount_observed,
  CASE WHEN category IS NULL THEN 'unknown' WHEN category = 'A' THEN 'positive' ELSE 'unlabeled' END AS pu_status, count(*) AS pairs FROM ev GROUP BY 1, 2, 3""")
def document_labels(spark, d):
    """From documents to labels, counted per window."""
    return labels.label_rows(document_evidence_of(spark, d)).groupBy("window_year", "discount_observed", "pu_status").agg(F.count("*").alias("pairs"))
