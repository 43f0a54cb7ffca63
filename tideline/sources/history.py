"""History documents: strict JSON, wrapper provenance, records with their array position."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MONEY = "struct<amount:double,amountInt:bigint,currency:string>"
RECORD = f"timestamp string, shop struct<name:string>, deal struct<price:{MONEY},regular:{MONEY},cut:double>"

# Where the published documents keep each field, and the endpoints they must name.
PUBLISHED = {
    "entity_id": "$.steam_appid",
    "provider_id": "$.itad_game_id",
    "country": "$.request_configuration.country",
    "shop_id": "$.request_configuration.steam_shop_id",
    "since": "$.request_configuration.requested_since",
    "history_endpoint": "$.request_configuration.history_endpoint",
    "lookup_endpoint": "$.request_configuration.lookup_endpoint",
    "found": "$.lookup_response.found",
    "lookup_id": "$.lookup_response.game.id",
    "lookup_status": "$.collection_metadata.lookup_status",
    "history_status": "$.collection_metadata.history_status",
    "http_status": "$.history_evidence.http_status",
    "params": "$.history_evidence.params",
    "body": "$.history_evidence.body",
    "history": "$.history_response",
}
PUBLISHED_ENDPOINTS = {"history_endpoint": "/games/history/v2", "lookup_endpoint": "/games/lookup/v1"}

# A plainer layout without endpoints and parameters.
COMPACT = {
    "entity_id": "$.entity_id",
    "provider_id": "$.provider_id",
    "country": "$.request.country",
    "shop_id": "$.request.shop_id",
    "since": "$.request.since",
    "found": "$.lookup.found",
    "lookup_id": "$.lookup.id",
    "lookup_status": "$.lookup.status",
    "history_status": "$.history_status",
    "http_status": "$.evidence.http_status",
    "body": "$.evidence.body",
    "history": "$.history",
}
KINDS = {"entity_id": "BIGINT", "shop_id": "BIGINT", "http_status": "BIGINT", "found": "BOOLEAN", "params": "OBJECT"}
CONTAINERS = {"OBJECT": "{"}
BLANKS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|[ \t\r\n]++'  # a string, or white space between tokens


def read_documents(spark: SparkSession, path: str, *, one_per_line: bool = False) -> DataFrame:
    """``path, text``: one row per document. Line-delimited input stays splittable."""
    if one_per_line:
        return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def strict_json(text: Column) -> Column:
    """Null for repeated keys, NaN, Infinity or malformed text."""
    return F.try_parse_json(text)


def _field(whole: Column, name: str, path: str) -> Column:
    """A field of a document if it has the kind of value it must have; containers as canonical JSON, keys in order."""
    kind = KINDS.get(name, "STRING")
    value = F.try_variant_get(whole, path, "variant")
    if kind in CONTAINERS:  # the text tells the kind; the schema of a long container costs a walk through all of it
        text = F.to_json(value)
        return F.when(text.startswith(CONTAINERS[kind]), text).alias(name)
    return F.when(F.schema_of_variant(value).startswith(kind), F.try_variant_get(whole, path, kind)).alias(name)


def _raw_records(path: str) -> Column:
    """The elements of the array at ``path``, each as the text it has in the document."""
    keys = path.removeprefix("$.").split(".")
    schema = "array<string>"
    for key in reversed(keys):
        schema = f"struct<`{key}`:{schema}>"
    found = F.from_json("text", schema)
    for key in keys:
        found = found[key]
    return found


def _compact(text: Column) -> Column:
    """JSON without white space between its tokens."""
    return F.regexp_replace(text, BLANKS, "$1")


def _marked(text: Column) -> tuple[Column, Column]:
    """An array of the value of ``text``, and whether that value takes the whole text: the parser stops at its end, but then finds a mark."""
    mark = F.xxhash64(text)
    both = strict_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    return both, F.try_variant_get(both, "$[1]", "bigint") == mark


def _stores(text: Column, path: str, array: Column) -> Column:
    """Whether the array at ``path`` of a valid document is written there as the text ``array``.

    With every copy of that text replaced by an empty object the path must lead to one: copies elsewhere, in strings too, leave the array there.
    """
    _, complete = _marked(array)
    left, closed = _marked(F.replace(text, array, F.lit("{}")))
    return array.startswith("[") & complete & closed & (F.schema_of_variant(F.try_variant_get(left, "$[0]" + path[1:], "variant")) == "OBJECT<>")


def _same_body(text: Column, whole: Column, path: str, body: Column, records: Column) -> Column:
    """Whether the saved body and the array at ``path`` have the same canonical JSON, keys in order.

    Writing that takes Spark far longer than reading does, so it is done only where the array is not written as in the body, white space aside.
    """
    alike = lambda t, b: F.when(records.isNotNull() & _stores(t, path, b), True)
    stored = F.to_json(F.try_variant_get(whole, path, "variant"))
    return F.coalesce(alike(text, body), alike(_compact(text), _compact(body)), stored.startswith("[") & (F.to_json(strict_json(body)) == stored), F.lit(False))


def parse_documents(docs: DataFrame, fields: Mapping[str, str] = COMPACT) -> DataFrame:
    """Add ``json_ok`` and ``doc``, the fields found at the paths of ``fields``; a value of the wrong kind is null.

    Records stay raw JSON in ``doc.records``, so one odd record spoils no other. ``same_body`` tells whether the saved body is
    the stored array, compared in canonical JSON.
    """
    whole, history = F.col("_whole"), fields["history"]
    found = [_field(whole, name, path) for name, path in fields.items() if name != "history"]
    absent = [F.lit(None).cast("string").alias(n) for n in PUBLISHED if n not in fields]
    parsed = docs.withColumn("_whole", strict_json(F.col("text"))).select(
        "path", "text", whole.isNotNull().alias("json_ok"), F.struct(*found, *absent, _raw_records(history).alias("records")).alias("doc"), "_whole")
    same = _same_body(F.col("text"), whole, history, F.col("doc.body"), F.col("doc.records"))
    return parsed.withColumn("same_body", same).drop("_whole")


def request_parameters(country: Column, shop_id: Column, since: Column, provider_id: Column) -> Column:
    """Canonical JSON of the parameters that a history request must have carried."""
    return F.to_json(F.struct(  # keys in order
        country.alias("country"), provider_id.alias("id"), shop_id.cast("string").alias("shops"), since.alias("since")))


def document_status(docs: DataFrame, country: str, shop_id: int, since: str, *, history_endpoint: str | None = None,
                    lookup_endpoint: str | None = None, check_parameters: bool = False) -> DataFrame:
    """Provenance verdict per document: ``valid``, ``incomplete`` or ``invalid`` with the first reason that holds.

    The saved response body must parse to the same records as the stored array. Endpoints are compared if given, request parameters
    if asked for.
    """
    d = lambda f: F.col(f"doc.{f}")
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    expected = F.when(F.size(d("records")) > 0, "history_received").otherwise("empty_history")
    endpoints = [d(n) == v for n, v in (("history_endpoint", history_endpoint), ("lookup_endpoint", lookup_endpoint)) if v is not None]
    wanted = request_parameters(d("country"), d("shop_id"), d("since"), d("provider_id"))
    checks = [
        ("invalid_json", ~F.col("json_ok")),
        ("missing_entity", d("entity_id").isNull()),
        ("request_configuration", no((d("country") == country) & (d("shop_id") == shop_id) & (d("since") == since))),
        *[("request_endpoint", no(same)) for same in endpoints],
        ("lookup_error", F.coalesce(d("lookup_status") == "lookup_error", F.lit(False))),
        ("lookup_mismatch", no(d("lookup_status") == "matched") | no(d("found")) | no(d("lookup_id") == d("provider_id"))),
        ("history_incomplete", no(d("history_status").isin("history_received", "empty_history"))),
        ("history_http_status", no(d("http_status") == 200)),
        *([("request_parameters", no(d("params") == wanted))] if check_parameters else []),
        ("body_mismatch", no(d("records").isNotNull() & F.col("same_body"))),
        ("history_status", no(d("history_status") == expected)),
    ]
    reason = F.coalesce(*[F.when(fails, name) for name, fails in checks])
    status = F.when(reason.isNull(), "valid").when(reason.isin("lookup_error", "history_incomplete"), "incomplete").otherwise("invalid")
    return docs.withColumn("reason", reason).withColumn("status", status)


def against_manifest(checked: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose collection manifest (``entity_id, provider_id, records, history_status``) says otherwise become invalid.

    Only documents that are valid so far are compared; the reason names the first field that differs.
    """
    m = manifest.select(F.col("entity_id").alias("_m_entity"), F.struct("provider_id", "records", "history_status").alias("_m"))
    doc = F.col("doc")
    checks = [("manifest_missing", F.col("_m").isNull()), ("manifest_provider", ~F.col("_m.provider_id").eqNullSafe(doc["provider_id"])),
              ("manifest_record_count", ~F.col("_m.records").eqNullSafe(F.size(doc["records"]).cast("bigint"))),
              ("manifest_status", ~F.col("_m.history_status").eqNullSafe(doc["history_status"]))]
    differs = F.when(F.col("status") == "valid", F.coalesce(*[F.when(fails, name) for name, fails in checks]))
    rows = checked.join(m, F.col("doc.entity_id") == F.col("_m_entity"), "left").withColumn("_differs", differs)
    return rows.withColumn("reason", F.coalesce("reason", "_differs")).withColumn(
        "status", F.when(F.col("_differs").isNull(), F.col("status")).otherwise("invalid")).drop("_m", "_m_entity", "_differs")


def resolve(entities: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """Document per entity from the first layer that holds its id, even when that copy is bad.

    Layers are checked document tables in order of precedence. The id comes from the file name,
    so a document that does not parse still hides later layers. No copy anywhere: ``absent``.
    """
    from tideline.operators.reconcile import resolve_layers

    name = F.regexp_extract("path", r"([0-9]+)\.json$", 1).try_cast("bigint")
    chosen = resolve_layers([x.withColumn("entity_id", name).where(F.col("entity_id").isNotNull()) for x in layers], "entity_id")
    return entities.select("entity_id").join(chosen, "entity_id", "left").withColumn("status", F.coalesce("status", F.lit("absent")))


def records(docs: DataFrame) -> DataFrame:
    """One row per record of valid documents with its array index, ready for typing; ``ts`` is the UTC time of ``timestamp``.

    ``deal_status`` keeps a missing deal apart from an explicit null and from a non-object; a shop id must be an integer.
    Every reader parses the records anew, and a filter on them more than once: write the rows that several steps read.
    """
    from tideline.functions import rules

    rows = docs.where(F.col("status") == "valid").select(
        F.col("doc.entity_id").alias("entity_id"), F.posexplode("doc.records").alias("i", "raw_json"))
    rows = rows.select("entity_id", F.col("i").cast("bigint").alias("record_index"), "raw_json",
                       F.try_parse_json("raw_json").alias("v"), F.from_json("raw_json", RECORD).alias("r"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    rows = rows.select("*", kind("$.deal").alias("deal_kind"), kind("$.shop.id").alias("id_kind"))
    deal = F.col("deal_kind")
    status = F.when(deal.isNull(), "missing").when(deal == "VOID", "null").when(deal.startswith("OBJECT<"), "object").otherwise("invalid")
    shop = F.when(F.col("id_kind") == "BIGINT", F.try_variant_get("v", "$.shop.id", "int"))
    return rows.select("entity_id", "record_index", F.coalesce(F.col("v").isNotNull() & F.col("raw_json").rlike(r"^\s*\{"), F.lit(False)).alias("record_ok"),
                       F.col("r.timestamp").alias("timestamp"), rules.utc_instant(F.col("r.timestamp")).alias("ts"),
                       F.struct(shop.alias("id"), F.col("r.shop.name").alias("name")).alias("shop"),
                       F.col("r.deal").alias("deal"), status.alias("deal_status"), "raw_json")


def record_outcome(shop_id: int) -> Column:
    """Outcome of a row of ``records``: kept, other_shop, or why it cannot be used (times matter for the own shop only)."""
    from tideline.operators.observations import record_problem

    shop = F.col("shop.id")
    problem = record_problem(F.col("record_ok"), shop, F.when(shop == shop_id, F.col("ts"))
                             .otherwise(F.lit("1970-01-01").cast("timestamp_ntz")))
    return F.when(problem.isNotNull(), problem).when(shop != shop_id, "other_shop").otherwise("kept")


def parse_outcomes(rows: DataFrame, shop_id: int) -> DataFrame:
    """Records of valid documents per outcome: kept, other shop, or why they cannot be used."""
    return rows.groupBy(record_outcome(shop_id).alias("outcome")).agg(F.count("*").alias("records"))


def history_statuses(entities: DataFrame, resolved: DataFrame, shop_id: int, rows: DataFrame | None = None) -> DataFrame:
    """Per entity: ``history_status`` and its reason, with the outcomes of its records.

    ``resolved`` holds at most one checked document per entity (see ``resolve``), as ``entity_id, status, reason, doc``. A valid document with a
    record that cannot be used is ``partial``; no document is ``absent``; otherwise the document's own status stands.
    Outcomes are counted per document before the shuffle and joined back to the entities. ``rows`` are the ``records`` of
    ``resolved`` if the caller has them written.
    """
    outcomes = (records(resolved) if rows is None else rows).withColumn("_o", record_outcome(shop_id)).groupBy("entity_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("_o") == "kept").alias("kept"), F.count_if(F.col("_o") == "other_shop").alias("other_shop"),
        F.count_if(~F.col("_o").isin("kept", "other_shop")).alias("problems"))
    of = resolved.select("entity_id", "status", "reason")
    joined = entities.select("entity_id").join(of, "entity_id", "left").join(outcomes, "entity_id", "left")
    valid = F.col("status") == "valid"
    count = lambda c: F.when(valid, F.coalesce(c, F.lit(0))).alias(c)
    return joined.select(
        "entity_id", F.when(valid & (F.coalesce("problems", F.lit(0)) > 0), "partial").otherwise(F.coalesce("status", F.lit("absent"))).alias("history_status"),
        "reason", count("records"), count("kept"), count("other_shop"), count("problems"))


def with_history_status(entities: DataFrame, resolved: DataFrame, shop_id: int, rows: DataFrame | None = None) -> DataFrame:
    """Entities with the column ``history_status`` that evidence and labels ask for, derived from their documents."""
    return entities.drop("history_status").join(history_statuses(entities, resolved, shop_id, rows).select("entity_id", "history_status"), "entity_id")


def typed_observations(checked: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Typed observations of every shop from the valid documents; ``rows`` as in ``history_statuses``."""
    from tideline.operators.observations import type_records

    return type_records(records(checked) if rows is None else rows, ts=F.col("ts"), deal_status=F.col("deal_status"))


def observations(spark: SparkSession, path: str, *, country: str, shop_id: int, since: str, one_per_line: bool = False,
                 fields: Mapping[str, str] = COMPACT, **checks) -> DataFrame:
    """Documents on disk to typed observations of every shop."""
    docs = parse_documents(read_documents(spark, path, one_per_line=one_per_line), fields)
    return typed_observations(document_status(docs, country, shop_id, since, **checks))


JOURNAL_SCHEMA = (
    "kind string, sequence bigint, appid string, endpoint string, round int, started_epoch double, "
    "http_status int, not_before_epoch double, schema_version int")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines with the superset schema; a malformed line fails the job."""
    return spark.read.schema(JOURNAL_SCHEMA).option("mode", "FAILFAST").json(path)
