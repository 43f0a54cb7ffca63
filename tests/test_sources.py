import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F, types as T

from tideline.functions import rules
from tideline.operators import catalog, reconcile
from tideline.operators.windows import verify_calendar_rows
from tideline.sources import calendar, history, tables
from tideline.streaming.intake import run_intake

COLS = ["id", "name", "cut", "count", "note"]
CONFIG = {"country": "US", "shop_id": 61, "since": "2021-01-01T00:00:00Z"}


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_corrected_header_accepts_known_forms(spark, tmp_path):
    body = '1,"a, ""b""\nc",5,2,NA\n2,x,,0,\n'
    for i, head in enumerate(("id,name,cutcount,note", "id,name,cut,count,note")):
        p = write(tmp_path / f"{i}.csv", f"{head}\n{body}")
        rows = tables.read_corrected_csv(spark, p, COLS, 2).orderBy("id").collect()
        assert [tuple(r) for r in rows] == [("1", 'a, "b"\nc', "5", "2", "NA"), ("2", "x", None, "0", None)]
    with pytest.raises(ValueError):
        tables.read_corrected_csv(spark, write(tmp_path / "bad.csv", "id,name,x\n1,2,3\n"), COLS, 2)


@pytest.mark.parametrize("line", ["1,a,5,2", "1,a,5,2,n,extra"])
def test_wrong_width_fails_even_for_few_columns(spark, tmp_path, line):
    p = write(tmp_path / "t.csv", f"id,name,cut,count,note\n{line}\n")
    with pytest.raises(Exception, match="width"):
        tables.read_corrected_csv(spark, p, COLS, 2).select("id").collect()


def test_field_counts(spark, tmp_path):
    p = write(tmp_path / "t.csv", 'id,name,cut,count,note\n1,a,5,2,n\n1,"x,y",5,2,\n1,a,5\n1,"a,b",5,2,n,z\n')
    assert {r["fields"]: r["records"] for r in tables.field_counts(spark, p, COLS).collect()} == {5: 2, 3: 1, 6: 1}
    assert {r["fields"] for r in tables.bad_record_sample(spark, p, COLS).collect()} == {3, 6}


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    import csv
    import random

    r = random.Random(1)
    cells = ["", "plain", 'says "yes"', '"', '""', "a,b", "two\nlines", 'three\n\n"li,nes"\n', "crlf\r\nin it", " spaces ", "é日", "x" * 700, "\n" * 40]
    rows = [[str(i), r.choice(cells), r.choice(cells), str(r.randint(0, 9)), r.choice(cells)] for i in range(400)]
    for k in (0, 1):
        with open(tmp_path / f"{k}.csv", "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if k else "\n")
            out.writerow(COLS)
            out.writerows(rows[k * 150:(k + 1) * 150 + 100 * k])
    path = str(tmp_path)
    lines = spark.read.option("lineSep", "\n").text(path + "/0.csv")
    assert lines.rdd.getNumPartitions() > 10
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLS])
    got = tables.read_strict_csv(spark, path, schema)
    want = tables._csv(spark).schema(schema).csv(path)
    key = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    assert key(got) == key(tables.read_corrected_csv(spark, path, COLS, 2)) == sorted((tuple(c or None for c in row) for row in rows), key=str)
    # The one-task reader writes CRLF inside quotes as LF if the file's lines end in CRLF; these bytes stay as they are.
    plain = lambda cell: cell and cell.replace("\r\n", "\n")
    assert sorted((tuple(map(plain, x)) for x in key(got)), key=str) == sorted((tuple(map(plain, x)) for x in key(want)), key=str)


def test_every_file_needs_the_header(spark, tmp_path):
    write(tmp_path / "a.csv", "id,v\n1,2\n")
    write(tmp_path / "b.csv", "v,id\n1,2\n")
    with pytest.raises(Exception, match="header"):
        tables.read_strict_csv(spark, str(tmp_path), T.StructType.fromDDL("id bigint, v double")).collect()


def test_catalog_schema_constants():
    assert len(tables.CATALOG_COLUMNS) == 40 == len(set(tables.CATALOG_COLUMNS))
    assert set(tables.CATALOG_DROPPED) < set(tables.CATALOG_COLUMNS) and len(tables.CATALOG_DROPPED) == 11
    assert tables.CATALOG_COLUMNS[tables.CATALOG_MERGED] == "Discount"


def test_strict_csv(spark, tmp_path):
    schema = T.StructType.fromDDL("id bigint, v double")
    assert tables.read_strict_csv(spark, write(tmp_path / "a.csv", "id,v\n1,2.5\n"), schema, ["id"]).collect()[0]["v"] == 2.5
    for name, text in {"b": "id,id\n1,2\n", "c": "id,\n1,2\n", "d": "v,id\n1,2\n"}.items():
        with pytest.raises(ValueError):
            tables.read_strict_csv(spark, write(tmp_path / f"{name}.csv", text), schema)
    for name, text in {"e": "id,v\n1\n", "f": "id,v\n1,x\n"}.items():
        with pytest.raises(Exception):
            tables.read_strict_csv(spark, write(tmp_path / f"{name}.csv", text), schema).collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_sink_never_overwrites_and_round_trips(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, None, 1.5), (2, "x", None), (2, "x", None)], "id bigint, s string, v double")
    out = str(tmp_path / "t")
    tables.write_table(df, out, ["id", "s", "v"], fmt)
    assert tables.round_trip_differences(df, out, fmt).first()["identical"]
    with pytest.raises(Exception):
        tables.write_table(df, out, ["id", "s", "v"], fmt)
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "u"), ["id", "v"], fmt)


def document(entity, records, **change):
    doc = {"entity_id": entity, "provider_id": "p", "request": {"country": "US", "shop_id": 61, "since": CONFIG["since"]},
           "lookup": {"found": True, "id": "p", "status": "matched"},
           "evidence": {"http_status": 200, "received_at": "2026-10-13T15:36:29Z", "body": json.dumps(records), "server_date": "Tue, 13 Oct 2026 15:36:29 GMT"},
           "history_status": "history_received" if records else "empty_history", "history": records}
    doc.update(change)
    return json.dumps(doc)


def record(ts="2023-11-22T00:00:00Z", price=5.0, regular=10.0, cut=50, **over):
    money = lambda a: {"amount": a, "amountInt": int(a * 100), "currency": "USD"}
    out = {"timestamp": ts, "shop": {"id": 61, "name": "main"}, "deal": {"price": money(price), "regular": money(regular), "cut": cut}}
    out.update(over)
    return out


def statuses(spark, d):
    docs = history.document_status(history.parse_documents(history.read_documents(spark, d)), **CONFIG)
    return {r["path"].rsplit("/", 1)[1]: (r["status"], r["reason"]) for r in docs.select("path", "status", "reason").collect()}


def published(entity, records, **change):
    """A document in the published layout; ``a__b`` replaces or (None) removes the field b of the part a."""
    params = {"id": "p", "country": "US", "shops": "61", "since": CONFIG["since"]}
    doc = {"steam_appid": entity, "itad_game_id": "p",
           "request_configuration": {"country": "US", "steam_shop_id": 61, "requested_since": CONFIG["since"], **history.PUBLISHED_ENDPOINTS},
           "lookup_response": {"found": True, "game": {"id": "p", "title": "x"}}, "history_response": records,
           "history_evidence": {"http_status": 200, "params": params, "body": json.dumps(records)},
           "collection_metadata": {"lookup_status": "matched", "history_status": "history_received" if records else "empty_history"}}
    for path, value in change.items():
        part, _, field = path.partition("__")
        if field:
            doc[part][field] = value
        elif value is None:
            del doc[part]
        else:
            doc[part] = value
    return json.dumps(doc)


BROKEN = {
    "missing_entity": {"steam_appid": "1"}, "request_configuration": {"request_configuration__country": "DE"},
    "request_endpoint": {"request_configuration__history_endpoint": "/games/history/v1"}, "lookup_error": {"collection_metadata__lookup_status": "lookup_error"},
    "lookup_mismatch": {"lookup_response__game": {"id": "q"}}, "history_incomplete": {"collection_metadata__history_status": "request_failed"},
    "history_http_status": {"history_evidence__http_status": 304}, "request_parameters": {"history_evidence__params": {"id": "p"}},
    "body_mismatch": {"history_evidence__body": "[]"}, "history_status": {"collection_metadata__history_status": "empty_history"}}


def test_published_layout_and_each_broken_field(spark, tmp_path):
    odd = [record(), 5, record(shop={"id": "61"}), record(ts="2023-11-22T00:00:00"), record(shop={"id": 35, "name": "o"})]
    texts = {"valid": published(1, [record()]), "empty": published(2, []), "partial": published(3, odd), "invalid_json": "{", "counted": published(4, [record()]),
             "unlisted": published(5, []), "provider": published(6, []), "listed": published(7, []),
             **{n: published(100 + i, [record()], **c) for i, (n, c) in enumerate(BROKEN.items())},
             "no_found": published(8, [], lookup_response__found="true"), "no_part": published(9, [], history_evidence=None), "no_array": published(10, {"a": 1})}
    for name, text in texts.items():
        write(tmp_path / f"{name}.json", text)
    docs = history.parse_documents(history.read_documents(spark, str(tmp_path)), history.PUBLISHED)
    checked = history.document_status(docs, **CONFIG, **history.PUBLISHED_ENDPOINTS, check_parameters=True)
    manifest = spark.createDataFrame(
        [(1, "p", 1, "history_received"), (2, "p", 0, "empty_history"), (3, "p", 5, "history_received"), (4, "p", 2, "history_received"),
         (6, "z", 0, "empty_history"), (7, "p", 0, "history_received"), (999, "p", 0, "empty_history")],
        "entity_id bigint, provider_id string, records bigint, history_status string")
    checked = history.against_manifest(checked, manifest)
    got = {r["path"].rsplit("/", 1)[1][:-5]: r["reason"] for r in checked.collect()}
    assert got == {**{n: n for n in BROKEN}, "valid": None, "empty": None, "partial": None, "invalid_json": "invalid_json", "counted": "manifest_record_count",
                   "unlisted": "manifest_missing", "provider": "manifest_provider", "listed": "manifest_status", "no_found": "lookup_mismatch",
                   "no_part": "history_http_status", "no_array": "body_mismatch"}
    ents = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 55)] + [(100 + list(BROKEN).index("lookup_error"),)], "entity_id bigint")
    resolved = checked.where("doc.entity_id is not null").withColumn("entity_id", F.col("doc.entity_id"))
    rows = {r["entity_id"]: tuple(r)[1:] for r in history.history_statuses(ents, resolved, 61).collect()}
    assert rows == {1: ("valid", None, 1, 1, 0, 0), 2: ("valid", None, 0, 0, 0, 0), 3: ("partial", None, 5, 1, 1, 3), 55: ("absent", None, None, None, None, None),
                    4: ("invalid", "manifest_record_count", None, None, None, None), 103: ("incomplete", "lookup_error", None, None, None, None)}
    assert {r["entity_id"]: r["history_status"] for r in history.with_history_status(ents, resolved, 61).collect()}[3] == "partial"


def test_evidence_requires_a_history_status(spark):
    from tideline.operators import evidence
    from fixtures import CAL, obs

    ents = spark.createDataFrame([(1, date(2020, 1, 1))], "entity_id bigint, release_date date")
    for make in (evidence.direct_evidence, evidence.pair_context):
        with pytest.raises(ValueError, match="history_status"):
            make(ents, obs(spark, []), CAL)


def test_streaming_reads_the_published_layout(spark, tmp_path):
    src = tmp_path / "in"; src.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    write(src / "1.json", published(1, [record()]))
    write(src / "2.json", published(2, [record()], history_evidence__params={}))
    run_intake(spark, str(src), out, ck, **CONFIG, fields=history.PUBLISHED, check_parameters=True, **history.PUBLISHED_ENDPOINTS)
    assert [r["entity_id"] for r in spark.read.parquet(out).collect()] == [1]


def test_document_provenance(spark, tmp_path):
    bad = {"request": {"country": "DE", "shop_id": 61, "since": CONFIG["since"]}}
    texts = {
        "ok": document(1, [record()]), "empty": document(2, []), "dup": '{"entity_id": 1, "entity_id": 2}', "nan": '{"entity_id": NaN}',
        "config": document(3, [record()], **bad), "failed": document(4, [record()], history_status="request_failed"),
        "lookup": document(5, [], lookup={"found": False, "id": None, "status": "lookup_error"}),
        "body": document(6, [record()], evidence={"http_status": 200, "body": "[]"}), "status": document(7, [record()], history_status="empty_history")}
    for name, text in texts.items():
        write(tmp_path / f"{name}.json", text)
    got = statuses(spark, str(tmp_path))
    assert got == {"ok.json": ("valid", None), "empty.json": ("valid", None), "dup.json": ("invalid", "invalid_json"), "nan.json": ("invalid", "invalid_json"),
                   "config.json": ("invalid", "request_configuration"), "failed.json": ("incomplete", "history_incomplete"),
                   "lookup.json": ("incomplete", "lookup_error"), "body.json": ("invalid", "body_mismatch"), "status.json": ("invalid", "history_status")}


def test_first_layer_wins_even_when_bad(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    write(a / "1.json", '{"entity_id": 1, "entity_id": 1}')
    write(b / "1.json", document(1, [record()]))
    write(b / "2.json", document(2, [record()]))
    layer = lambda p: history.document_status(history.parse_documents(history.read_documents(spark, str(p))), **CONFIG)
    ents = spark.createDataFrame([(1,), (2,), (3,)], "entity_id bigint")
    got = {r["entity_id"]: (r["status"], r["layer"]) for r in history.resolve(ents, [layer(a), layer(b)]).collect()}
    assert got == {1: ("invalid", 0), 2: ("valid", 1), 3: ("absent", None)}


def test_records_keep_index_and_deal_status(spark, tmp_path):
    no_deal = record(); del no_deal["deal"]
    rows = [record(), record(deal=None), no_deal, record(deal={}), record(deal="x"), record(ts="2023-11-22T00:00:00"), record(ts="2023-11-22T01:00:00+01:00")]
    write(tmp_path / "a.json", document(1, rows))
    got = history.observations(spark, str(tmp_path), **CONFIG).orderBy("record_index").collect()
    assert [r["deal_status"] for r in got] == ["object", "null", "missing", "object", "invalid", "object", "object"]
    assert [r["kind"] for r in got] == ["discount", "ambiguous", "ambiguous", "ambiguous", "ambiguous", "discount", "discount"]
    assert got[5]["ts"] is None and got[6]["ts"] == datetime(2023, 11, 22)


def test_parse_outcomes(spark, tmp_path):
    rows = [record(), record(shop={"id": 35, "name": "o"}), record(shop={"id": "61"}), record(shop=None), record(ts="2023-11-22T00:00:00"),
            record(ts="2023-11-22T00:00:00", shop={"id": 35, "name": "o"}), 5, "x"]
    write(tmp_path / "a.json", document(1, rows))
    docs = history.document_status(history.parse_documents(history.read_documents(spark, str(tmp_path))), **CONFIG)
    got = {r["outcome"]: r["records"] for r in history.parse_outcomes(history.records(docs), 61).collect()}
    assert got == {"kept": 1, "other_shop": 2, "invalid_shop_id": 2, "invalid_timestamp": 1, "record_not_object": 2}


def test_streaming_intake_resumes_without_repeats(spark, tmp_path):
    src = tmp_path / "in"; src.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    write(src / "1.json", document(1, [record(), record("2024-01-01T00:00:00Z")]))
    run_intake(spark, str(src), out, ck, **CONFIG)
    assert spark.read.parquet(out).count() == 2
    run_intake(spark, str(src), out, ck, **CONFIG)
    assert spark.read.parquet(out).count() == 2
    write(src / "2.json", document(2, [record()]))
    write(src / "3.json", '{"entity_id": 1, "entity_id": 2}')
    run_intake(spark, str(src), out, ck, **CONFIG, max_files_per_trigger=1)
    got = spark.read.parquet(out)
    assert got.count() == 3 and got.select("entity_id").distinct().count() == 2


def calendar_json(path, **change):
    event = {"sale_year": 2023, "sale_start_pacific": "2023-11-21T10:00:00-08:00", "sale_end_pacific": "2023-11-28T10:00:00-08:00",
             "sale_start_utc": "2023-11-21T18:00:00Z", "sale_end_utc": "2023-11-28T18:00:00Z", "verification_status": "verified", "source_url": "https://example.org"}
    event.update(change)
    return write(path, json.dumps({"timezone": "America/Los_Angeles", "events": [event]}, indent=1))


def test_calendar_checks(spark, tmp_path):
    cal = calendar.load_calendar(spark, calendar_json(tmp_path / "a.json"))
    assert cal.window(2023).start == datetime(2023, 11, 21, 18) and cal.window(2023).end_date == date(2023, 11, 28)
    for i, bad in enumerate(({"sale_start_pacific": "2023-11-21T10:00:00-07:00", "sale_start_utc": "2023-11-21T17:00:00Z"}, {"sale_end_utc": "2023-11-28T17:00:00Z"},
                             {"sale_year": 2024}, {"verification_status": "draft"}, {"source_url": None})):
        with pytest.raises(ValueError):
            calendar.load_calendar(spark, calendar_json(tmp_path / f"b{i}.json", **bad))


def test_journal_lines(spark, tmp_path):
    p = write(tmp_path / "j.jsonl", '{"kind":"attempt","sequence":1,"appid":"7","endpoint":"history","round":0}\n{"kind":"result","sequence":1,"http_status":200}\n')
    assert history.read_journal(spark, p).count() == 2
    with pytest.raises(Exception):
        history.read_journal(spark, write(tmp_path / "k.jsonl", '{"kind":\n')).collect()


def test_id_and_date_rules(spark):
    ids = ["", "0", "-1", "1.0", "01", " 1", "abc", "4294967296", "１", "1", "4294967295", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(rules.valid_id(F.col("v"))).collect()] == [False] * 9 + [True, True, False]
    days = spark.createDataFrame([("2021-02-29",), ("2020-1-01",), ("2020-01-01",), ("",)], "v string")
    assert [r[0] for r in days.select(rules.strict_date(F.col("v"))).collect()] == [None, None, date(2020, 1, 1), None]


def test_strict_numeric_and_distinct_quartiles_fail_loudly(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    with pytest.raises(Exception, match="not numeric"):
        catalog.strict_numeric(df, ["v"]).collect()
    same = spark.createDataFrame([(1.0,)] * 5, "v double")
    with pytest.raises(Exception, match="not distinct"):
        catalog.quartile_bands(same, "v").collect()
    with pytest.raises(Exception, match="outside"):
        catalog.histogram(same, "v", [2.0, 3.0]).collect()


def test_checked_join_rejects_repeated_right_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, l string")
    ok = spark.createDataFrame([(1, "x")], "k int, r string")
    assert reconcile.checked_join(left, ok, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeats"):
        reconcile.checked_join(left, ok.union(ok), ["k"]).collect()


def test_fingerprint_ignores_order_and_sees_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    f = lambda d: reconcile.fingerprint(d).first()["fingerprint"]
    assert f(a) == f(a.orderBy(F.desc("i")).repartition(3)) and f(a) != f(a.fillna("")) and f(a) != f(a.union(a.limit(1)))


def test_verify_rows_reports_each_problem(spark):
    df = spark.createDataFrame([(2023, "America/Los_Angeles", "2023-11-28T10:00:00-08:00", "2023-11-21T10:00:00-08:00", "2023-11-28T18:00:00Z", "2023-11-21T18:00:00Z")],
                               "window_year int, zone string, start_local string, end_local string, start_utc string, end_utc string")
    assert verify_calendar_rows(df).first()["problems"] == ["order"]


def test_records_are_parsed_once_for_statuses_and_observations(spark):
    from tideline.operators import observations as obs_ops
    from tideline.session import durable

    deals = {"missing": "", "null": ', "deal": null', "object": ', "deal": {"cut": 5}', "invalid": ', "deal": [1]'}
    texts = [f'{{"timestamp": "2020-01-01T00:00:0{i}Z", "shop": {{"id": 61}}{deal}}}' for i, deal in enumerate(deals.values())]
    docs = spark.createDataFrame([(1, "valid", None, (1, [*texts, "[1]", "5", ' {"shop": null}']))],
                                 "entity_id long, status string, reason string, doc struct<entity_id:long,records:array<string>>")
    rows = durable(history.records(docs).drop("raw_json"))
    got = {r["record_index"]: r for r in rows.collect()}
    assert [got[i]["deal_status"] for i in range(4)] == list(deals) and [got[i]["record_ok"] for i in range(7)] == [True] * 4 + [False, False, True]
    assert got[3]["ts"].second == 3 and got[6]["ts"] is None
    seen = obs_ops.of_shop(history.typed_observations(docs, rows), 61)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert seen.count() == 4 and "json" not in plan.lower().replace("relation", "")
    status = history.history_statuses(docs.select("entity_id"), docs, 61, rows).collect()
    assert [tuple(r) for r in status] == [tuple(r) for r in history.history_statuses(docs.select("entity_id"), docs, 61).collect()]
    assert tuple(status[0])[1:] == ("partial", None, 7, 4, 0, 3)


def test_document_checks_move_no_bodies(spark):
    from tideline.plans import documents

    fields = documents.resolved(spark, "/root/testdata/sf0.001").schema["doc"].dataType.names
    assert "records" in fields and not {"body", "history", "params"} & set(fields)


def test_a_body_is_the_stored_array_if_their_canonical_json_is_equal(spark):
    pair = '[{"a":1,"b":"x \\"y\\" [ ]"},{"c":[0.5,null]}]'
    cases = [  # stored text, body, equal; the document's other text holds copies of the body
        (pair, pair, True), ("[]", "[]", True), (json.dumps(json.loads(pair), indent=2), pair, True), (pair, f" {pair}\n", True),
        ('[{"b":2,"a":1}]', '[{"a":1,"b":2}]', True), ('[{"a":1.50}]', '[{"a":1.5}]', True), ('["\\u0041"]', '["A"]', True), (pair, "[]", False),
        ("[5]", '["5"]', False), ('["[]"]', "[]", False), ("[[],[]]", "[]", False), ("[0.10000000000000000001]", "[0.1]", False), ('["a b"]', '["ab"]', False),
        ("[1e2]", "[100.0]", False), ("{}", "[]", False), ('"[]"', "[]", False), ("null", "null", False), ("[1]", '"[1]"', False), ("[1]", "[1", False),
        ("[1]", "", False), ("[NaN]", "[NaN]", False), ('[{"a":1,"a":1}]', '[{"a":1,"a":1}]', False)]
    rows = [(str(i), f'{{"evidence":{{"body":{json.dumps(body)}, "copy":{{"history":[2]}}}},"z [1][]":0,"history":{stored}, "other":[{stored}]}}', equal)
            for i, (stored, body, equal) in enumerate(cases)]
    # The body is in the text, but across strings; without it, an inner object would seem to be the outer one.
    body = '[", ",":{",":"]'
    rows.append(("across", f'{{"evidence":{{"body":{json.dumps(body)}}},"s":"{body}","history":{{}}}},"history":[5]}}', False))
    parsed = history.parse_documents(spark.createDataFrame(rows, "path string, text string, equal boolean").select("path", "text"))
    assert parsed.where("not json_ok").count() == 2  # NaN and a repeated key
    assert {r["path"]: r["same_body"] for r in parsed.collect()} == {p: equal for p, _, equal in rows}
    # Canonical JSON is written for nothing but arrays that are not stored as the body has them.
    assert "history" not in parsed.schema["doc"].dataType.names
