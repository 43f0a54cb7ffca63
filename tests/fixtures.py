"""Small literal observations and calendars shared by the tests."""

from datetime import date, datetime, timedelta

from tideline.operators.windows import Calendar, Window, local_window

CAL = Calendar.of([
    local_window(2023, "2023-11-21T10:00:00", "2023-11-28T10:00:00"),
    local_window(2024, "2024-11-27T10:00:00", "2024-12-04T10:00:00"),
    local_window(2025, "2025-09-29T10:00:00", "2025-10-06T10:00:00")])

SCHEMA = (
    "entity_id bigint, record_index bigint, ts timestamp_ntz, shop_id int, shop_name string, deal_status string, "
    "price double, price_amount_int bigint, price_currency string, regular double, regular_amount_int bigint, "
    "regular_currency string, cut double, kind string, issue string")


def row(entity, index, ts, kind="discount", price=5.0, regular=10.0, cut=50.0, currency="USD"):
    if isinstance(ts, str):
        ts = datetime.fromisoformat(ts)
    if kind == "full_price":
        price, cut = regular, 0.0
    if kind == "null":
        return (entity, index, ts, 61, "main", "null", None, None, None, None, None, None, None, "ambiguous", "deal_null")
    issue = "price_regular_cut_disagree" if kind == "ambiguous" else None
    return (entity, index, ts, 61, "main", "object", price, int(price * 100), currency, regular, int(regular * 100),
            currency, cut, kind, issue)


def obs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def entities(spark, rows):
    return spark.createDataFrame([(i, d, "valid") for i, d in rows], "entity_id bigint, release_date date, history_status string")


def one(df, **match):
    found = [r for r in df.collect() if all(r[k] == v for k, v in match.items())]
    assert len(found) == 1, found
    return found[0]
