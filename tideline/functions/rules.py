"""Column rules: identifiers, dates, tokens, observation typing, bands.

Everything here is a built-in expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Names that results are compared by.
KINDS = ("discount", "full_price", "ambiguous")
CATEGORIES = ("A", "B", "C", "D")
STATES = ("full_price", "discount", "ambiguous", "missing")
COVERAGE_GROUPS = ("0", "1-9", "10-29", "30+")
MAX_ID = 4294967295
ID_PATTERN = "^[1-9][0-9]*$"
CURRENCY_PATTERN = "^[A-Z]{3}$"


# ---------------------------------------------------------------- identifiers, text, dates
def valid_id(value: Column) -> Column:
    """Positive integer text up to 2^32-1: no sign, blanks, leading zero or wide digits."""
    return F.coalesce(
        value.rlike(ID_PATTERN) & (F.length(value) <= 10)
        & (value.try_cast("bigint") <= F.lit(MAX_ID)),
        F.lit(False),
    )


def strict_date(value: Column) -> Column:
    """Canonical ``yyyy-MM-dd`` text to a date, null for anything else."""
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), value.try_cast("date"))


def mixed_date(value: Column, formats: Sequence[str]) -> Column:
    """First format that parses wins; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats]).cast("date")


def tokens(value: Column, separator: str = ",") -> Column:
    """Distinct, trimmed, non-empty tokens; an empty array for null."""
    parts = F.transform(F.split(value, separator), lambda t: F.trim(t))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda t: t != "")),
                      F.array().cast("array<string>"))


def range_bounds(value: Column) -> tuple[Column, Column]:
    """Lower and upper bound of ``"20000 - 50000"``; null unless well formed and ordered."""
    pattern = r"^\s*(\d+)\s*-\s*(\d+)\s*$"
    low = F.regexp_extract(value, pattern, 1).try_cast("bigint")
    high = F.regexp_extract(value, pattern, 2).try_cast("bigint")
    ordered = low <= high
    return F.when(ordered, low), F.when(ordered, high)


def utc_instant(value: Column) -> Column:
    """ISO text with an explicit zone to a UTC wall-clock timestamp; null otherwise."""
    zoned = value.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$")
    return _utc_wall_clock(F.when(zoned, value.try_cast("timestamp")))


def _utc_wall_clock(instant: Column) -> Column:
    """Instant to zone-free UTC time, whatever the session zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def http_date(value: Column) -> Column:
    """``Tue, 13 Oct 2026 15:36:29 GMT`` to a UTC wall-clock timestamp; null otherwise."""
    pattern = r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT)$"
    return _utc_wall_clock(F.try_to_timestamp(F.regexp_extract(value, pattern, 1), F.lit("dd MMM yyyy HH:mm:ss z")))


def gap_days(earlier: Column, later: Column) -> Column:
    """Elapsed days, exact to the microsecond. Interval parts never pass through a time zone."""
    span = later - earlier
    part = lambda unit: F.extract(F.lit(unit), span)
    whole = (part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60).cast("bigint") * 1000000
    return (whole + (part("SECOND") * 1000000).cast("bigint")) / F.lit(86400e6)


# ---------------------------------------------------------------- observation typing
def _finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def observation_issue(deal_status: Column, price: Column, regular: Column, cut: Column,
                      price_currency: Column, regular_currency: Column) -> Column:
    """Reason why a record says nothing certain, in fixed precedence; null when it does."""
    numbers_ok = (_finite(price) & _finite(regular) & _finite(cut)
                  & (price >= 0) & (regular >= 0) & cut.between(0, 100))
    currency_ok = F.coalesce(price_currency.rlike(CURRENCY_PATTERN)
                             & (price_currency == regular_currency), F.lit(False))
    agrees = ((cut > 0) & (price < regular)) | ((cut == 0) & (price == regular))
    return (F.when(deal_status != "object", F.concat(F.lit("deal_"), deal_status))
            .when(~numbers_ok, "missing_or_invalid_price_regular_cut")
            .when(~currency_ok, "missing_or_mismatched_currency")
            .when(~agrees, "price_regular_cut_disagree"))


def observation_kind(issue: Column, cut: Column) -> Column:
    return (F.when(issue.isNotNull(), "ambiguous").when(cut > 0, "discount")
            .otherwise("full_price"))


def currency_code(currency: Column) -> Column:
    """Three capital letters as an int, so min/max stay in the hash aggregate; exact."""
    a = lambda i: F.ascii(F.substring(currency, i, 1))
    return F.when(currency.rlike(CURRENCY_PATTERN), a(1) * 65536 + a(2) * 256 + a(3))


def currency_text(code: Column) -> Column:
    """Inverse of :func:`currency_code`."""
    return F.concat(F.char((code / 65536).cast("bigint")),
                    F.char(((code % 65536) / 256).cast("bigint")),
                    F.char((code % 256).cast("bigint")))


# ---------------------------------------------------------------- categories, labels, bands
def evidence_category(total: Column, discounts: Column, full: Column) -> Column:
    """D nothing seen, A a discount seen, B every record at full price, C anything else."""
    return (F.when(total == 0, "D").when(discounts > 0, "A")
            .when(full == total, "B").otherwise("C"))


def label_value(category: Column) -> Column:
    return F.when(category == "A", 1).when(category.isin("B", "D"), 0).cast("int")


def pu_status(category: Column) -> Column:
    return F.when(category == "A", "positive").when(category.isin("B", "C", "D"), "unlabeled")


def coverage_group(count: Column) -> Column:
    return (F.when(count == 0, "0").when(count <= 9, "1-9").when(count <= 29, "10-29")
            .otherwise("30+"))


def band(value: Column, upper_edges: Sequence, names: Sequence[str]) -> Column:
    """Right-closed bands by ascending upper edges; one more name than edges."""
    if len(names) != len(upper_edges) + 1:
        raise ValueError("need one more name than edges")
    expr = None
    for edge, name in zip(upper_edges, names):
        cond = value <= edge
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return F.when(value.isNotNull(), expr.otherwise(names[-1]) if expr is not None else F.lit(names[-1]))


def release_timing(release: Column, start: Column, end: Column) -> Column:
    return (F.when(release.isNull(), "unknown_release_date")
            .when(release < start, "before_start_date").when(release == start, "on_start_date")
            .when(release < end, "interior_sale_dates").when(release == end, "on_end_date")
            .otherwise("after_end_date"))


def eligibility_status(release: Column, start: Column) -> Column:
    return (F.when(release == start, "uncertain_release_hour")
            .when(release < start, "eligible_by_release_date")
            .otherwise("ineligible_by_release_date"))


# ---------------------------------------------------------------- hashing
def hash_priority(id_value: Column, prefix: str) -> Column:
    """SHA-256 of prefix + id text: a stable order that ignores row position."""
    return F.sha2(F.concat(F.lit(prefix), id_value.cast("string")), 256)


def hash_modulo5(digest: Column) -> Column:
    """The 256-bit hex digest modulo 5. As 16 = 1 (mod 5) the digit sum is enough."""
    # conv() of an 8-digit slice is exact, and 16 = 1 (mod 5) makes slices additive too.
    slices = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(8)]
    total = slices[0]
    for part in slices[1:]:
        total = total + part
    return (total % 5).cast("int")


def evaluation_group(id_value: Column, prefix: str) -> Column:
    return F.when(hash_modulo5(hash_priority(id_value, prefix)) == 0, "evaluation") \
        .otherwise("development")
