"""Calendar windows and how records relate to them.

The calendar is configuration (a few dozen half-open windows), so it enters plans as literals:
no join, no broadcast. All window edges cut the time axis into elementary segments; a record
lies in exactly one, and each window is a run of segments. Heavy aggregation therefore handles
every record once, and only the small per-segment rows are repeated per window.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Window:
    year: int
    start_date: date
    end_date: date
    start: datetime  # UTC wall clock, inclusive
    end: datetime    # UTC wall clock, exclusive


def _ntz(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


@dataclass(frozen=True)
class Calendar:
    windows: tuple[Window, ...]

    def __post_init__(self):
        years = [w.year for w in self.windows]
        if not years or sorted(set(years)) != years:
            raise ValueError("calendar years must be unique and ascending")
        if any(w.start >= w.end for w in self.windows):
            raise ValueError("every window needs start < end")

    @classmethod
    def of(cls, windows: Iterable[Window]) -> "Calendar":
        return cls(tuple(sorted(windows, key=lambda w: w.year)))

    @property
    def years(self) -> list[int]:
        return [w.year for w in self.windows]

    def window(self, year: int) -> Window:
        return next(w for w in self.windows if w.year == year)

    def only(self, *years: int) -> "Calendar":
        return Calendar(tuple(w for w in self.windows if w.year in years))

    @property
    def edges(self) -> list[datetime]:
        return sorted({e for w in self.windows for e in (w.start, w.end)})

    def segment(self, ts: Column) -> Column:
        """Number of window edges at or before ``ts``: 0 .. len(edges)."""
        total = F.lit(0)
        for edge in self.edges:
            total = total + F.when(ts >= _ntz(edge), 1).otherwise(0)
        return total

    def literal_array(self) -> Column:
        edges = self.edges
        return F.array(*[F.struct(
            F.lit(w.year).alias("window_year"),
            F.lit(w.start_date).cast("date").alias("start_date"),
            F.lit(w.end_date).cast("date").alias("end_date"),
            _ntz(w.start).alias("window_start"), _ntz(w.end).alias("window_end"),
            F.lit(edges.index(w.start) + 1).alias("first_segment"),
            F.lit(edges.index(w.end)).alias("last_segment")) for w in self.windows])

    def each_window(self, df: DataFrame, *, segments: bool = False) -> DataFrame:
        """Every row once per window: a bounded, narrow expansion."""
        out = df.select("*", F.inline(self.literal_array()))
        return out if segments else out.drop("first_segment", "last_segment")


def side(ts: Column, start: Column, end: Column) -> Column:
    return F.when(ts < start, "before").when(ts < end, "inside").otherwise("after")


def segment_side(segment: Column, first: Column, last: Column) -> Column:
    return F.when(segment < first, "before").when(segment <= last, "inside").otherwise("after")


def entity_windows(entities: DataFrame, calendar: Calendar) -> DataFrame:
    """One row per entity and window with release timing and eligibility."""
    from tideline.functions import rules

    rows = calendar.each_window(entities)
    return rows.select(
        "*",
        rules.release_timing(F.col("release_date"), F.col("start_date"), F.col("end_date"))
        .alias("release_timing"),
        rules.eligibility_status(F.col("release_date"), F.col("start_date"))
        .alias("eligibility_status"),
        (F.col("release_date") <= F.col("start_date")).alias("eligible"),
    )


def tag_records(observations: DataFrame, calendar: Calendar) -> DataFrame:
    """Half-open range join: each record with its side of every window."""
    rows = calendar.each_window(observations)
    return rows.withColumn("side", side(F.col("ts"), F.col("window_start"), F.col("window_end")))


def verify_calendar_rows(rows: DataFrame) -> DataFrame:
    """Check declared calendar rows: zone offset, UTC agreement, year and order.

    Columns: ``window_year, zone, start_local, end_local`` (ISO text with offset) and
    ``start_utc, end_utc`` (ISO text ending in Z). Adds UTC edges and a list of problems.
    """
    from tideline.functions import rules

    def checked(name: str) -> tuple[Column, Column, Column]:
        local_text, utc_text = F.col(f"{name}_local"), F.col(f"{name}_utc")
        wall = F.substring(local_text, 1, 19).try_cast("timestamp_ntz")
        instant = rules.utc_instant(local_text)
        zone_ok = F.convert_timezone(F.col("zone"), F.lit("UTC"), wall) == instant
        return instant, zone_ok, rules.utc_instant(utc_text) == instant

    s, s_zone, s_utc = checked("start")
    e, e_zone, e_utc = checked("end")
    bad = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), F.lit(text))
    year = lambda c: F.substring(F.col(c), 1, 4).try_cast("int") == F.col("window_year")
    return rows.select(
        "*", s.alias("window_start"), e.alias("window_end"),
        F.array_compact(F.array(
            bad(s_zone, "start_offset"), bad(e_zone, "end_offset"), bad(s_utc, "start_utc"),
            bad(e_utc, "end_utc"), bad(year("start_local") & year("end_local"), "year"),
            bad(s < e, "order"))).alias("problems"))


def local_window(year: int, start: str, end: str, zone: str = "America/Los_Angeles") -> Window:
    """Window from zone-local wall-clock text, for calendars written by hand."""
    tz = ZoneInfo(zone)
    a, b = (datetime.fromisoformat(v).replace(tzinfo=tz) for v in (start, end))
    to_utc = lambda d: d.astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
    return Window(year, a.date(), b.date(), to_utc(a), to_utc(b))
