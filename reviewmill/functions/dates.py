"""Date parsing and business-zone calendar expressions. The clock is always an argument."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.text import clean, col, nz

# Fixed value: business zone used when a dataset names none.
DEFAULT_ZONE = "Africa/Johannesburg"

# Accepted layouts of hand-typed dates, each with what a text of the layout holds and what it can't hold.
# A layout is tried only on such texts, as a failed try costs an exception.
OFFSET_LAYOUTS = {"yyyy-M-d'T'H:m:sXXX": ("[tT]", None), "yyyy-M-d'T'H:m:sXX": ("[tT]", None)}
PLAIN_LAYOUTS = {
    "yyyy-M-d H:m": ("-[^:]*:", "/"),
    "yyyy-M-d": ("-", "[:/]"),
    "d/M/yyyy": ("/", ":"),
    "d/M/yyyy H:m": ("/[^:]*:", None),
    "d MMM yyyy": ("[^0-9 ]", "[:/]"),
    "d MMM yyyy H:m": ("[^0-9 :].*:", "/"),
}
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Texts up to this length hold no time of day and are placed at noon.
DATE_ONLY_LENGTH = 10


def instant(as_of: datetime | Column) -> Column:
    """The clock as a timestamp column; a naive ``datetime`` is read as UTC."""
    if isinstance(as_of, Column):
        return as_of
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    return F.lit(as_of)


def _fits(text: Column, holds: str, lacks: str | None) -> Column:
    return text.rlike(holds) if lacks is None else text.rlike(holds) & ~text.rlike(lacks)


def parse_typed_date(c: Column | str) -> Column:
    """Hand-typed date to a UTC timestamp; null when unreadable."""
    return _parsed(clean(c))


def _parsed(text: Column) -> Column:

    def tried(layouts: dict[str, tuple[str, str | None]]) -> Column:
        return F.coalesce(*[F.when(_fits(text, *marks), F.try_to_timestamp(text, F.lit(x))) for x, marks in layouts.items()])

    with_offset, plain = tried(OFFSET_LAYOUTS), tried(PLAIN_LAYOUTS)
    noon = F.date_trunc("day", plain) + F.expr("interval 12 hours")
    return F.coalesce(with_offset, F.when(F.length(text) <= DATE_ONLY_LENGTH, noon).otherwise(plain))


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(col(ts), ISO_UTC)


def normalize_date(c: Column | str) -> Column:
    """Hand-typed date to an ISO-8601 UTC string; null when missing or unreadable."""
    return trimmed_date(clean(c))


def trimmed_date(c: Column | str) -> Column:
    """:func:`normalize_date` of a trimmed text; a date is tried in many layouts, so a column that was trimmed once is cheaper."""
    return F.when(col(c) != "", iso_utc(_parsed(col(c))))


def iso_timestamp(c: Column | str) -> Column:
    """ISO-8601 string to a timestamp, null when unreadable."""
    return nz(c).try_cast("timestamp")


def zoned_date(ts: Column | str, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def week_start(day: Column | str) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", col(day)))


def month_start(day: Column | str) -> Column:
    return F.to_date(F.date_trunc("month", col(day)))


def month_key(day: Column | str) -> Column:
    return F.date_format(col(day), "yyyy-MM")


def short_date(day: Column | str) -> Column:
    return F.date_format(col(day), "MMM d")


def days_before(as_of: datetime | Column, days: int) -> Column:
    return instant(as_of) - F.make_dt_interval(F.lit(days))


def since(ts: Column | str, as_of: datetime | Column, days: int) -> Column:
    """At or after ``days`` days before the clock. No upper bound: future rows count."""
    return F.coalesce(col(ts) >= days_before(as_of, days), F.lit(False))


def in_period(ts: Column | str, as_of: datetime | Column, offset_days: int, length_days: int) -> Column:
    """Half-open period that ends ``offset_days`` before the clock."""
    ts = col(ts)
    end = days_before(as_of, offset_days)
    start = days_before(as_of, offset_days + length_days)
    return F.coalesce((ts >= start) & (ts < end), F.lit(False))


def in_current_month(ts: Column | str, as_of: datetime | Column, zone: str) -> Column:
    """Same local month as the clock. A constant range, a day wider on both sides, is tested first."""
    ts = col(ts)
    month = F.trunc(zoned_date(instant(as_of), zone), "MM")
    near = (ts >= F.date_sub(month, 2).cast("timestamp")) & (ts < F.date_add(F.add_months(month, 1), 2).cast("timestamp"))
    return F.coalesce(near & (F.trunc(zoned_date(ts, zone), "MM") == month), F.lit(False))


def prune_months(reviews: DataFrame, low: Column, high: Column | None = None) -> DataFrame:
    """Limit a published table to the month folders an instant range can touch; other tables stay as they are."""
    if "published_month" not in reviews.columns:
        return reviews
    months = F.col("published_month") >= F.date_format(low, "yyyy-MM")
    if high is not None:
        months = months & (F.col("published_month") <= F.date_format(high, "yyyy-MM"))
    return reviews.where(months)
