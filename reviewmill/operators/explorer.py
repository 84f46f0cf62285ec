"""Review explorer: branch, rating, date range and keyword filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.dates import days_before, instant, prune_months, zoned_date
from reviewmill.functions.text import nz

ALL = "all"
RANGES = ("all", "yesterday", "last_7_days", "last_30_days", "this_month")
SEARCHED = ["reviewerName", "comment", "commentTranslated", "ownerResponseText", "branchName"]


def date_range(name: str, as_of: datetime | Column, zone: str, ts: str = "published_ts") -> Column:
    """Calendar ranges in the business zone. The two ``last`` ranges have no upper bound.

    Bounds on the raw instant come first; the optimizer folds them to constants and can push them down.
    """
    if name not in RANGES or name == ALL:
        return F.lit(True)
    today = zoned_date(instant(as_of), zone)
    day = zoned_date(ts, zone)

    def opens(first_day: Column) -> Column:
        return F.to_utc_timestamp(first_day.cast("timestamp"), zone)

    if name == "yesterday":
        test = (F.col(ts) >= opens(F.date_sub(today, 1))) & (F.col(ts) < opens(today))
        return test & (day == F.date_sub(today, 1))
    if name == "this_month":
        first = F.trunc(today, "MM")
        return (F.col(ts) >= opens(first)) & (F.trunc(day, "MM") == first)
    first = F.date_sub(today, 6 if name == "last_7_days" else 29)
    return (F.col(ts) >= opens(first)) & (day >= first)


def keyword(search: str) -> Column:
    """Lower-case substring over the searched texts joined by a space; a match may span two of them."""
    wanted = search.strip().lower()
    if not wanted:
        return F.lit(True)
    haystack = F.lower(F.concat_ws(" ", *[nz(c) for c in SEARCHED]))
    return haystack.contains(wanted)


def explore(
    reviews: DataFrame,
    as_of: datetime | Column,
    zone: str,
    branch_id: str = ALL,
    rating: float | str = ALL,
    range_name: str = ALL,
    search: str = "",
    ordered: bool = True,
) -> DataFrame:
    """Filtered reviews, newest first. The cheap comparisons stand before the text search."""
    rows = reviews
    if branch_id != ALL:
        rows = rows.where(F.col("branchId") == branch_id)
    if rating != ALL:
        rows = rows.where(F.col("rating") == float(rating))
    if range_name in RANGES and range_name != ALL:
        # Every range starts at most a month and a day before the clock.
        rows = prune_months(rows, days_before(as_of, 32))
    rows = rows.where(date_range(range_name, as_of, zone)).where(keyword(search))
    return rows.orderBy(F.desc("published_ts"), "ord") if ordered else rows
