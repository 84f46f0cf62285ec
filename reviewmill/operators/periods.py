"""Week and month buckets on a dense calendar spine."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.dates import (
    instant,
    month_key,
    month_start,
    prune_months,
    short_date,
    week_start,
    zoned_date,
)
from reviewmill.functions.numbers import ratio_or_zero

WEEK, MONTH = "week", "month"
WEEKS_SHOWN, MONTHS_SHOWN = 8, 6


def _shown(kind: str, n: int | None) -> int:
    return n or (WEEKS_SHOWN if kind == WEEK else MONTHS_SHOWN)


def bucket_start(ts: Column | str, zone: str, kind: str) -> Column:
    """First day of the local week (Monday) or month an instant falls in."""
    day = zoned_date(ts, zone)
    return week_start(day) if kind == WEEK else month_start(day)


def spine_starts(as_of: datetime | Column, zone: str, kind: str, n: int | None = None) -> Column:
    """Array of the last ``n`` period starts, oldest first, ending at the current period."""
    last = bucket_start(instant(as_of), zone, kind)
    back = _shown(kind, n) - 1
    if kind == WEEK:
        return F.sequence(F.date_sub(last, 7 * back), last, F.expr("interval 7 days"))
    return F.sequence(F.add_months(last, -back), last, F.expr("interval 1 month"))


def describe(start: str, kind: str) -> list[Column]:
    """Key and labels of a period."""
    if kind == WEEK:
        end = F.date_add(start, 6)
        return [
            F.date_format(start, "yyyy-MM-dd").alias("bucket"),
            F.concat(short_date(start), F.lit(" to "), short_date(end)).alias("label"),
            short_date(start).alias("short_label"),
        ]
    return [
        month_key(start).alias("bucket"),
        F.date_format(start, "MMM yyyy").alias("label"),
        F.date_format(start, "MMM").alias("short_label"),
    ]


def period_spine(clock: DataFrame, zone: str, kind: str, n: int | None = None) -> DataFrame:
    """Spine rows for every ``as_of`` in ``clock``."""
    spine = clock.select("as_of", F.posexplode(spine_starts(F.col("as_of"), zone, kind, n)).alias("pos", "start"))
    return spine.select("as_of", (F.col("pos") + 1).alias("pos"), "start", *describe("start", kind))


def bucket_reviews(
    reviews: DataFrame, branches: DataFrame, as_of: datetime | Column, zone: str, kind: str, n: int | None = None
) -> DataFrame:
    """Branch x period counts and mean ratings, zero-filled; rows outside the spine are left out.

    Unlike the other averages a bucket's mean includes ratings of 0. The time range is tested on the raw
    instant first, so it can reach the scan.
    """
    starts = spine_starts(as_of, zone, kind, n)
    first = F.element_at(starts, 1)
    last = F.element_at(starts, -1)
    stop = F.date_add(last, 7) if kind == WEEK else F.add_months(last, 1)
    low = F.to_utc_timestamp(first.cast("timestamp"), zone)
    high = F.to_utc_timestamp(stop.cast("timestamp"), zone)
    inside = prune_months(reviews, low, high).where((F.col("published_ts") >= low) & (F.col("published_ts") < high))
    sums = (
        inside.withColumn("start", bucket_start("published_ts", zone, kind))
        .groupBy("branchId", "start")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("rating", F.lit(0))).alias("rating_sum"))
    )
    grid = branches.select("branch_ord", F.col("id").alias("branchId"), F.posexplode(starts).alias("pos", "start"))
    dense = grid.join(sums, ["branchId", "start"], "left")
    count = F.coalesce("n", F.lit(0))
    return dense.select(
        "branch_ord", "branchId", (F.col("pos") + 1).alias("pos"), "start", *describe("start", kind),
        count.alias("n"),
        F.coalesce("rating_sum", F.lit(0)).alias("rating_sum"),
        ratio_or_zero(F.coalesce("rating_sum", F.lit(0)), count).alias("average"),
    )


def calendar_table(buckets: DataFrame, periods: int) -> DataFrame:
    """One row per branch with a column pair per period and a count-weighted total."""
    positions = list(range(1, periods + 1))
    cells = (
        buckets.groupBy("branch_ord", "branchId")
        .pivot("pos", positions)
        .agg(F.max("n").alias("n"), F.max("average").alias("average"))
    )
    counts = [F.col(f"{p}_n") for p in positions]
    total = sum(counts[1:], counts[0])
    weighted = [F.col(f"{p}_average") * F.col(f"{p}_n") for p in positions]
    return cells.select(
        "branch_ord", "branchId",
        *[c for p in positions for c in (F.col(f"{p}_n").alias(f"n_{p}"), F.col(f"{p}_average").alias(f"average_{p}"))],
        total.alias("total_n"),
        ratio_or_zero(sum(weighted[1:], weighted[0]), total).alias("total_average"),
    )


def trend_scaled(buckets: DataFrame) -> DataFrame:
    """Bar heights in percent of the branch's best period. Windows run on bucket rows only."""
    best = F.max("n").over(Window.partitionBy("branchId"))
    return buckets.withColumn("height", F.col("n") / F.greatest(best, F.lit(1)) * 100)
