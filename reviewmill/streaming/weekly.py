"""Live counts per branch and local week.

Every micro-batch adds its own counts to the totals of its stream and commits them as one version, so a batch that
runs again adds nothing, no review is too late, and no parts pile up: totals have a row per branch and week.

Spark names a stream in its checkpoint. A fresh checkpoint is another stream that reads the source anew; it has totals
of its own beside the old ones, so it neither replaces nor doubles them. Readers get the stream that has counted most:
the old one until the new one has caught up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewmill.session import cut_lineage
from reviewmill.sources.sinks import latest, publish, read_version
from reviewmill.streaming.incremental import next_state, published, start, stream_name

_TABLE = "weeks-"


def weekly_counts(reviews: DataFrame, zone: str = "UTC") -> DataFrame:
    """Counts and rating sums per branch and Monday week of a zone's calendar, whatever its clock does meanwhile."""
    local = F.from_utc_timestamp("published_ts", zone)
    week = F.to_date(F.date_trunc("week", local)).alias("week_start")
    return reviews.groupBy(week, "branchId").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating_sum"))


def _added(weeks: DataFrame) -> DataFrame:
    return weeks.groupBy("week_start", "branchId").agg(F.sum("n").alias("n"), F.sum("rating_sum").alias("rating_sum"))


def add_batch(spark: SparkSession, root: str, counts: DataFrame, stream: str, batch_id: int) -> None:
    """Add a batch's counts to its stream's totals, unless a version already holds them."""
    base = latest(spark, root)
    state = base.state if base else {}
    if published(state, stream, batch_id):
        return
    before = read_version(spark, root, base, _TABLE + stream) if base else None
    totals = counts if before is None else _added(before.unionByName(counts))
    publish(spark, root, {_TABLE + stream: totals}, base, state=next_state(state, stream, batch_id))


def stream_weekly(reviews: DataFrame, root: str, checkpoint: str, zone: str = "UTC") -> StreamingQuery:
    """Count everything landed so far into the totals below ``root``, then stop."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        add_batch(spark, root, cut_lineage(weekly_counts(batch, zone)), stream_name(spark, checkpoint), batch_id)

    return start(reviews, one_batch, checkpoint)


def all_weeks(spark: SparkSession, root: str) -> DataFrame | None:
    """The weeks of the stream that has counted most; null before the first batch."""
    base = latest(spark, root)
    names = sorted(name for name in base.tables if name.startswith(_TABLE)) if base else []
    if not names:
        return None
    totals = [read_version(spark, root, base, name) for name in names]
    # One number per stream.
    counted = [weeks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for weeks in totals]
    return totals[counted.index(max(counted))]
