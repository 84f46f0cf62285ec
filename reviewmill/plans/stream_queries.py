"""Registered queries: the two streaming jobs run over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.operators.merge import INCOMING, stamp_order
from reviewmill.operators.order import numbered
from reviewmill.plans.binding import event_reviews, table
from reviewmill.plans.registry import query
from reviewmill.session import scratch_path
from reviewmill.sources.sinks import read_table
from reviewmill.streaming.incremental import stream_incremental
from reviewmill.streaming.weekly import all_weeks, stream_weekly

_EVENTS_SQL = """
rows as (
  select event_id, event_type as branch_id, user_id, ts, (cast(json_extract(props, '$.k') as int) % 5 + 1)::bigint as rating from events
)"""


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(
    "stream_incremental",
    f"""with {_EVENTS_SQL}
    select branch_id || '::' || event_id as review_key, branch_id, rating, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as published_at
    from rows qualify row_number() over (partition by branch_id, user_id, cast(ts as date), rating order by event_id) = 1""",
)
def stream_incremental_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into the trusted table; rows of equal signature keep the first."""
    root = scratch_path(spark, "stream-table")
    stamped = lambda batch: stamp_order(event_reviews(batch), INCOMING, F.col("event_id")).drop("event_id")
    stream = stream_incremental(_event_stream(spark, sf_dir), stamped, root, scratch_path(spark, "stream-state"))
    stream.awaitTermination()
    return read_table(spark, root, "reviews").select(
        F.col("reviewKey").alias("review_key"), F.col("branchId").alias("branch_id"),
        F.col("rating").cast("bigint").alias("rating"), F.col("publishedAt").alias("published_at"),
    )


@query(
    "stream_three_batches",
    f"""with {_EVENTS_SQL}
    select branch_id || '::' || event_id as review_key, branch_id, rating, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as published_at,
      row_number() over (order by strftime(ts, '%Y-%m-%dT%H:%M:%SZ') desc, event_id % 3, event_id) as place
    from (select * from rows qualify row_number() over (partition by branch_id, user_id, cast(ts as date), rating order by event_id % 3, event_id) = 1)""",
)
def stream_three_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed three times, each landing merged into what is published by touching what it can change; ``place`` is the stored order."""
    folder, root, state = scratch_path(spark, "landed"), scratch_path(spark, "stream-table"), scratch_path(spark, "stream-state")
    events = table(spark, sf_dir, "events")
    stamped = lambda batch: stamp_order(event_reviews(batch), INCOMING, F.col("event_id")).drop("event_id")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.parquet(f"{folder}/{part}")
        # What was landed since the last run is one batch, in however many files.
        landed = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        stream_incremental(landed.parquet(folder), stamped, root, state).awaitTermination()
    reviews = read_table(spark, root, "reviews")
    return numbered(reviews).select(
        F.col("reviewKey").alias("review_key"), F.col("branchId").alias("branch_id"), F.col("rating").cast("bigint").alias("rating"),
        F.col("publishedAt").alias("published_at"), "place",
    )


@query(
    "stream_weekly",
    f"""with {_EVENTS_SQL}
    select strftime(date_trunc('week', ts + interval 2 hour), '%Y-%m-%d') as week, branch_id, count(*) as n, sum(rating)::bigint as rating_sum
    from rows group by all""",
)
def stream_weekly_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counts per local week, added up over the micro-batches."""
    reviews = event_reviews(_event_stream(spark, sf_dir)).select("branchId", "rating", "published_ts")
    root = scratch_path(spark, "weekly")
    stream_weekly(reviews, root, scratch_path(spark, "weekly-state"), "Africa/Johannesburg").awaitTermination()
    return all_weeks(spark, root).select(
        F.date_format("week_start", "yyyy-MM-dd").alias("week"), F.col("branchId").alias("branch_id"), "n", "rating_sum"
    )
