"""Incremental merge as a stream: every micro-batch of landed rows is merged and published as a version.

Late and edited reviews are settled by the merge, so no watermark is needed. A version names the stream and the batch
it holds in the same manifest as its tables. So a batch that was published is skipped when the stream restarts, and
one that was not leaves nothing behind that a reader could see, wherever it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reviewmill.operators.delta import merge_delta
from reviewmill.sources.sinks import latest, publish

Check = Callable[[DataFrame, DataFrame], None]


def published(state: dict, stream: str, batch_id: int) -> bool:
    """Whether a version already holds this batch of the stream."""
    return state.get(f"stream-{stream}", -1) >= batch_id


def next_state(state: dict, stream: str, batch_id: int) -> dict:
    return {**state, f"stream-{stream}": batch_id}


def merge_batch(
    spark: SparkSession,
    incoming: DataFrame,
    batch_id: int,
    root: str,
    removal_keys: DataFrame | None = None,
    check: Check | None = None,
    stream: str = "",
) -> None:
    """Merge canonical reviews that carry ``ord`` into the published table below ``root``, unless a version holds them.

    ``check`` gets the rows that were merged and the rows of the months that are written.
    """
    base = latest(spark, root)
    state = base.state if base else {}
    if published(state, stream, batch_id):
        return
    if removal_keys is None:
        removal_keys = spark.createDataFrame([], "reviewKey string")
    delta = merge_delta(spark, root, base, incoming, removal_keys)
    if check:
        check(delta.merged, delta.rows)
    publish(spark, root, {"reviews": delta.rows}, base, delta.touched, next_state(state, stream, batch_id))


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """Spark names a stream in its checkpoint; a fresh checkpoint is another stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"].replace("-", "")


def start(landed: DataFrame, one_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run over everything landed so far, then stop."""
    return landed.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_incremental(
    landed: DataFrame,
    to_reviews: Callable[[DataFrame], DataFrame],
    root: str,
    checkpoint: str,
    removal_keys: DataFrame | None = None,
    check: Check | None = None,
) -> StreamingQuery:
    """Reviews only. ``to_reviews`` turns a batch into stamped reviews."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # The merge writes the batch before it reads it again.
        merge_batch(batch.sparkSession, to_reviews(batch), batch_id, root, removal_keys, check, stream_name(batch.sparkSession, checkpoint))

    return start(landed, one_batch, checkpoint)
