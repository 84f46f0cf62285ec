"""The incremental job as a stream of raw items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from reviewmill.plans.jobs import incremental_publish
from reviewmill.session import cut_lineage
from reviewmill.sources.sinks import latest
from reviewmill.streaming.incremental import next_state, published, start, stream_name


def stream_sync(
    landed: DataFrame,
    configured: DataFrame,
    selected: DataFrame,
    removals: DataFrame,
    root: str,
    checkpoint: str,
    generated_at: Callable[[int], str],
    **options,
) -> StreamingQuery:
    """The whole incremental job for every micro-batch of raw items: match, normalise, checks, merge, publish.

    Reviews, branches, run data, the raw copy and the batch's number become one version.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark, stream = batch.sparkSession, stream_name(batch.sparkSession, checkpoint)
        base = latest(spark, root)
        state = base.state if base else {}
        if not published(state, stream, batch_id):
            items = cut_lineage(batch)
            incremental_publish(
                spark, configured, selected, items, removals, root, generated_at(batch_id), base=base, state=next_state(state, stream, batch_id), **options
            )

    return start(landed, one_batch, checkpoint)
