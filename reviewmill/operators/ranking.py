"""Follow-up list and newest-per-branch selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.predicates import display_comment, needs_follow_up

FOLLOW_UP_SIZE = 6


def attention_list(reviews: DataFrame, size: int = FOLLOW_UP_SIZE) -> DataFrame:
    """Newest reviews of three stars or fewer without an answer. Sort and limit become one top-k step."""
    return (
        reviews.where(needs_follow_up())
        .withColumn("displayComment", display_comment())
        .orderBy(F.desc("published_ts"), "ord")
        .limit(size)
    )


def cap_newest_per_branch(reviews: DataFrame, cap: int, *order: Column) -> DataFrame:
    """The first ``cap`` rows of each branch in source order.

    The limit is applied per task before the shuffle, so a large branch sends ``cap`` rows per task.
    """
    source_order = Window.partitionBy("branchId").orderBy(*order)
    return reviews.withColumn("position", F.row_number().over(source_order)).where(F.col("position") <= cap)
