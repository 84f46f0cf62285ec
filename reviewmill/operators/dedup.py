"""Duplicate detection and last-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.text import exact_signature, is_google, is_manual, loose_signature
from reviewmill.operators.sieve import key_hash, probe, sieve
from reviewmill.session import cut_lineage


def last_per_key(reviews: DataFrame, key: str = "reviewKey", order: str = "ord") -> DataFrame:
    """Last row of each key.

    The rank limit is applied before the shuffle as well, so a key that holds many copies sends one row
    per task.
    """
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return reviews.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def first_per_key(reviews: DataFrame, key: str = "reviewKey", order: str = "ord") -> DataFrame:
    """First row of each key; see ``last_per_key``."""
    oldest = Window.partitionBy(key).orderBy(F.col(order))
    return reviews.withColumn("_n", F.row_number().over(oldest)).where("_n = 1").drop("_n")


def mark_repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``repeated``: whether an earlier row, by ``order``, has the same key; a null key is never repeated.

    ``order`` tells all rows apart. Rows whose key surely stands once pass where they are read. Of the others the first
    row of each key is found by aggregation, to which each task sends one row per key, and joined back on its
    ``order``; so a key with any share of all rows spreads over tasks. Nothing is joined on the key.
    """
    # Read several times.
    rows = cut_lineage(rows)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key_hash(key).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    probed = probe(rows, sieve(counts.where("n > 1")), key_hash(key), "_maybe")
    maybe, never = probed.where("_maybe").drop("_maybe"), probed.where("not _maybe").drop("_maybe")
    firsts = cut_lineage(maybe.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first")).select("_first"))
    maybe = maybe.join(firsts, F.col(order) == F.col("_first"), "left")
    maybe = maybe.withColumn("repeated", F.col(key).isNotNull() & F.col("_first").isNull()).drop("_first")
    return never.withColumn("repeated", F.lit(False)).unionByName(maybe)


def duplicate_keys(reviews: DataFrame, key: str = "reviewKey") -> DataFrame:
    return reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exact_signature_dups(reviews: DataFrame) -> DataFrame:
    """Exact signatures held by more than one row."""
    return (
        reviews.select(exact_signature().alias("signature"))
        .groupBy("signature")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def loose_signature_dups(reviews: DataFrame) -> DataFrame:
    """Loose signatures held by more than one row."""
    return (
        reviews.select(loose_signature().alias("signature"))
        .groupBy("signature")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def loose_merge_pairs(reviews: DataFrame) -> DataFrame:
    """Loose groups that hold both a manual and a google row, with the number of mergeable pairs.

    Pairs are counted from the two group sizes, never listed.
    """
    sides = reviews.select(
        loose_signature().alias("signature"), is_manual().alias("manual"), is_google().alias("google")
    )
    return (
        sides.groupBy("signature")
        .agg(
            F.count_if("manual").alias("manual_rows"),
            F.count_if("google").alias("google_rows"),
        )
        .where("manual_rows > 0 and google_rows > 0")
        .withColumn("pairs", F.col("manual_rows") * F.col("google_rows"))
    )
