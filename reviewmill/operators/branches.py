"""Branch dimension: selection, lookup, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.numbers import avg_positive, round_half_up_1, to_int
from reviewmill.functions.text import clean, first_nonempty


def select_branches(branches: DataFrame, requested: DataFrame | None) -> DataFrame:
    """Configured branches in the order of the request; no request selects all.

    ``requested`` has ``id`` and ``pos``. Blank ids are ignored.
    """
    if requested is None:
        return branches.withColumn("pos", F.col("branch_ord").cast("bigint"))
    wanted = requested.select(clean("id").alias("id"), F.col("pos").cast("bigint").alias("pos")).where("id != ''")
    return branches.join(wanted, "id")


def unknown_requested(branches: DataFrame, requested: DataFrame) -> DataFrame:
    wanted = requested.select(clean("id").alias("id")).where("id != ''")
    return wanted.join(branches.select("id"), "id", "left_anti")


def known_branch_reviews(reviews: DataFrame, branches: DataFrame) -> DataFrame:
    return reviews.join(branches.select(F.col("id").alias("branchId")), "branchId", "left_semi")


def unknown_branch_reviews(reviews: DataFrame, branches: DataFrame) -> DataFrame:
    return reviews.join(branches.select(F.col("id").alias("branchId")), "branchId", "left_anti")


def branch_lookup(reviews: DataFrame, branches: DataFrame) -> DataFrame:
    """Reviews with name and location of their branch."""
    dim = branches.select(F.col("id").alias("branchId"), F.col("name").alias("lookup_name"), "location")
    return reviews.join(dim, "branchId")


def branch_rating(reviews: DataFrame, branches: DataFrame) -> DataFrame:
    """Review count and one-decimal mean of the positive ratings; branches without reviews stay."""
    stats = reviews.groupBy("branchId").agg(
        F.count(F.lit(1)).alias("n"), avg_positive("rating").alias("mean")
    )
    return branches.join(stats, branches["id"] == stats["branchId"], "left").select(
        branches["*"],
        F.coalesce("n", F.lit(0)).alias("computedCount"),
        round_half_up_1(F.coalesce("mean", F.lit(0.0))).alias("computedRating"),
    )


def active_branches(branches: DataFrame, base_branches: DataFrame, additions: DataFrame) -> DataFrame:
    """Configured branches that the base holds or that receive an addition."""
    live = base_branches.select("id").union(additions.select(F.col("branchId").alias("id")).distinct())
    return branches.join(live, "id", "left_semi")


def enrich_incremental(
    branches: DataFrame, current_branches: DataFrame, updates: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Published branch rows: scraped value first, then the stored one, then the configured one."""
    stored = current_branches.select(
        F.col("id").alias("c_id"),
        F.col("placeUrl").alias("c_url"),
        F.col("placeId").alias("c_place"),
        F.col("fid").alias("c_fid"),
        F.col("imageUrl").alias("c_image"),
    )
    scraped = updates.select(
        F.col("branchId").alias("u_id"),
        F.col("placeUrl").alias("u_url"),
        F.col("placeId").alias("u_place"),
        F.col("fid").alias("u_fid"),
        F.col("imageUrl").alias("u_image"),
        F.col("currentReviewsCount").alias("u_count"),
        F.col("currentRating").alias("u_rating"),
    )
    rated = branch_rating(reviews, branches)
    joined = rated.join(stored, F.col("id") == F.col("c_id"), "left").join(
        scraped, F.col("id") == F.col("u_id"), "left"
    )
    return joined.select(
        "branch_ord", "id", "name", "shortName", "location", "color", "googleLocationName",
        "cid", "profileUrl", "searchQuery", "mapsSearchUrl", "aliases", "blockedTitles",
        F.col("computedCount").alias("currentReviewsCount"),
        F.col("computedRating").alias("currentRating"),
        first_nonempty("u_url", "c_url", "mapsSearchUrl", "profileUrl").alias("placeUrl"),
        first_nonempty("u_place", "c_place", "placeId").alias("placeId"),
        first_nonempty("u_fid", "c_fid").alias("fid"),
        first_nonempty("u_image", "c_image").alias("imageUrl"),
        to_int(F.coalesce("u_count", F.lit(0.0))).alias("apifyReportedReviewsCount"),
        round_half_up_1(F.coalesce("u_rating", F.lit(0.0))).alias("apifyReportedRating"),
    )


def enrich_manual(branches: DataFrame, base_branches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Published branch rows of a manual rebuild: stored value first, then the configured one."""
    stored = base_branches.select(
        F.col("id").alias("c_id"),
        F.col("placeUrl").alias("c_url"),
        F.col("fid").alias("c_fid"),
        F.col("imageUrl").alias("c_image"),
    )
    joined = branch_rating(reviews, branches).join(stored, F.col("id") == F.col("c_id"), "left")
    return joined.select(
        "branch_ord", "id", "name", "shortName", "location", "color", "googleLocationName",
        "cid", "placeId", "profileUrl", "searchQuery", "mapsSearchUrl", "aliases", "blockedTitles",
        F.col("computedCount").alias("currentReviewsCount"),
        F.col("computedRating").alias("currentRating"),
        first_nonempty("c_url", "mapsSearchUrl", "profileUrl").alias("placeUrl"),
        F.col("c_fid").alias("fid"),
        F.col("c_image").alias("imageUrl"),
    )


def focus_branch(branches: DataFrame, requested: str | None) -> DataFrame:
    """The requested branch, else the first configured one. Works on the small branch dimension."""
    wanted = F.coalesce(F.col("id") == F.lit(requested), F.lit(False))
    order = Window.orderBy(F.when(wanted, 0).otherwise(1), "branch_ord")
    return branches.withColumn("focus", F.row_number().over(order)).where("focus = 1").drop("focus")
