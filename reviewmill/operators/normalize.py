"""Landed items to canonical reviews, one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.numbers import first_number, star_number, star_word, to_int
from reviewmill.functions.text import (
    ANONYMOUS,
    SCRAPED_ID_PREFIX,
    clean,
    first_nonempty,
    nz,
    synthetic_id,
)
from reviewmill.schemas import REVIEW_FIELDS
from reviewmill.sources.documents import with_review_columns


def _null() -> Column:
    return F.lit(None).cast("string")


def _no_images() -> Column:
    return F.array().cast("array<string>")


def attach_branch(items: DataFrame, branches: DataFrame, key: str = "branch_ord") -> DataFrame:
    """Join the branch dimension under ``b_`` names; items without a branch drop out."""
    names = ["id", "name", "placeId", "cid", "fid", "mapsSearchUrl", "profileUrl"]
    dim = branches.select(F.col(key).alias("b_key"), *[F.col(n).alias(f"b_{n}") for n in names])
    return items.join(dim, items[key] == dim["b_key"]).drop("b_key")


def normalize_items(matched: DataFrame, fetched_at: str) -> DataFrame:
    """Scraped items that carry ``b_`` branch columns to canonical reviews.

    Items without a date or with a zero rating are dropped.
    """
    published = first_nonempty("publishedAtDate", "publishedAt", "scrapedAt")
    rating = first_number("stars", "rating")
    rows = matched.withColumn("p_at", nz(published)).withColumn("p_rating", rating)
    rows = rows.where(F.col("p_at").isNotNull() & (F.col("p_rating") != 0))
    whole = to_int(F.col("p_rating"))
    comment = F.coalesce("text", F.lit(""))
    name = first_nonempty("name", F.lit(ANONYMOUS))
    made_id = synthetic_id(SCRAPED_ID_PREFIX, "b_id", name, whole, "p_at", comment)
    reviews = rows.select(
        *([F.col("item_ord")] if "item_ord" in matched.columns else []),
        first_nonempty(clean("reviewId"), made_id).alias("id"),
        F.col("b_id").alias("branchId"),
        F.col("b_name").alias("branchName"),
        name.alias("reviewerName"),
        "reviewerUrl",
        to_int(first_number("reviewerNumberOfReviews")).alias("reviewerReviewCount"),
        F.coalesce("isLocalGuide", F.lit(False)).alias("isLocalGuide"),
        whole.alias("rating"),
        comment.alias("comment"),
        F.coalesce("textTranslated", F.lit("")).alias("commentTranslated"),
        F.col("p_at").alias("publishedAt"),
        first_nonempty("updatedAtDate", "p_at").alias("updatedAt"),
        F.coalesce("publishAt", F.lit("")).alias("publishedLabel"),
        "reviewUrl",
        first_nonempty("reviewOrigin", F.lit("Google")).alias("reviewSource"),
        F.coalesce("responseFromOwnerText", F.lit("")).alias("ownerResponseText"),
        F.col("responseFromOwnerDate").alias("ownerResponseDate"),
        F.col("responseFromOwnerDate").alias("ownerResponseUpdatedAt"),
        F.coalesce("reviewImageUrls", _no_images()).alias("reviewImageUrls"),
        first_nonempty("originalLanguage", "language").alias("language"),
        "translatedLanguage",
        first_nonempty("scrapedAt", F.lit(fetched_at)).alias("scrapedAt"),
        first_nonempty("placeId", "b_placeId").alias("placeId"),
        first_nonempty("cid", "b_cid").alias("cid"),
        first_nonempty("fid", "b_fid").alias("fid"),
        first_nonempty("url", "b_mapsSearchUrl", "b_profileUrl").alias("placeUrl"),
        first_nonempty("title", "b_name").alias("title"),
        _null().alias("reviewerProfilePhotoUrl"),
    )
    return with_review_columns(reviews)


def branch_updates(matched: DataFrame) -> DataFrame:
    """Last matched item per branch, taken even when its review was dropped.

    The last position is found first, so only one item per branch reaches the wide projection.
    """
    last = matched.groupBy("b_id").agg(F.max("item_ord").alias("item_ord"))
    return matched.join(last, ["b_id", "item_ord"], "left_semi").select(
        F.col("b_id").alias("branchId"),
        first_number("reviewsCount").alias("currentReviewsCount"),
        first_number("totalScore").alias("currentRating"),
        F.col("url").alias("placeUrl"),
        "placeId",
        "fid",
        "imageUrl",
    )


def normalize_paged(items: DataFrame, branches: DataFrame, fetched_at: str, numeric_stars: bool = False) -> DataFrame:
    """Exploded page items to canonical reviews.

    Rows without an id or date, or with a rating of 0, are dropped. ``numeric_stars`` reads sources
    that give the rating as a number instead of a word.
    """
    names = ["name", "placeId", "cid", "fid", "profileUrl", "mapsSearchUrl"]
    dim = branches.select(F.col("id").alias("branch_id"), *[F.col(n).alias(f"b_{n}") for n in names])
    stars = star_number("item.starRating") if numeric_stars else star_word("item.starRating")
    rows = (
        items.withColumn("r_id", clean("item.reviewId"))
        .withColumn("r_stars", stars)
        .where((F.col("r_id") != "") & nz("item.createTime").isNotNull() & (F.col("r_stars") > 0))
        .join(dim, "branch_id")
    )
    reviews = rows.select(
        "page_no",
        "pos",
        F.col("r_id").alias("id"),
        F.col("branch_id").alias("branchId"),
        F.col("b_name").alias("branchName"),
        first_nonempty("item.reviewer.displayName", F.lit(ANONYMOUS)).alias("reviewerName"),
        _null().alias("reviewerUrl"),
        F.lit(0).alias("reviewerReviewCount"),
        F.lit(False).alias("isLocalGuide"),
        F.col("r_stars").alias("rating"),
        F.coalesce("item.comment", F.lit("")).alias("comment"),
        F.lit("").alias("commentTranslated"),
        F.col("item.createTime").alias("publishedAt"),
        first_nonempty("item.updateTime", "item.createTime").alias("updatedAt"),
        F.lit("").alias("publishedLabel"),
        _null().alias("reviewUrl"),
        F.lit("Google Business Profile review").alias("reviewSource"),
        F.coalesce("item.reviewReply.comment", F.lit("")).alias("ownerResponseText"),
        F.col("item.reviewReply.updateTime").alias("ownerResponseDate"),
        F.col("item.reviewReply.updateTime").alias("ownerResponseUpdatedAt"),
        _no_images().alias("reviewImageUrls"),
        _null().alias("language"),
        _null().alias("translatedLanguage"),
        F.lit(fetched_at).alias("scrapedAt"),
        F.col("b_placeId").alias("placeId"),
        F.col("b_cid").alias("cid"),
        F.col("b_fid").alias("fid"),
        first_nonempty("b_profileUrl", "b_mapsSearchUrl").alias("placeUrl"),
        F.col("b_name").alias("title"),
        F.col("item.reviewer.profilePhotoUrl").alias("reviewerProfilePhotoUrl"),
    )
    return with_review_columns(reviews)


def canonical(reviews: DataFrame) -> DataFrame:
    """Only the fields of the data format, in its order."""
    return reviews.select(*REVIEW_FIELDS)
