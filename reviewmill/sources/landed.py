"""Landed payloads: scraped items and paged review, account and location payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions.numbers import round_half_up_1
from reviewmill.functions.text import clean, first_nonempty
from reviewmill.schemas import ACCOUNT, LOCATION, RAW_ITEM, REVIEW_PAGE


def read_items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scraped items from JSON arrays (or JSON lines); ``item_ord`` is the landing order."""
    items = spark.read.schema(RAW_ITEM).json(path, multiLine=not lines)
    return items.withColumn("item_ord", F.monotonically_increasing_id())


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Review pages, one row per page."""
    return spark.read.schema(REVIEW_PAGE).json(path, multiLine=not lines)


def explode_pages(pages: DataFrame) -> DataFrame:
    """Pages to items, in page order; a page without reviews adds no item."""
    return pages.select("branch_id", "page_no", F.posexplode("reviews").alias("pos", "item"))


def page_totals(pages: DataFrame) -> DataFrame:
    """Reported totals per branch: the last page that gives a non-zero value counts."""
    total = F.col("totalReviewCount")
    rating = F.col("averageRating")
    return pages.groupBy(F.col("branch_id").alias("branchId")).agg(
        F.count(F.lit(1)).alias("pageCount"),
        F.coalesce(F.max_by(F.when(total > 0, total), F.when(total > 0, F.col("page_no"))), F.lit(0)).alias(
            "totalReviewCount"
        ),
        F.coalesce(
            F.max_by(F.when(rating > 0, round_half_up_1(rating)), F.when(rating > 0, F.col("page_no"))), F.lit(0.0)
        ).alias("averageRating"),
    )


def read_locations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(LOCATION).json(path, multiLine=not lines)


def read_accounts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(ACCOUNT).json(path, multiLine=not lines)


def location_name(account: Column | str, location: Column | str, strict: bool = True) -> Column:
    """Full location name from an account and a location part.

    ``strict`` stops the query for parts that do not compose; otherwise the name is null.
    """
    account, location = clean(account), clean(location)
    composed = F.when(location.startswith("accounts/"), location).when(
        account.startswith("accounts/") & location.startswith("locations/"),
        F.concat(account, F.lit("/"), location),
    )
    if not strict:
        return composed
    message = F.concat(F.lit("cannot compose a location name from "), account, F.lit(" and "), location)
    return F.coalesce(composed, F.raise_error(message).cast("string"))


def flatten_locations(locations: DataFrame, strict: bool = True) -> DataFrame:
    """Nested location payloads to flat rows; absent texts become empty."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    return locations.select(
        F.col("account_name").alias("accountName"),
        clean("name").alias("locationName"),
        location_name("account_name", "name", strict).alias("googleLocationName"),
        text("title").alias("title"),
        text("storeCode").alias("storeCode"),
        text("websiteUri").alias("websiteUri"),
        text("metadata.placeId").alias("placeId"),
        text("metadata.mapsUri").alias("mapsUri"),
        text("metadata.newReviewUri").alias("newReviewUri"),
    )


def locations_per_account(accounts: DataFrame, locations: DataFrame) -> DataFrame:
    """Accounts with their number of locations; accounts without any are kept.

    Locations are counted before the join, so the join carries one row per account.
    """
    counts = locations.groupBy(F.col("account_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return accounts.join(counts, "name", "left").select(
        "name",
        first_nonempty("accountName", "name").alias("accountName"),
        F.coalesce(first_nonempty("type", "accountType"), F.lit("")).alias("type"),
        F.coalesce("n", F.lit(0)).alias("locationCount"),
    )


