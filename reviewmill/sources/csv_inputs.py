"""Hand-kept CSV inputs: additions and removals.

Every column is read as text and cast afterwards. Blank rows are dropped. The strict readers attach an
``error`` column instead of stopping at the first bad row; a job refuses to go on when any is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.functions.dates import trimmed_date
from reviewmill.functions.numbers import optional_bool, optional_int, parse_rating, whole_number
from reviewmill.functions.text import (
    ANONYMOUS,
    KEY_SEPARATOR,
    MANUAL_ID_PREFIX,
    clean,
    first_nonempty,
    nz,
    synthetic_id,
)
from reviewmill.operators.dedup import mark_repeats
from reviewmill.schemas import ADDITIONS, REMOVALS
from reviewmill.session import cut_lineage
from reviewmill.sources.csv_records import read_records
from reviewmill.sources.documents import with_review_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header, quoted line breaks, doubled quotes and a byte-order mark are understood; many tasks read a file.

    A missing file is an empty input. ``file`` and ``row`` say where a row stands, the header being row 1; ``row_id``
    grows with both.
    """
    records = read_records(spark, path)
    names = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema.fields)
    parsed = F.from_csv("text", names, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    name = F.element_at(F.split("file", "/"), -1)
    # A generator parses a record once; a filter on fields of a plain column is moved below it and parses once per field.
    return records.select(F.inline(F.array(parsed)), "row_id", name.alias("file"), "row")


def _place(rows: DataFrame) -> list[str]:
    """Columns that say where a row stands, as far as it has them."""
    return [c for c in ("file", "row") if c in rows.columns]


def has_content(columns: list[str]) -> Column:
    """At least one column holds more than white space."""
    return clean(F.concat_ws("", *columns)) != ""


def removal_keys(removals: DataFrame) -> DataFrame:
    """Lenient form: distinct keys of the rows that name both a branch and a review."""
    branch, review = clean("branch_id"), clean("review_id")
    return (
        removals.where((branch != "") & (review != ""))
        .select(F.concat(branch, F.lit(KEY_SEPARATOR), review).alias("reviewKey"))
        .distinct()
    )


def load_removals(removals: DataFrame, branches: DataFrame) -> DataFrame:
    """Strict form: one row per filled CSV row with ``error`` null or the reason to refuse it."""
    known = branches.select(F.col("id").alias("branchId"), F.lit(True).alias("known"))
    rows = (
        removals.where(has_content(REMOVALS.fieldNames()))
        .select(
            "row_id",
            *_place(removals),
            clean("branch_id").alias("branchId"),
            clean("review_id").alias("reviewId"),
            clean("reviewer_name").alias("reviewerName"),
            clean("published_at").alias("publishedAt"),
            clean("reason").alias("reason"),
        )
        .withColumn("reviewKey", F.concat("branchId", F.lit(KEY_SEPARATOR), "reviewId"))
        .join(known, "branchId", "left")
    )
    rows = mark_repeats(rows, "reviewKey", "row_id")
    error = (
        F.when(F.col("known").isNull(), "unknown branch_id")
        .when(F.col("reviewId") == "", "review_id is required")
        .when(F.col("repeated"), "duplicate removal")
    )
    return rows.withColumn("error", error).drop("known", "repeated")


def load_additions(
    additions: DataFrame, branches: DataFrame, base_branches: DataFrame | None, fetched_at: str
) -> DataFrame:
    """Additions as canonical reviews plus ``row_id`` and ``error``."""
    base = (
        base_branches.select("id", F.col("fid").alias("base_fid"), F.col("placeUrl").alias("base_url"))
        if base_branches is not None
        else branches.select("id", F.lit(None).cast("string").alias("base_fid"), F.lit(None).cast("string").alias("base_url"))
    )
    dim = branches.join(base, "id", "left").select(
        F.col("id").alias("branchId"),
        F.col("name").alias("branchName"),
        F.col("placeId").alias("b_placeId"),
        F.col("cid").alias("b_cid"),
        F.col("base_fid"),
        first_nonempty("base_url", "mapsSearchUrl", "profileUrl").alias("b_url"),
    )
    # Written out, so that it is known to be small and the additions are not shuffled for it.
    dim = cut_lineage(dim)
    rows = (
        additions.where(has_content(ADDITIONS.fieldNames()))
        .withColumns({"branchId": clean("branch_id"), "published_text": clean("published_at"), "response_date_text": clean("owner_response_date")})
        .join(dim, "branchId", "left")
    )
    rows = rows.select(
        "row_id", *_place(additions), "branchId", "branchName", "b_placeId", "b_cid", "base_fid", "b_url",
        whole_number("rating").alias("rating_whole"),
        parse_rating("rating").alias("rating"),
        "published_text",
        trimmed_date("published_text").alias("publishedAt"),
        "response_date_text",
        trimmed_date("response_date_text").alias("ownerResponseDate"),
        first_nonempty(clean("reviewer_name"), F.lit(ANONYMOUS)).alias("reviewerName"),
        clean("comment").alias("comment"),
        clean("owner_response_text").alias("ownerResponseText"),
        clean("review_id").alias("review_id"),
        nz(clean("reviewer_url")).alias("reviewerUrl"),
        nz(clean("review_url")).alias("reviewUrl"),
        optional_int("reviewer_review_count").try_cast("int").alias("reviewerReviewCount"),
        optional_bool("is_local_guide").alias("isLocalGuide"),
        first_nonempty(clean("language"), F.lit("en")).alias("language"),
    )
    made_id = synthetic_id(MANUAL_ID_PREFIX, "branchId", "reviewerName", "rating", "publishedAt", "comment")
    rows = rows.withColumn("id", first_nonempty("review_id", made_id)).withColumn(
        "reviewKey", F.concat("branchId", F.lit(KEY_SEPARATOR), "id")
    )
    error = (
        F.when(F.col("branchName").isNull(), "unknown branch_id")
        .when(F.col("rating_whole").isNull(), "rating must be a whole number from 1 to 5")
        .when(F.col("rating").isNull(), "rating must be between 1 and 5")
        .when(F.col("published_text") == "", "published_at is required")
        .when(F.col("publishedAt").isNull(), "could not understand date")
        .when((F.col("response_date_text") != "") & F.col("ownerResponseDate").isNull(), "could not understand date")
    )
    # Told before the rows are written, so the texts need not be.
    rows = rows.withColumn("mistake", error).drop("rating_whole", "published_text", "response_date_text")
    rows = mark_repeats(rows, "reviewKey", "row_id")
    error = F.coalesce("mistake", F.when(F.col("repeated"), "duplicate review_id"))
    none = F.lit(None).cast("string")
    reviews = rows.select(
        "row_id", *_place(additions), "id", "branchId", "branchName", "reviewerName", "reviewerUrl",
        F.coalesce("reviewerReviewCount", F.lit(0)).alias("reviewerReviewCount"),
        "isLocalGuide", "rating", "comment",
        F.lit("").alias("commentTranslated"),
        "publishedAt",
        F.col("publishedAt").alias("updatedAt"),
        F.lit("").alias("publishedLabel"),
        "reviewUrl",
        F.lit("Manual update").alias("reviewSource"),
        "ownerResponseText", "ownerResponseDate",
        F.col("ownerResponseDate").alias("ownerResponseUpdatedAt"),
        F.array().cast("array<string>").alias("reviewImageUrls"),
        "language",
        none.alias("translatedLanguage"),
        F.lit(fetched_at).alias("scrapedAt"),
        F.col("b_placeId").alias("placeId"),
        F.col("b_cid").alias("cid"),
        F.col("base_fid").alias("fid"),
        F.col("b_url").alias("placeUrl"),
        F.col("branchName").alias("title"),
        none.alias("reviewerProfilePhotoUrl"),
        error.alias("error"),
    )
    return with_review_columns(reviews)
