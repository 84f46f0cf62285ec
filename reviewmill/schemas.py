"""Declared schemas; nothing is inferred on read. Field names are those of the data format."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


REVIEW = _struct(
    id=_S, branchId=_S, branchName=_S,
    reviewerName=_S, reviewerUrl=_S, reviewerReviewCount=_I, isLocalGuide=_B,
    rating=_I, comment=_S, commentTranslated=_S,
    publishedAt=_S, updatedAt=_S, publishedLabel=_S, reviewUrl=_S, reviewSource=_S,
    ownerResponseText=_S, ownerResponseDate=_S, ownerResponseUpdatedAt=_S,
    reviewImageUrls=_STRINGS, language=_S, translatedLanguage=_S, scrapedAt=_S,
    placeId=_S, cid=_S, fid=_S, placeUrl=_S, title=_S,
    reviewerProfilePhotoUrl=_S,
)
REVIEW_FIELDS = REVIEW.fieldNames()

# Back-filled from the other record when the preferred one has none.
RESPONSE_FIELDS = ["ownerResponseText", "ownerResponseDate", "ownerResponseUpdatedAt"]
# Some producers never write these, so a null gives way to the other record's value.
OPTIONAL_FIELDS = ["reviewerProfilePhotoUrl", "updatedAt"]

BRANCH_CONFIG = _struct(
    id=_S, name=_S, shortName=_S, location=_S, color=_S, googleLocationName=_S,
    cid=_S, placeId=_S, profileUrl=_S, searchQuery=_S, mapsSearchUrl=_S,
    aliases=_STRINGS, blockedTitles=_STRINGS, fid=_S, imageUrl=_S,
)

BRANCH_PUBLISHED = T.StructType(
    BRANCH_CONFIG.fields
    + _struct(
        currentReviewsCount=_L, currentRating=_D, placeUrl=_S,
        apifyReportedReviewsCount=_I, apifyReportedRating=_D,
    ).fields
)

META = _struct(
    mode=_S, generatedAt=_S, timezone=_S, source=_S, reviewCount=_L, actorId=_S, actorRunId=_S, sampled=_B,
)

DATASET = T.StructType([
    T.StructField("meta", META),
    T.StructField("branches", T.ArrayType(BRANCH_PUBLISHED)),
    T.StructField("reviews", T.ArrayType(REVIEW)),
])

RAW_ITEM = _struct(
    reviewId=_S, text=_S, textTranslated=_S, name=_S, reviewerUrl=_S,
    publishedAtDate=_S, publishedAt=_S, publishAt=_S, updatedAtDate=_S, scrapedAt=_S,
    reviewUrl=_S, reviewOrigin=_S, responseFromOwnerText=_S, responseFromOwnerDate=_S,
    originalLanguage=_S, language=_S, translatedLanguage=_S,
    placeId=_S, cid=_S, fid=_S, url=_S, title=_S, imageUrl=_S,
    stars=_S, rating=_S, totalScore=_S, reviewsCount=_S, reviewerNumberOfReviews=_S,
    isLocalGuide=_B, reviewImageUrls=_STRINGS,
)

PAGED_REVIEW = _struct(
    reviewId=_S, createTime=_S, updateTime=_S, starRating=_S, comment=_S,
    reviewer=_struct(displayName=_S, profilePhotoUrl=_S),
    reviewReply=_struct(comment=_S, updateTime=_S),
)

REVIEW_PAGE = _struct(
    branch_id=_S, page_no=_L, totalReviewCount=_L, averageRating=_D, nextPageToken=_S,
    reviews=T.ArrayType(PAGED_REVIEW),
)

LOCATION = _struct(
    account_name=_S, name=_S, title=_S, storeCode=_S, websiteUri=_S,
    metadata=_struct(placeId=_S, mapsUri=_S, newReviewUri=_S),
)

ACCOUNT = _struct(name=_S, accountName=_S, type=_S, accountType=_S)

ADDITIONS_COLUMNS = [
    "branch_id", "reviewer_name", "rating", "published_at", "comment", "owner_response_text",
    "owner_response_date", "review_url", "review_id", "is_local_guide", "reviewer_review_count",
    "reviewer_url", "language",
]
REMOVALS_COLUMNS = ["branch_id", "review_id", "reviewer_name", "published_at", "reason"]
ADDITIONS = T.StructType([T.StructField(c, _S) for c in ADDITIONS_COLUMNS])
REMOVALS = T.StructType([T.StructField(c, _S) for c in REMOVALS_COLUMNS])
