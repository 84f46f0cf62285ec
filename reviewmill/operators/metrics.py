"""Branch and portfolio figures.

All additive figures of a branch come from one pass over the reviews (``branch_partials``). The
portfolio is summed up from the branch rows, never from the reviews again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.dates import in_current_month, in_period, iso_timestamp, since
from reviewmill.functions.numbers import (
    clamp,
    first_number,
    five_stars_for_lift,
    one_star_impact,
    percentage,
    positive_or,
    ratio_or_zero,
    round_half_up_1,
)
from reviewmill.functions.predicates import (
    has_comment,
    has_response,
    is_low,
    is_one_star,
    is_positive,
)
from reviewmill.functions.text import first_nonempty

STARS = (1, 2, 3, 4, 5)
RATE_NAMES = {
    "response": "ownerResponse",
    "comment": "comment",
    "local_guide": "localGuide",
    "low_star": "lowStar",
    "positive": "positive",
}


def effective_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews as the dashboard sees them: scraping date for a missing date, 0 for an unreadable rating."""
    return (
        reviews.withColumn("rating", first_number("rating"))
        .withColumn("publishedAt", first_nonempty("publishedAt", "scrapedAt"))
        .withColumn("published_ts", iso_timestamp("publishedAt"))
    )


# --- single measures, all aggregates over a group of reviews -------------------------------------------


def star_counts(rating: str = "rating") -> list[Column]:
    """Five counts; a rating below 1 counts as one star, fractions count nowhere."""
    held = clamp(F.col(rating), 1, 5)
    return [F.count_if(held == level).alias(f"star_{level}") for level in STARS]


def count_since(as_of: datetime | Column, days: int, ts: str = "published_ts") -> Column:
    return F.count_if(since(ts, as_of, days))


def count_matching_since(as_of: datetime | Column, days: int, predicate: Column, ts: str = "published_ts") -> Column:
    return F.count_if(since(ts, as_of, days) & predicate)


def count_current_month(as_of: datetime | Column, zone: str, ts: str = "published_ts") -> Column:
    return F.count_if(in_current_month(ts, as_of, zone))


def period_measures(name: str, as_of: datetime | Column, offset: int, days: int) -> list[Column]:
    """Count, and count and sum of the positive ratings, in a half-open period."""
    inside = in_period("published_ts", as_of, offset, days)
    rated = inside & (F.col("rating") > 0)
    return [
        F.count_if(inside).alias(f"{name}_count"),
        F.count_if(rated).alias(f"{name}_rated"),
        F.coalesce(F.sum(F.when(rated, F.col("rating"))), F.lit(0)).alias(f"{name}_sum"),
    ]


def engagement_measures() -> list[Column]:
    return [
        F.count_if(has_response()).alias("response_count"),
        F.count_if(has_comment()).alias("comment_count"),
        F.count_if(F.coalesce("isLocalGuide", F.lit(False))).alias("local_guide_count"),
        F.count_if(is_low()).alias("low_star_count"),
        F.count_if(is_positive()).alias("positive_count"),
    ]


def total_measures() -> list[Column]:
    rated = F.col("rating") > 0
    return [
        F.count(F.lit(1)).alias("tracked"),
        F.count_if(rated).alias("rated"),
        F.coalesce(F.sum(F.when(rated, F.col("rating"))), F.lit(0)).alias("rating_sum"),
    ]


# --- branch level ---------------------------------------------------------------------------------------


def branch_partials(reviews: DataFrame, as_of: datetime | Column, zone: str) -> DataFrame:
    """Every additive figure per branch in one hash aggregation with partial sums before the shuffle."""
    return reviews.groupBy("branchId").agg(
        *total_measures(),
        *star_counts(),
        count_since(as_of, 7).alias("last_7_days"),
        count_since(as_of, 30).alias("last_30_days"),
        count_current_month(as_of, zone).alias("month_to_date"),
        *engagement_measures(),
        *period_measures("p7", as_of, 0, 7),
        *period_measures("p30", as_of, 0, 30),
        *period_measures("prev30", as_of, 30, 30),
        count_matching_since(as_of, 7, is_one_star()).alias("one_star_7_days"),
        F.max("published_ts").alias("latest_ts"),
    )


def _with_branches(branches: DataFrame, partials: DataFrame) -> DataFrame:
    """Left join that keeps branches without reviews; their figures are 0."""
    joined = branches.join(partials, branches["id"] == partials["branchId"], "left").drop("branchId")
    figures = [c for c in partials.columns if c not in ("branchId", "latest_ts")]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in figures})


def _mean(prefix: str) -> Column:
    return ratio_or_zero(F.col(f"{prefix}_sum"), F.col(f"{prefix}_rated"))


def reported_or_computed(branches: DataFrame, partials: DataFrame, published: bool = False) -> DataFrame:
    """Reported count and rating where usable, else the computed ones.

    ``published`` rounds the computed rating to one decimal, as the publishing jobs store it.
    """
    rows = _with_branches(branches, partials)
    names = set(rows.columns)
    none = F.lit(None).cast("double")
    mean = ratio_or_zero(F.col("rating_sum"), F.col("rated"))
    mean = round_half_up_1(mean) if published else mean
    reported_count = F.col("currentReviewsCount") if "currentReviewsCount" in names else none
    reported_rating = F.col("currentRating") if "currentRating" in names else none
    return rows.withColumns(
        {
            "currentReviewsCount": positive_or(reported_count, F.col("tracked")).cast("bigint"),
            "currentRating": positive_or(reported_rating, mean),
        }
    )


def scorecard(branches: DataFrame, partials: DataFrame, published: bool = False) -> DataFrame:
    """All figures of a branch, one row per configured branch."""
    rows = reported_or_computed(branches, partials, published)
    rows = rows.withColumns(
        {f"{name}_rate": percentage(f"{name}_count", "tracked") for name in RATE_NAMES}
    ).withColumns(
        {
            "p7_rating": _mean("p7"),
            "p30_rating": _mean("p30"),
            "prev30_rating": _mean("prev30"),
        }
    )
    rows = rows.withColumns(
        {
            "rating_delta_30": F.col("p30_rating") - F.col("prev30_rating"),
            "volume_delta_30": F.col("p30_count") - F.col("prev30_count"),
            "one_star_effect": one_star_impact("currentRating", "currentReviewsCount", "one_star_7_days"),
            "five_stars_for_lift": five_stars_for_lift("currentRating", "currentReviewsCount"),
        }
    )
    return portfolio_share(rows)


def portfolio_share(cards: DataFrame) -> DataFrame:
    """Share of each branch in all reviews.

    The window runs over branch rows; a subquery for the total would read the reviews a second time.
    """
    total = F.sum("currentReviewsCount").over(Window.partitionBy())
    return cards.withColumn("share_of_portfolio", percentage(F.col("currentReviewsCount"), total))


def branch_scorecard(
    reviews: DataFrame, branches: DataFrame, as_of: datetime | Column, zone: str, published: bool = False
) -> DataFrame:
    return scorecard(branches, branch_partials(reviews, as_of, zone), published)


def portfolio_summary(cards: DataFrame) -> DataFrame:
    """One row over all branches, from the branch rows alone."""
    additive = [
        "tracked", "rated", "rating_sum", "last_7_days", "last_30_days", *[f"star_{s}" for s in STARS],
        *[f"{name}_count" for name in RATE_NAMES],
        *[f"{p}_{m}" for p in ("p30", "prev30") for m in ("count", "rated", "sum")],
    ]
    weight = F.col("currentReviewsCount")
    one = cards.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("reported"),
        F.coalesce(F.sum(F.col("currentRating") * weight), F.lit(0.0)).alias("weighted"),
        F.max("latest_ts").alias("latest_ts"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in additive],
    )
    counted = F.col("reported") > 0
    one = one.withColumns(
        {
            "total_reviews": F.when(counted, F.col("reported")).otherwise(F.col("tracked")),
            "current_rating": F.when(counted, F.col("weighted") / F.col("reported")).otherwise(
                ratio_or_zero(F.col("rating_sum"), F.col("rated"))
            ),
            "p30_rating": _mean("p30"),
            "prev30_rating": _mean("prev30"),
            **{f"{name}_rate": percentage(f"{name}_count", "tracked") for name in RATE_NAMES},
        }
    )
    return one.withColumns(
        {
            "rating_delta_30": F.col("p30_rating") - F.col("prev30_rating"),
            "volume_delta_30": F.col("p30_count") - F.col("prev30_count"),
        }
    )


def star_mix_rollup(cards: DataFrame) -> DataFrame:
    """Star counts per branch and for all locations, with rating and total."""
    weight = F.col("currentReviewsCount")
    rating = F.sum(F.col("currentRating") * weight) / F.sum(weight)
    computed = ratio_or_zero(F.sum("rating_sum"), F.sum("rated"))
    rolled = cards.rollup("id").agg(
        *[F.sum(f"star_{s}").alias(f"star_{s}") for s in STARS],
        F.when(F.sum(weight) > 0, rating).otherwise(computed).alias("rolled_rating"),
        F.max("currentRating").alias("own_rating"),
        F.when(F.sum(weight) > 0, F.sum(weight)).otherwise(F.sum("tracked")).alias("total"),
        F.grouping("id").alias("all_rows"),
    )
    overall = F.col("all_rows") == 1
    return rolled.select(
        F.when(overall, F.lit("All locations")).otherwise(F.col("id")).alias("label"),
        *[f"star_{s}" for s in STARS],
        F.when(overall, F.col("rolled_rating")).otherwise(F.col("own_rating")).alias("rating"),
        "total",
    )


def leaderboard(cards: DataFrame) -> DataFrame:
    """Rank by rating, last 30 days, total; ties keep the configured order. Runs on branch rows only."""
    order = Window.orderBy(
        F.desc("currentRating"), F.desc("p30_count"), F.desc("currentReviewsCount"), "branch_ord"
    )
    return cards.withColumn("rank", F.row_number().over(order))


def overall_latest(reviews: DataFrame, meta: DataFrame) -> DataFrame:
    """``latest_at`` of the whole dataset: the newest review's date, else when the dataset was generated. One row."""
    newest = reviews.agg(F.max_by("publishedAt", "published_ts").alias("newest"))
    made = meta.agg(F.first("generatedAt").alias("made"))
    return newest.join(made).select(first_nonempty("newest", "made").alias("latest_at"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Newest review per branch; among equal instants the first in stored order.

    Reviews are read once; every task keeps one row per branch before the shuffle.
    """
    order = Window.partitionBy("branchId").orderBy(F.desc("published_ts"), F.asc_nulls_last("ord"))
    known = reviews.where("branchId is not null and published_ts is not null")
    return known.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def branch_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("branchId").agg(F.count(F.lit(1)).alias("n"))


def count_map(rows: DataFrame, name: str) -> DataFrame:
    """One row with a map of branch to count. The map has one entry per branch."""
    entries = branch_counts(rows).agg(F.collect_list(F.struct("branchId", "n")).alias("e"))
    return entries.select(F.map_from_entries("e").alias(name))


def missing_branches(branches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Branches without a single review."""
    seen = reviews.select(F.col("branchId").alias("id")).distinct()
    return branches.join(seen, "id", "left_anti")


def summary_kpis(portfolio: DataFrame) -> DataFrame:
    """The seven headline figures as label and value rows."""
    # Labels of the headline figures.
    figures = [
        ("Total GBP reviews", "total_reviews"),
        ("Average rating", "current_rating"),
        ("Reviews in past 30 days", "last_30_days"),
        ("Past 30-day rating", "p30_rating"),
        ("Response rate", "response_rate"),
        ("Comment rate", "comment_rate"),
        ("Local Guide share", "local_guide_rate"),
    ]
    rows = portfolio.select(*[F.col(c).cast("double").alias(label) for label, c in figures])
    return rows.unpivot([], [label for label, _ in figures], "label", "value")


def usage_projection(
    branches: DataFrame,
    max_reviews: int = 20,
    billing_days: int = 31,
    price_per_1000: float = 0.60,
    warn_above: int = 5000,
    stop_above: int = 6500,
    cap: int = 20,
    allow_higher: bool = False,
) -> DataFrame:
    """Projected scraping volume and cost of a run, with the guard's verdict."""
    daily = F.col("branches") * max_reviews
    monthly = daily * billing_days
    cost = F.bround((monthly / 1000 * price_per_1000), 2)
    over_cap = F.lit(max_reviews > cap and not allow_higher)
    verdict = (
        F.when(over_cap, "blocked: cap").when(monthly > stop_above, "blocked: volume").when(monthly > warn_above, "warning").otherwise("ok")
    )
    return branches.agg(F.count(F.lit(1)).alias("branches")).select(
        "branches",
        daily.alias("daily_reviews"),
        monthly.alias("monthly_reviews"),
        cost.alias("monthly_cost"),
        verdict.alias("status"),
    )
