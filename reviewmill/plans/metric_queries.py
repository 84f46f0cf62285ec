"""Registered queries: ratings, scorecards, buckets, rankings and the explorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions import display as d
from reviewmill.functions.dates import month_key, week_start, zoned_date
from reviewmill.functions.numbers import (
    avg_positive,
    five_stars_for_lift,
    lift_target,
    one_star_impact,
    percentage,
    ratio_or_zero,
)
from reviewmill.functions.predicates import is_one_star
from reviewmill.operators import branches as dim
from reviewmill.operators import metrics, periods
from reviewmill.operators.explorer import RANGES, date_range, explore, keyword
from reviewmill.operators.merge import newest_first
from reviewmill.operators.ranking import attention_list, cap_newest_per_branch
from reviewmill.plans.binding import AS_OF, FETCHED_AT, ZONE, branch_dim, planned_branches, review_rows
from reviewmill.plans.oracle import AS_OF as SQL_AS_OF
from reviewmill.plans.oracle import avg_pos, pct, round1, with_reviews
from reviewmill.plans.registry import query

# Columns the scorecard reads; everything else stays in the files.
CARD_COLUMNS = ("rating", "isLocalGuide", "ownerResponseText", "comment", "commentTranslated", "published_ts")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.branch_scorecard(
        review_rows(spark, sf_dir, *CARD_COLUMNS), branch_dim(spark, sf_dir), AS_OF, ZONE, published=True
    )


def _r6(name: str) -> Column:
    return F.round(F.col(name).cast("double"), 6).alias(name)


def _big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


STARS_SQL = ",\n".join(
    f"count(*) filter (where least(greatest(rating, 1), 5) = {s}) as star_{s}" for s in metrics.STARS
)


def _period_sql(name: str, start: int, end: int) -> str:
    inside = f"ts >= {SQL_AS_OF} - interval {start} day and ts < {SQL_AS_OF} - interval {end} day"
    return (
        f"count(*) filter (where {inside}) as {name}_count, {avg_pos('rating', inside)} as {name}_rating"
    )


PARTIALS_SQL = f"""
partials as (
  select branch_id, count(*) as tracked, {avg_pos()} as mean, {STARS_SQL},
    count(*) filter (where ts >= {SQL_AS_OF} - interval 7 day) as last_7_days,
    count(*) filter (where ts >= {SQL_AS_OF} - interval 30 day) as last_30_days,
    count(*) filter (where date_trunc('month', ts + interval 2 hour)
      = date_trunc('month', {SQL_AS_OF} + interval 2 hour)) as month_to_date,
    count(*) filter (where trim(response) <> '') as response_count,
    count(*) filter (where trim(case when comment <> '' then comment else translated end) <> '') as comment_count,
    count(*) filter (where local_guide) as local_guide_count,
    count(*) filter (where rating <= 2) as low_star_count,
    count(*) filter (where rating >= 4) as positive_count,
    {_period_sql('p7', 7, 0)}, {_period_sql('p30', 30, 0)}, {_period_sql('prev30', 60, 30)},
    count(*) filter (where ts >= {SQL_AS_OF} - interval 7 day and rating = 1) as one_star_7_days,
    max(ts) as latest_ts
  from reviews group by branch_id
)"""

_FIGURES = [
    "tracked", "mean", *[f"star_{s}" for s in metrics.STARS], "last_7_days", "last_30_days", "month_to_date",
    *[f"{n}_count" for n in metrics.RATE_NAMES], *[f"{p}_{m}" for p in ("p7", "p30", "prev30") for m in ("count", "rating")],
    "one_star_7_days",
]
_ZERO_FILLED = ", ".join(f"coalesce(p.{c}, 0) as {c}" for c in _FIGURES)

# Branches without reviews stay, with zero figures.
CARDS_SQL = f"""
cards0 as (
  select b.*, {_ZERO_FILLED}, p.latest_ts, coalesce(p.tracked, 0) as n, {round1('coalesce(p.mean, 0.0)')} as r
  from branch_dim b left join partials p on p.branch_id = b.id
),
cards as (
  select *,
    {pct('response_count', 'tracked')} as response_rate, {pct('comment_count', 'tracked')} as comment_rate,
    {pct('local_guide_count', 'tracked')} as local_guide_rate, {pct('low_star_count', 'tracked')} as low_star_rate,
    {pct('positive_count', 'tracked')} as positive_rate,
    p30_rating - prev30_rating as rating_delta_30, p30_count - prev30_count as volume_delta_30,
    case when r = 0 or n = 0 or one_star_7_days = 0 or n <= one_star_7_days then 0.0
      else r - (r * n - one_star_7_days) / (n - one_star_7_days) end as one_star_effect,
    case when r = 0 or n = 0 or r >= 4.95 then 0
      else cast(greatest(0, ceil(cast(n as double) * (least(5.0::double, {round1('r + 0.1::double')}) - r)
        / (5.0::double - least(5.0::double, {round1('r + 0.1::double')})))) as bigint) end as five_stars,
    {pct('n', 'sum(n) over ()')} as share
  from cards0
)"""


def _cards_sql(body: str) -> str:
    return with_reviews(body, PARTIALS_SQL, CARDS_SQL)


@query(
    "branch_rating",
    with_reviews(
        f"""select b.id as branch_id, count(r.id) as n, {round1(avg_pos('r.rating'))} as rating
        from branch_dim b left join reviews r on r.branch_id = b.id group by b.id"""
    ),
)
def branch_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = dim.branch_rating(review_rows(spark, sf_dir, "rating"), branch_dim(spark, sf_dir))
    return rated.select(F.col("id").alias("branch_id"), F.col("computedCount").alias("n"), F.col("computedRating").alias("rating"))


@query(
    "branch_scorecard",
    _cards_sql(
        """select id as branch_id, n as total_reviews, r as current_rating, tracked, star_1, star_2, star_3, star_4,
        star_5, last_7_days, last_30_days, month_to_date, response_count, comment_count, local_guide_count,
        low_star_count, positive_count, round(response_rate, 6) as response_rate, round(comment_rate, 6) as comment_rate,
        round(local_guide_rate, 6) as local_guide_rate, round(low_star_rate, 6) as low_star_rate,
        round(positive_rate, 6) as positive_rate, p7_count, p30_count, prev30_count,
        round(p7_rating, 6) as p7_rating, round(p30_rating, 6) as p30_rating, round(prev30_rating, 6) as prev30_rating,
        round(rating_delta_30, 6) as rating_delta_30, volume_delta_30, one_star_7_days,
        round(one_star_effect, 6) as one_star_effect, five_stars as five_stars_for_lift,
        round(share, 6) as share_of_portfolio, strftime(latest_ts, '%Y-%m-%dT%H:%M:%SZ') as latest_at from cards"""
    ),
)
def branch_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every figure of a branch from one pass over the reviews."""
    return _cards(spark, sf_dir).select(
        F.col("id").alias("branch_id"),
        F.col("currentReviewsCount").alias("total_reviews"),
        F.col("currentRating").alias("current_rating"),
        *_big("tracked", *[f"star_{s}" for s in metrics.STARS], "last_7_days", "last_30_days", "month_to_date"),
        *_big("response_count", "comment_count", "local_guide_count", "low_star_count", "positive_count"),
        *[_r6(f"{n}_rate") for n in metrics.RATE_NAMES],
        *_big("p7_count", "p30_count", "prev30_count"),
        *[_r6(n) for n in ("p7_rating", "p30_rating", "prev30_rating", "rating_delta_30")],
        *_big("volume_delta_30", "one_star_7_days"),
        _r6("one_star_effect"),
        *_big("five_stars_for_lift"),
        _r6("share_of_portfolio"),
        F.date_format("latest_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("latest_at"),
    )


@query("branch_counts", with_reviews("select branch_id, count(*) as n from reviews group by branch_id"))
def branch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.branch_counts(review_rows(spark, sf_dir))
    return counts.withColumnRenamed("branchId", "branch_id")


@query(
    "missing_branches",
    with_reviews(
        """select id as branch_id from (select id from branch_dim union all select 'planned-' || id from branch_dim)
        where id not in (select branch_id from reviews)"""
    ),
)
def missing_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches without any review, planned ones among them."""
    missing = metrics.missing_branches(planned_branches(spark, sf_dir), review_rows(spark, sf_dir))
    return missing.select(F.col("id").alias("branch_id"))


@query("avg_positive", with_reviews(f"select branch_id, round({avg_pos()}, 6) as mean from reviews group by branch_id"))
def avg_positive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "rating")
    return reviews.groupBy(F.col("branchId").alias("branch_id")).agg(F.round(avg_positive("rating"), 6).alias("mean"))


@query(
    "reported_or_computed",
    with_reviews(
        """select id as branch_id,
          case when branch_ord % 4 > 1 then branch_ord * 10 + 5 else coalesce(tracked, 0) end::bigint as total_reviews,
          round(case when branch_ord % 3 = 1 and branch_ord > 0 then branch_ord / 10.0 else coalesce(mean, 0.0) end, 6)::double as rating
        from branch_dim left join partials on branch_id = id""",
        PARTIALS_SQL,
    ),
)
def reported_or_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some branches report usable figures, some report 0, text or nothing."""
    order = F.col("branch_ord")
    branches = branch_dim(spark, sf_dir).withColumns(
        {
            "currentReviewsCount": F.when(order % 4 == 0, F.lit(None)).when(order % 4 == 1, "0").otherwise((order * 10 + 5).cast("string")),
            "currentRating": F.when(order % 3 == 0, "n/a").when(order % 3 == 1, (order / 10).cast("string")).otherwise("-1"),
        }
    )
    partials = review_rows(spark, sf_dir, "rating").groupBy("branchId").agg(*metrics.total_measures())
    rows = metrics.reported_or_computed(branches, partials)
    return rows.select(
        F.col("id").alias("branch_id"),
        F.col("currentReviewsCount").alias("total_reviews"),
        F.round("currentRating", 6).alias("rating"),
    )


PORTFOLIO_SQL = f"""
portfolio as (
  select cast(sum(n) as bigint) as total_reviews, sum(r * n) / sum(n) as current_rating,
    cast(sum(last_30_days) as bigint) as last_30_days, cast(sum(last_7_days) as bigint) as last_7_days,
    cast(sum(tracked) as bigint) as tracked,
    {pct('sum(response_count)', 'sum(tracked)')} as response_rate, {pct('sum(comment_count)', 'sum(tracked)')} as comment_rate,
    {pct('sum(local_guide_count)', 'sum(tracked)')} as local_guide_rate,
    {pct('sum(low_star_count)', 'sum(tracked)')} as low_star_rate, {pct('sum(positive_count)', 'sum(tracked)')} as positive_rate,
    cast(sum(volume_delta_30) as bigint) as volume_delta_30, max(latest_ts) as latest_ts
  from cards
),
overall as (select {_period_sql('p30', 30, 0)}, {_period_sql('prev30', 60, 30)} from reviews)"""


@query(
    "portfolio_summary",
    with_reviews(
        """select total_reviews, round(current_rating, 6) as current_rating, last_30_days, last_7_days, tracked,
        round(response_rate, 6) as response_rate, round(comment_rate, 6) as comment_rate,
        round(local_guide_rate, 6) as local_guide_rate, round(low_star_rate, 6) as low_star_rate,
        round(positive_rate, 6) as positive_rate, volume_delta_30, p30_count,
        round(p30_rating, 6) as p30_rating, round(p30_rating - prev30_rating, 6) as rating_delta_30,
        strftime(latest_ts, '%Y-%m-%dT%H:%M:%SZ') as latest_at
        from portfolio, overall""",
        PARTIALS_SQL,
        CARDS_SQL,
        PORTFOLIO_SQL,
    ),
)
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = metrics.portfolio_summary(_cards(spark, sf_dir))
    return one.select(
        *_big("total_reviews"), _r6("current_rating"), *_big("last_30_days", "last_7_days", "tracked"),
        *[_r6(f"{n}_rate") for n in metrics.RATE_NAMES],
        *_big("volume_delta_30", "p30_count"), _r6("p30_rating"), _r6("rating_delta_30"),
        F.date_format("latest_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("latest_at"),
    )


@query("star_mix", with_reviews(f"select branch_id, {STARS_SQL} from reviews group by branch_id"))
def star_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "rating")
    return reviews.groupBy(F.col("branchId").alias("branch_id")).agg(*metrics.star_counts())


@query(
    "star_mix_rollup",
    _cards_sql(
        """select case when grouping(id) = 1 then 'All locations' else id end as label,
        cast(sum(star_1) as bigint) as star_1, cast(sum(star_2) as bigint) as star_2, cast(sum(star_3) as bigint) as star_3,
        cast(sum(star_4) as bigint) as star_4, cast(sum(star_5) as bigint) as star_5,
        round(case when sum(n) > 0 then sum(r * n) / sum(n) else 0.0 end, 6) as rating, cast(sum(n) as bigint) as total
        from cards group by rollup (id)"""
    ),
)
def star_mix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "rating")
    partials = reviews.groupBy("branchId").agg(*metrics.total_measures(), *metrics.star_counts())
    cards = metrics.reported_or_computed(branch_dim(spark, sf_dir), partials, published=True)
    rows = metrics.star_mix_rollup(cards)
    return rows.select("label", *_big(*[f"star_{s}" for s in metrics.STARS]), _r6("rating"), *_big("total"))


@query(
    "recent_counts",
    with_reviews(
        f"""select branch_id, count(*) filter (where ts >= {SQL_AS_OF} - interval 7 day) as last_7_days,
        count(*) filter (where ts >= {SQL_AS_OF} - interval 30 day) as last_30_days from reviews group by branch_id"""
    ),
)
def recent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "published_ts")
    return reviews.groupBy(F.col("branchId").alias("branch_id")).agg(
        metrics.count_since(AS_OF, 7).alias("last_7_days"), metrics.count_since(AS_OF, 30).alias("last_30_days")
    )


@query(
    "recent_one_star",
    with_reviews(
        f"""select branch_id, count(*) filter (where ts >= {SQL_AS_OF} - interval 7 day and rating = 1) as n
        from reviews group by branch_id"""
    ),
)
def recent_one_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "published_ts", "rating")
    return reviews.groupBy(F.col("branchId").alias("branch_id")).agg(
        metrics.count_matching_since(AS_OF, 7, is_one_star()).alias("n")
    )


@query(
    "month_to_date",
    with_reviews(
        f"""select branch_id, count(*) filter (where date_trunc('month', ts + interval 2 hour)
        = date_trunc('month', {SQL_AS_OF} + interval 2 hour)) as n from reviews group by branch_id"""
    ),
)
def month_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "published_ts")
    return reviews.groupBy(F.col("branchId").alias("branch_id")).agg(metrics.count_current_month(AS_OF, ZONE).alias("n"))


@query(
    "period_stats",
    with_reviews(
        f"""select branch_id, p7_count, round(p7_rating, 6) as p7_rating, p30_count, round(p30_rating, 6) as p30_rating,
        prev30_count, round(prev30_rating, 6) as prev30_rating from partials""",
        PARTIALS_SQL,
    ),
)
def period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "published_ts", "rating")
    spans = (("p7", 0, 7), ("p30", 0, 30), ("prev30", 30, 30))
    stats = reviews.groupBy(F.col("branchId").alias("branch_id")).agg(
        *[m for name, offset, days in spans for m in metrics.period_measures(name, AS_OF, offset, days)]
    )
    return stats.select(
        "branch_id",
        *[
            c
            for name, _, _ in spans
            for c in (F.col(f"{name}_count"), F.round(ratio_or_zero(F.col(f"{name}_sum"), F.col(f"{name}_rated")), 6).alias(f"{name}_rating"))
        ],
    )


@query(
    "period_deltas",
    with_reviews(
        """select branch_id, round(round(p30_rating, 6) - round(prev30_rating, 6), 5) as rating_delta,
        p30_count - prev30_count as volume_delta from partials""",
        PARTIALS_SQL,
    ),
)
def period_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = period_stats(spark, sf_dir)
    return stats.select(
        "branch_id",
        F.round(F.col("p30_rating") - F.col("prev30_rating"), 5).alias("rating_delta"),
        (F.col("p30_count") - F.col("prev30_count")).alias("volume_delta"),
    )


@query(
    "engagement_rates",
    _cards_sql(
        """select id as branch_id, response_count, comment_count, local_guide_count, low_star_count, positive_count,
        round(response_rate, 6) as response_rate, round(comment_rate, 6) as comment_rate,
        round(local_guide_rate, 6) as local_guide_rate, round(low_star_rate, 6) as low_star_rate,
        round(positive_rate, 6) as positive_rate from cards where tracked > 0"""
    ),
)
def engagement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "rating", "isLocalGuide", "ownerResponseText", "comment", "commentTranslated")
    counts = reviews.groupBy(F.col("branchId").alias("branch_id")).agg(
        F.count(F.lit(1)).alias("tracked"), *metrics.engagement_measures()
    )
    return counts.select(
        "branch_id",
        *[f"{n}_count" for n in metrics.RATE_NAMES],
        *[F.round(percentage(f"{n}_count", "tracked"), 6).alias(f"{n}_rate") for n in metrics.RATE_NAMES],
    )


@query(
    "latest_review",
    with_reviews(
        """select branch_id, id, published_at, rating from reviews
        qualify row_number() over (partition by branch_id order by ts desc, review_key, tie) = 1"""
    ),
)
def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "id", "reviewKey", "rating", "published_ts", "publishedAt", "ord")
    newest = metrics.latest_reviews(reviews)
    return newest.select(F.col("branchId").alias("branch_id"), "id", F.col("publishedAt").alias("published_at"), *_big("rating"))


@query(
    "effective_reviews",
    with_reviews(
        f"""select branch_id, count(*) as n, sum(rating)::double as rating_sum, count(*) filter (where length(id) % 3 = 0) as undated,
          max(case when length(id) % 3 = 0 then '{FETCHED_AT}' else published_at end) as newest,
          (select max(case when length(id) % 3 = 0 then '{FETCHED_AT}' else published_at end) from reviews) as latest_at
        from reviews group by branch_id"""
    ),
)
def effective_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as readers see them: without a date the one of their scraping counts; newest per branch and over all."""
    rows = review_rows(spark, sf_dir, "id", "rating", "publishedAt", "scrapedAt")
    undated = F.length("id") % 3 == 0
    rows = rows.withColumn("publishedAt", F.when(undated, "").otherwise(F.col("publishedAt"))).withColumn("rating", F.col("rating").cast("string"))
    seen = metrics.effective_reviews(rows)
    latest = metrics.overall_latest(seen, spark.range(1).select(F.lit("never").alias("generatedAt")))
    per_branch = seen.groupBy(F.col("branchId").alias("branch_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating_sum"), F.count_if(undated).alias("undated"), F.max("publishedAt").alias("newest")
    )
    return per_branch.join(latest)


@query("portfolio_share", _cards_sql("select id as branch_id, n as total_reviews, round(share, 6) as share from cards"))
def portfolio_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    partials = review_rows(spark, sf_dir, "rating").groupBy("branchId").agg(*metrics.total_measures())
    cards = metrics.portfolio_share(metrics.reported_or_computed(branch_dim(spark, sf_dir), partials, published=True))
    return cards.select(
        F.col("id").alias("branch_id"),
        F.col("currentReviewsCount").alias("total_reviews"),
        F.round("share_of_portfolio", 6).alias("share"),
    )


def _spine_sql(kind: str) -> str:
    local = f"({SQL_AS_OF} + interval 2 hour)"
    if kind == periods.WEEK:
        return f"""spine as (select i + 1 as pos, cast(date_trunc('week', {local}) as date) - cast(7 * (7 - i) as int) as start
          from range(8) t(i))"""
    return f"""spine as (select i + 1 as pos, cast(date_trunc('month', {local}) - to_months(cast(5 - i as int)) as date) as start
          from range(6) t(i))"""


def _buckets_sql(kind: str) -> str:
    key = "'%Y-%m-%d'" if kind == periods.WEEK else "'%Y-%m'"
    return f"""{_spine_sql(kind)},
    buckets as (
      select b.branch_ord, b.id as branch_id, s.pos, strftime(s.start, {key}) as bucket, count(r.id) as n,
        coalesce(avg(r.rating), 0.0) as average
      from branch_dim b cross join spine s left join reviews r on r.branch_id = b.id
        and cast(date_trunc('{kind}', r.ts + interval 2 hour) as date) = s.start
      group by all
    )"""


def _buckets(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "rating", "published_ts")
    return periods.bucket_reviews(reviews, branch_dim(spark, sf_dir), AS_OF, ZONE, kind)


def _bucket_query(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _buckets(spark, sf_dir, kind).select(
            F.col("branchId").alias("branch_id"), *_big("pos"), "bucket", "n", _r6("average")
        )

    return run


def _pivot_query(kind: str, n: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = periods.calendar_table(_buckets(spark, sf_dir, kind), n)
        cells = [c for p in range(1, n + 1) for c in (*_big(f"n_{p}"), _r6(f"average_{p}"))]
        return table.select(F.col("branchId").alias("branch_id"), *cells, *_big("total_n"), _r6("total_average"))

    return run


for _kind, _name, _n in ((periods.WEEK, "weekly", periods.WEEKS_SHOWN), (periods.MONTH, "monthly", periods.MONTHS_SHOWN)):
    query(
        f"{_name}_buckets",
        with_reviews("select branch_id, pos, bucket, n, round(average, 6) as average from buckets", _buckets_sql(_kind)),
    )(_bucket_query(_kind))
    _cells = ", ".join(
        f"max(n) filter (where pos = {p}) as n_{p}, round(max(average) filter (where pos = {p}), 6) as average_{p}"
        for p in range(1, _n + 1)
    )
    query(
        f"{_name}_pivot",
        with_reviews(
            f"""select branch_id, {_cells}, cast(sum(n) as bigint) as total_n,
            round(case when sum(n) > 0 then sum(average * n) / sum(n) else 0.0 end, 6) as total_average
            from buckets group by branch_id""",
            _buckets_sql(_kind),
        ),
    )(_pivot_query(_kind, _n))


@query(
    "trend_scaled",
    with_reviews(
        """select branch_id, pos, n, round(n / greatest(max(n) over (partition by branch_id), 1) * 100, 6)::double as height
        from buckets""",
        _buckets_sql(periods.WEEK),
    ),
)
def trend_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = periods.trend_scaled(_buckets(spark, sf_dir, periods.WEEK))
    return scaled.select(F.col("branchId").alias("branch_id"), *_big("pos"), "n", _r6("height"))


@query(
    "branch_trend",
    with_reviews(
        "select branch_id, pos, bucket, n, round(average, 6) as average from buckets where branch_id = 'n7'",
        _buckets_sql(periods.MONTH),
    ),
)
def branch_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the focus branch only; the branch filter reaches the review side of the join."""
    focus = dim.focus_branch(branch_dim(spark, sf_dir), "n7")
    reviews = review_rows(spark, sf_dir, "rating", "published_ts")
    buckets = periods.bucket_reviews(reviews, focus, AS_OF, ZONE, periods.MONTH)
    return buckets.select(F.col("branchId").alias("branch_id"), *_big("pos"), "bucket", "n", _r6("average"))


@query(
    "period_spine",
    with_reviews(
        """select branch_id, kind, pos, case kind when 'week' then strftime(start, '%Y-%m-%d') else strftime(start, '%Y-%m') end as bucket,
          case kind when 'week' then strftime(start, '%b %-d') || ' to ' || strftime(start + 6, '%b %-d')
            else strftime(start, '%b %Y') end as label
        from spines""",
        """latest as (select branch_id, max(ts) + interval 2 hour as local_ts from reviews group by branch_id),
        spines as (
          select branch_id, 'week' as kind, i + 1 as pos,
            cast(date_trunc('week', local_ts) as date) - cast(7 * (7 - i) as int) as start from latest, range(8) t(i)
          union all
          select branch_id, 'month', i + 1, cast(date_trunc('month', local_ts) - to_months(cast(5 - i as int)) as date)
          from latest, range(6) t(i)
        )""",
    ),
)
def period_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spines that end at every branch's newest review."""
    reviews = review_rows(spark, sf_dir, "published_ts")
    clock = reviews.groupBy("branchId").agg(F.max("published_ts").alias("as_of"))
    clocks = clock.select("as_of").distinct()
    spines = [
        periods.period_spine(clocks, ZONE, kind).withColumn("kind", F.lit(kind)) for kind in (periods.WEEK, periods.MONTH)
    ]
    both = spines[0].unionByName(spines[1]).join(clock, "as_of")
    return both.select(F.col("branchId").alias("branch_id"), "kind", *_big("pos"), "bucket", "label")


@query(
    "zoned_day",
    with_reviews(
        """select branch_id, strftime(ts + interval 2 hour, '%Y-%m-%d') as day,
        strftime(date_trunc('week', ts + interval 2 hour), '%Y-%m-%d') as week, strftime(ts + interval 2 hour, '%Y-%m') as month,
        count(*) as n from reviews group by all"""
    ),
)
def zoned_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "published_ts")
    days = reviews.groupBy("branchId", zoned_date("published_ts", ZONE).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.select(
        F.col("branchId").alias("branch_id"),
        F.date_format("d", "yyyy-MM-dd").alias("day"),
        F.date_format(week_start("d"), "yyyy-MM-dd").alias("week"),
        month_key("d").alias("month"),
        "n",
    )


@query(
    "leaderboard",
    _cards_sql(
        """select row_number() over (order by r desc, p30_count desc, n desc, branch_ord) as rank, id as branch_id,
        r as rating, p30_count, n as total_reviews from cards"""
    ),
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = metrics.leaderboard(_cards(spark, sf_dir))
    return board.select(
        *_big("rank"), F.col("id").alias("branch_id"), F.col("currentRating").alias("rating"), *_big("p30_count"),
        F.col("currentReviewsCount").alias("total_reviews"),
    )


@query(
    "attention_top6",
    with_reviews(
        """select branch_id, id, rating, published_at,
        case when comment <> '' then comment when translated <> '' then translated
          else 'No written comment on this review.' end as comment
        from reviews where rating <= 3 and trim(response) = '' order by ts desc, review_key, tie limit 6"""
    ),
)
def attention_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(
        spark, sf_dir, "id", "reviewKey", "rating", "comment", "commentTranslated", "ownerResponseText", "published_ts", "publishedAt", "ord"
    )
    return attention_list(reviews).select(
        F.col("branchId").alias("branch_id"), "id", *_big("rating"), F.col("publishedAt").alias("published_at"),
        F.col("displayComment").alias("comment"),
    )


@query(
    "cap_newest_per_branch",
    with_reviews(
        """select branch_id, id, published_at, row_number() over (partition by branch_id order by ts desc, review_key, tie) as position
        from reviews where rating > 0 qualify position <= 20"""
    ),
)
def cap_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "id", "reviewKey", "rating", "published_ts", "publishedAt", "ord").where("rating > 0")
    capped = cap_newest_per_branch(reviews, 20, F.desc("published_ts"), F.col("ord"))
    return capped.select(F.col("branchId").alias("branch_id"), "id", F.col("publishedAt").alias("published_at"), *_big("position"))


@query(
    "newest_first",
    with_reviews(
        """select branch_id, id, published_at from reviews order by published_at desc, review_key, tie"""
    ),
)
def newest_first_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "id", "reviewKey", "published_ts", "publishedAt", "updatedAt", "scrapedAt", "ord")
    return newest_first(reviews).select(F.col("branchId").alias("branch_id"), "id", F.col("publishedAt").alias("published_at"))


KPI_SQL = " union all ".join(
    f"select '{label}' as label, round(cast({column} as double), 6) as value from portfolio, overall"
    for label, column in [
        ("Total GBP reviews", "total_reviews"),
        ("Average rating", "current_rating"),
        ("Reviews in past 30 days", "last_30_days"),
        ("Past 30-day rating", "p30_rating"),
        ("Response rate", "response_rate"),
        ("Comment rate", "comment_rate"),
        ("Local Guide share", "local_guide_rate"),
    ]
)


@query("summary_kpis", with_reviews(KPI_SQL, PARTIALS_SQL, CARDS_SQL, PORTFOLIO_SQL))
def summary_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    kpis = metrics.summary_kpis(metrics.portfolio_summary(_cards(spark, sf_dir)))
    return kpis.select("label", _r6("value"))


@query("rating_lift", _cards_sql("select id as branch_id, r as rating, n as total_reviews, five_stars as needed from cards"))
def rating_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    partials = review_rows(spark, sf_dir, "rating").groupBy("branchId").agg(*metrics.total_measures())
    cards = metrics.reported_or_computed(branch_dim(spark, sf_dir), partials, published=True)
    return cards.select(
        F.col("id").alias("branch_id"),
        F.col("currentRating").alias("rating"),
        F.col("currentReviewsCount").alias("total_reviews"),
        five_stars_for_lift("currentRating", "currentReviewsCount").alias("needed"),
    )


@query("one_star_impact", _cards_sql("select id as branch_id, one_star_7_days, round(one_star_effect, 9) as effect from cards"))
def one_star_impact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "rating", "published_ts")
    partials = reviews.groupBy("branchId").agg(
        *metrics.total_measures(), metrics.count_matching_since(AS_OF, 7, is_one_star()).alias("one_star_7_days")
    )
    cards = metrics.reported_or_computed(branch_dim(spark, sf_dir), partials, published=True)
    effect = one_star_impact("currentRating", "currentReviewsCount", "one_star_7_days")
    return cards.select(F.col("id").alias("branch_id"), *_big("one_star_7_days"), F.round(effect, 9).alias("effect"))


def _int_sql(x: str) -> str:
    return f"format('{{:,}}', cast({x} as bigint))"


def _rating_sql(x: str) -> str:
    return f"case when {x} <= 0 then '0.0' else printf('%.1f', {round1(x)}) end"


def _percent_sql(x: str) -> str:
    v = round1(x)
    return f"case when {v} = floor({v}) then cast(cast({v} as bigint) as varchar) else printf('%.1f', {v}) end || '%'"


def _signed_sql(x: str, magnitude: str, zero: str) -> str:
    return f"case when {x} > 0 then '+' || {magnitude} when {x} < 0 then '-' || {magnitude} else '{zero}' end"


def _decimal_sql(x: str) -> str:
    return _signed_sql(x, f"printf('%.2f', floor(abs({x}) * 100 + 0.5) / 100)", "0.00")


@query(
    "formatted_leaderboard",
    _cards_sql(
        f"""select row_number() over (order by r desc, p30_count desc, n desc, branch_ord) as rank, short_name as branch,
        {_rating_sql('r')} as rating, repeat('★', cast(floor(r + 0.5) as int)) || repeat('☆', 5 - cast(floor(r + 0.5) as int)) as stars,
        {_int_sql('n')} as total, {_percent_sql('share')} as share, {_int_sql('p30_count')} as last_30,
        {_signed_sql('volume_delta_30', _int_sql('abs(volume_delta_30)'), '0')} as volume_change,
        {_rating_sql('p30_rating')} as rating_30, {_decimal_sql('rating_delta_30')} as rating_change,
        {_percent_sql('response_rate')} as response_rate,
        coalesce(strftime(latest_ts + interval 2 hour, '%d ') || case when month(latest_ts + interval 2 hour) = 9 then 'Sept'
          else strftime(latest_ts + interval 2 hour, '%b') end || strftime(latest_ts + interval 2 hour, ' %Y'), 'No date') as latest
        from cards"""
    ),
)
def formatted_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = metrics.leaderboard(_cards(spark, sf_dir))
    return board.select(
        *_big("rank"),
        F.col("shortName").alias("branch"),
        d.show_rating("currentRating").alias("rating"),
        d.show_stars("currentRating").alias("stars"),
        d.show_integer("currentReviewsCount").alias("total"),
        d.show_percent("share_of_portfolio").alias("share"),
        d.show_integer("p30_count").alias("last_30"),
        d.show_signed_integer("volume_delta_30").alias("volume_change"),
        d.show_rating("p30_rating").alias("rating_30"),
        d.show_signed_decimal("rating_delta_30").alias("rating_change"),
        d.show_percent("response_rate").alias("response_rate"),
        d.show_date("latest_ts", ZONE).alias("latest"),
    )


@query(
    "branch_cards",
    _cards_sql(
        f"""select id as branch_id, {_rating_sql('r')} as rating, {_rating_sql(f'least(5.0, {round1("r + 0.1::double")})')} as target,
        case when p7_count > 0 then {_rating_sql('p7_rating')} else 'N/A' end as rating_7,
        case when p7_count > 0 then {_int_sql('p7_count')} || ' recent reviews' else 'No recent reviews' end as detail_7,
        case when r >= 4.95 then '0' else {_int_sql('five_stars')} end as needed,
        {_decimal_sql('one_star_effect')} as one_star,
        case when one_star_7_days > 0 then {_int_sql('one_star_7_days')} || ' one-star in last 7 days'
          else 'No one-star reviews in last 7 days' end as one_star_detail
        from cards"""
    ),
)
def branch_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _cards(spark, sf_dir)
    recent = F.col("p7_count") > 0
    return cards.select(
        F.col("id").alias("branch_id"),
        d.show_rating("currentRating").alias("rating"),
        d.show_rating(lift_target("currentRating")).alias("target"),
        F.when(recent, d.show_rating("p7_rating")).otherwise("N/A").alias("rating_7"),
        F.when(recent, F.concat(d.show_integer("p7_count"), F.lit(" recent reviews"))).otherwise("No recent reviews").alias("detail_7"),
        F.when(F.col("currentRating") >= 4.95, "0").otherwise(d.show_integer("five_stars_for_lift")).alias("needed"),
        d.show_signed_decimal("one_star_effect").alias("one_star"),
        F.when(F.col("one_star_7_days") > 0, F.concat(d.show_integer("one_star_7_days"), F.lit(" one-star in last 7 days")))
        .otherwise("No one-star reviews in last 7 days")
        .alias("one_star_detail"),
    )


@query(
    "explorer_filter",
    with_reviews(
        f"""select branch_id, id, rating, published_at from reviews
        where branch_id = 'n3' and rating = 5
          and cast(ts + interval 2 hour as date) >= cast({SQL_AS_OF} + interval 2 hour as date) - 29
          and contains(lower(concat_ws(' ', nullif(reviewer, ''), nullif(comment, ''), nullif(translated, ''),
            nullif(response, ''), nullif(branch_name, ''))), 'ring')"""
    ),
)
def explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(
        spark, sf_dir, "id", "reviewKey", "rating", "reviewerName", "comment", "commentTranslated", "ownerResponseText",
        "branchName", "published_ts", "publishedAt", "ord",
    )
    found = explore(reviews, AS_OF, ZONE, branch_id="n3", rating=5, range_name="last_30_days", search=" Ring ")
    return found.select(F.col("branchId").alias("branch_id"), "id", *_big("rating"), F.col("publishedAt").alias("published_at"))


_LOCAL_DAY = "cast(ts + interval 2 hour as date)"
_TODAY = f"cast({SQL_AS_OF} + interval 2 hour as date)"


@query(
    "date_range_filter",
    with_reviews(
        f"""select branch_id, count(*) as all_rows, count(*) filter (where {_LOCAL_DAY} = {_TODAY} - 1) as yesterday,
        count(*) filter (where {_LOCAL_DAY} >= {_TODAY} - 6) as last_7_days,
        count(*) filter (where {_LOCAL_DAY} >= {_TODAY} - 29) as last_30_days,
        count(*) filter (where date_trunc('month', {_LOCAL_DAY}) = date_trunc('month', {_TODAY})) as this_month
        from reviews group by branch_id"""
    ),
)
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "published_ts")
    return reviews.groupBy(F.col("branchId").alias("branch_id")).agg(
        *[
            F.count_if(date_range(name, AS_OF, ZONE)).alias("all_rows" if name == "all" else name)
            for name in RANGES
        ]
    )


@query(
    "keyword_search",
    """select doc_id, source, lang from documents
    where contains(lower(concat_ws(' ', nullif('Author of ' || source, ''), nullif(text, ''), nullif(lang, ''))), 'the en')""",
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comments; the wanted text may span the comment and the field after it."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        "source",
        "lang",
        F.concat(F.lit("Author of "), "source").alias("reviewerName"),
        F.col("text").alias("comment"),
        F.lit("").alias("commentTranslated"),
        F.lit(None).cast("string").alias("ownerResponseText"),
        F.col("lang").alias("branchName"),
    )
    return documents.where(keyword(" The EN")).select("doc_id", "source", "lang")

