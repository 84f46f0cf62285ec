"""Registered queries: every data check as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.operators import branches as dim
from reviewmill.operators import quality
from reviewmill.operators.dedup import first_per_key, last_per_key
from reviewmill.plans.binding import FETCHED_AT, branch_dim, planned_branches, review_rows, table
from reviewmill.plans.cleaning_queries import ADDITION_ERRORS_SQL, _typed_additions
from reviewmill.plans.merge_queries import _REMOVED, _removals
from reviewmill.plans.oracle import avg_pos, round1, with_branches, with_reviews
from reviewmill.plans.registry import query
from reviewmill.session import cut_lineage
from reviewmill.sources.csv_inputs import load_additions


@query(
    "check_unknown_branch",
    with_reviews("select review_key from reviews where branch_id not in (select id from branch_dim where branch_ord % 10 <> 3)"),
)
def check_unknown_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = branch_dim(spark, sf_dir).where("branch_ord % 10 <> 3")
    rows = quality.unknown_branches(review_rows(spark, sf_dir, "reviewKey"), known)
    return rows.select(F.col("reviewKey").alias("review_key"))


@query("check_duplicate_keys", with_reviews("select review_key, count(*) as n from reviews group by 1 having count(*) > 1"))
def check_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeated_keys(review_rows(spark, sf_dir, "reviewKey")).withColumnRenamed("reviewKey", "review_key")


@query("check_required", ADDITION_ERRORS_SQL)
def check_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mistakes in hand-typed rows, repeated ids as well."""
    typed = _typed_additions(spark, sf_dir).withColumn("row_id", F.monotonically_increasing_id())
    loaded = load_additions(cut_lineage(typed), branch_dim(spark, sf_dir), None, FETCHED_AT)
    return quality.input_errors(loaded).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("check_branch_ids", "select 's' || (s_suppkey % 70) as id, count(*) as n from supplier group by 1 having count(*) > 1")
def check_branch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 70).cast("string")).alias("id"))
    return quality.duplicate_branch_ids(ids)


@query("check_location_names", "select s_name as id from supplier where s_suppkey % 9 = 0")
def check_location_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("id"),
        F.when(F.col("s_suppkey") % 18 == 0, F.lit(" \t")).when(F.col("s_suppkey") % 9 == 0, F.lit(None)).otherwise(F.col("s_name")).alias("googleLocationName"),
    )
    return quality.missing_location_names(named).select("id")


@query("check_ratings", with_reviews("select review_key, rating from reviews where rating not between 1 and 5"))
def check_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.invalid_ratings(review_rows(spark, sf_dir, "reviewKey", "rating"))
    return rows.select(F.col("reviewKey").alias("review_key"), F.col("rating").cast("bigint").alias("rating"))


@query(
    "check_overfetch",
    """select items, expected, hard_limit from (
      select (select count(*) from lineitem) as items, count(*) * 20 as expected,
        count(*) * 20 + greatest(10, cast(floor(count(*) * 20 * 0.2) as bigint)) as hard_limit from supplier) where items > hard_limit""",
)
def check_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.overfetch(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), 20)
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("items", "expected", "hard_limit")])


@query(
    "check_shrink",
    with_reviews(
        """select (select count(*) from reviews) as current_rows,
          (select count(*) from reviews where review_key in (select review_key from removed)) as explained,
          (select count(distinct review_key) from reviews where review_key not in (select review_key from removed)) as merged_rows,
          (select count(*) from reviews where review_key not in (select review_key from removed)) as least_expected""",
        f"removed as (select distinct review_key from reviews where {_REMOVED})",
    ),
)
def check_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsing repeated keys loses more rows than the removals explain."""
    current = review_rows(spark, sf_dir, "id", "reviewKey", "published_ts", "ord")
    keys = _removals(spark, sf_dir)
    merged = last_per_key(current.join(keys.select("reviewKey"), "reviewKey", "left_anti"))
    return quality.shrunk(current, merged, keys)


_RATED_SQL = f"""
rated as (
  select b.*, count(r.id) as n, {round1(avg_pos('r.rating'))} as mean from branch_dim b left join reviews r on r.branch_id = b.id
  group by all
)"""


# The check passes over every later row of a key it has seen; rows come newest first.
_RATED_ONCE_SQL = f"""
once as (
  select * from reviews qualify row_number() over (partition by review_key order by ts desc, tie) = 1),
rated_once as (
  select b.*, count(r.id) as n, {round1(avg_pos('r.rating'))} as mean from branch_dim b left join once r on r.branch_id = b.id
  group by all
)"""


@query(
    "check_totals",
    with_reviews(
        """select 'review_count' as check, count(*) + 5 as declared, count(*) as held from reviews
        union all select 'branch_sum', (select cast(sum(n + branch_ord % 2) as bigint) from rated), count(*) from reviews""",
        _RATED_SQL,
    ),
)
def check_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = review_rows(spark, sf_dir, "rating")
    branches = dim.branch_rating(reviews, branch_dim(spark, sf_dir))
    branches = branches.withColumn("currentReviewsCount", F.col("computedCount") + F.col("branch_ord") % 2)
    meta = reviews.agg((F.count(F.lit(1)) + 5).alias("reviewCount")).withColumns({"mode": F.lit("Live "), "sampled": F.lit(False)})
    rows = quality.check_totals(meta, branches, reviews)
    return rows.select("check", F.col("declared").cast("bigint").alias("declared"), "held")


@query(
    "check_branch_consistency",
    with_reviews(
        """select id, tracked, declared, problem from (
          select *, unnest(list_filter([case when tracked <> declared then 'count' end,
            case when tracked > 0 and tracked = declared and branch_ord % 7 = 0 then 'rating' end,
            case when tracked = 0 then 'empty' end,
            case when tracked > 0 and branch_ord % 6 = 0 then 'name' end], lambda p: p is not null)) as problem
          from (select *, case when branch_ord % 8 = 7 then 0 else n end as tracked,
            n + case when branch_ord % 5 = 0 then 1 else 0 end as declared from rated_once))""",
        _RATED_ONCE_SQL,
    ),
)
def check_branch_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches with a wrong count, a wrong rating, another name or no reviews at all."""
    reviews = review_rows(spark, sf_dir, "reviewKey", "rating", "branchName", "published_ts", "ord")
    order = F.col("branch_ord")
    branches = dim.branch_rating(first_per_key(reviews), branch_dim(spark, sf_dir)).withColumns(
        {
            "currentReviewsCount": F.col("computedCount") + F.when(order % 5 == 0, 1).otherwise(0),
            "currentRating": F.col("computedRating") + F.when(order % 7 == 0, 0.3).otherwise(0.0),
            "name": F.when(order % 6 == 0, F.concat(F.lit("New "), "name")).otherwise(F.concat("name", F.lit(" "))),
        }
    )
    empty = branch_dim(spark, sf_dir).where("branch_ord % 8 = 7").select(F.col("id").alias("branchId"))
    held = reviews.join(empty, "branchId", "left_anti")
    rows = quality.branch_consistency(branches, held, "live", order="ord")
    return rows.select("id", "tracked", F.col("declared").cast("bigint").alias("declared"), "problem")


@query(
    "check_dataset",
    with_reviews(
        """select 'duplicate branch id' as problem, id as subject from branch_dim where branch_ord % 9 = 4
        union all select 'unknown branch', review_key from reviews where branch_id in (select id from branch_dim where branch_ord % 10 = 3 and branch_ord <> 13)
        union all select 'duplicate review key', review_key from reviews
          where branch_id not in (select id from branch_dim where branch_ord % 10 = 3 and branch_ord <> 13) group by review_key having count(*) > 1"""
    ),
)
def check_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = branch_dim(spark, sf_dir)
    listed = branches.where("branch_ord % 10 <> 3").unionByName(branches.where("branch_ord % 9 = 4"))
    held = listed.unionByName(branches.where("branch_ord % 9 = 4 and branch_ord % 10 = 3"))
    reviews = review_rows(spark, sf_dir, "reviewKey")
    return quality.check_dataset(held, reviews)


@query(
    "check_coverage",
    with_branches(
        """select mode, (select 2 * count(*) from branch_dim)::bigint as configured, n as selected, case mode when 'full' then 'partial coverage' when 'incremental' then 'partial coverage'
          when 'backfill' then 'ok' when 'preview' then 'ok' when 'blind backfill' then 'backfill needs an explicit selection'
          else 'mode may not publish' end as verdict
        from (select count(distinct s_nationkey) as n from supplier),
          (select unnest(['full', 'incremental', 'backfill', 'preview', 'blind backfill', 'other']) as mode)"""
    ),
)
def check_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the branches with suppliers, planned ones left out, tried in every mode."""
    branches = planned_branches(spark, sf_dir)
    chosen = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("branch_ord")).distinct()
    selected = branch_dim(spark, sf_dir).join(chosen, "branch_ord", "left_semi")
    runs = {
        "full": ("full", False, False),
        "incremental": ("incremental", False, False),
        "backfill": ("backfill", False, True),
        "preview": ("other", True, False),
        "blind backfill": ("backfill", False, False),
        "other": ("other", False, False),
    }
    rows = [
        quality.coverage(branches, selected, mode, preview, explicit).withColumn("mode", F.lit(label))
        for label, (mode, preview, explicit) in runs.items()
    ]
    return reduce(DataFrame.unionByName, rows)

