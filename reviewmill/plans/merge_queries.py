"""Registered queries: duplicates, merges, publishing jobs and their run data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.operators import branches as dim
from reviewmill.operators import dedup, matching
from reviewmill.operators.delta import STORED_COLUMNS, merge_delta, signed_parts
from reviewmill.operators.merge import (
    INCOMING,
    apply_removals,
    merge_incremental,
    merge_manual,
)
from reviewmill.operators.metrics import usage_projection
from reviewmill.operators.normalize import attach_branch, branch_updates
from reviewmill.operators.order import keep_order
from reviewmill.plans import jobs
from reviewmill.plans.binding import (
    FETCHED_AT,
    branch_dim,
    canonical_reviews,
    raw_items,
    review_pages,
    review_rows,
    table,
)
from reviewmill.plans.cleaning_queries import _DATED as DATED_SQL
from reviewmill.plans.cleaning_queries import ITEMS_SQL, PAGES_SQL
from reviewmill.plans.oracle import avg_pos, norm, round1, with_branches, with_reviews
from reviewmill.plans.registry import query
from reviewmill.session import cut_lineage, discard, scratch_path
from reviewmill.sources.sinks import publish, read_table

SIGNED_SQL = f"""
signed as (
  select *, concat_ws('|', {norm('branch_id')}, {norm('reviewer')}, left(published_at, 10), rating) as loose,
    concat_ws('|', {norm('branch_id')}, {norm('reviewer')}, left(published_at, 10), rating, {norm('comment')}) as exact,
    case source when 'Google' then 'g' when 'Manual update' then 'm' else 'o' end as src
  from reviews
)"""

SIGNATURE_COLUMNS = ("reviewerName", "publishedAt", "rating", "comment")


@query(
    "dedup_by_key",
    with_reviews(
        """select review_key, rating, published_at, tie from reviews
        qualify row_number() over (partition by review_key order by epoch_us(ts), tie desc) = 1"""
    ),
)
def dedup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir, "id", "reviewKey", "rating", "published_ts", "publishedAt", "ord")
    last = dedup.last_per_key(rows)
    return last.select(
        F.col("reviewKey").alias("review_key"), F.col("rating").cast("bigint").alias("rating"),
        F.col("publishedAt").alias("published_at"), F.col("ord.tie").alias("tie"),
    )


@query("exact_signature_dups", with_reviews("select exact as signature, count(*) as n from signed group by 1 having count(*) > 1", SIGNED_SQL))
def exact_signature_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_signature_dups(review_rows(spark, sf_dir, *SIGNATURE_COLUMNS))


@query("loose_signature_dups", with_reviews("select loose as signature, count(*) as n from signed group by 1 having count(*) > 1", SIGNED_SQL))
def loose_signature_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.loose_signature_dups(review_rows(spark, sf_dir, *SIGNATURE_COLUMNS))


@query(
    "loose_merge_pairs",
    with_reviews(
        """select loose as signature, count(*) filter (where src = 'm') as manual_rows, count(*) filter (where src = 'g') as google_rows,
        count(*) filter (where src = 'm') * count(*) filter (where src = 'g') as pairs
        from signed group by loose having manual_rows > 0 and google_rows > 0""",
        SIGNED_SQL,
    ),
)
def loose_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.loose_merge_pairs(review_rows(spark, sf_dir, *SIGNATURE_COLUMNS, "reviewSource"))


_REMOVED = "rating = 2 and id like '%-3'"


def _removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir, "id", "reviewKey", "rating").where(_REMOVED)
    return rows.select("branchId", "reviewKey").distinct()


@query(
    "apply_removals",
    with_reviews(
        f"""select branch_id, count(*) as n from reviews
        where review_key not in (select review_key from reviews where {_REMOVED}) group by branch_id"""
    ),
)
def apply_removals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review_rows(spark, sf_dir, "id", "reviewKey")
    left = apply_removals(rows, _removals(spark, sf_dir))
    return left.groupBy(F.col("branchId").alias("branch_id")).agg(F.count(F.lit(1)).alias("n"))


# --- order-dependent merges -------------------------------------------------------------------------------
# The SQL twin replays the rows of each (branch, reviewer) one by one. In these tables a key fixes the
# order, hence the reviewer, so rows of different reviewers never meet.

_MANUAL_NEW = "source = 'Manual update' and rating <> 3"
_SCRAPED_NEW = "source = 'Google' and rating >= 3"


def _combined_sql(new_wins: str) -> str:
    def back(field: str) -> str:
        return (
            f"case when coalesce(b.w.{field}, '') <> '' then b.w.{field} when coalesce(b.l.{field}, '') <> '' "
            f"then b.l.{field} else b.w.{field} end"
        )

    return f"""list_transform([case when {new_wins} then {{'w': x.slots[1], 'l': s}} else {{'w': s, 'l': x.slots[1]}} end],
      lambda b: {{'key': s.key, 'exact': b.w.exact, 'loose': b.w.loose, 'src': b.w.src, 'value_key': b.w.value_key,
        'branch_id': b.w.branch_id, 'rating': b.w.rating, 'comment': b.w.comment, 'published_at': b.w.published_at,
        'updated_at': coalesce(b.w.updated_at, b.l.updated_at), 'response': {back('response')},
        'response_date': {back('response_date')}}})[1]"""


_SCAN_SQL = """list_position(list_transform(acc.slots, lambda s: s.exact = x.slots[1].exact or (s.loose = x.slots[1].loose
  and s.src || x.slots[1].src in ('mg', 'gm'))), true)"""

_INDEX_SQL = """coalesce(
  list_position(list_transform(acc.slots, lambda s: s.key), list_filter(acc.ix, lambda e: e.sig = x.slots[1].exact)[-1].key),
  list_transform([list_position(list_transform(acc.slots, lambda s: s.key), list_filter(acc.ix, lambda e: e.sig = x.slots[1].loose)[-1].key)],
    lambda q: case when acc.slots[q].src || x.slots[1].src in ('mg', 'gm') then q end)[1])"""


def _merge_sql(new: str, new_wins: str, indexed: bool) -> str:
    find = f"case when x.phase = 1 then {_INDEX_SQL} else {_SCAN_SQL} end" if indexed else _SCAN_SQL
    entry = "[{'sig': x.slots[1].exact, 'key': KEY}, {'sig': x.slots[1].loose, 'key': KEY}]"
    made, met = entry.replace("KEY", "x.slots[1].key"), entry.replace("KEY", "acc.slots[p].key")
    return f"""{SIGNED_SQL},
    kept as (
      select *, case when {new} then 1 else 0 end as phase from signed
      where review_key not in (select review_key from reviews where {_REMOVED})
    ),
    blocks as (
      select list({{'phase': phase, 'slots': [{{'key': review_key, 'exact': exact, 'loose': loose, 'src': src, 'value_key': review_key,
          'branch_id': branch_id, 'rating': rating, 'comment': comment, 'published_at': published_at, 'updated_at': updated_at,
          'response': response, 'response_date': response_date}}],
        'ix': [{{'sig': exact, 'key': review_key}}, {{'sig': loose, 'key': review_key}}]}} order by phase, ts desc, review_key, tie) as steps
      from kept group by branch_id, reviewer
    ),
    replayed as (
      select list_reduce(steps, lambda acc, x: list_transform(
        [coalesce(list_position(list_transform(acc.slots, lambda s: s.key), x.slots[1].key), {find})],
        lambda p: case when p is null or p = 0
          then {{'phase': x.phase, 'slots': list_append(acc.slots, x.slots[1]), 'ix': list_concat(acc.ix, {made})}}
          else {{'phase': x.phase, 'slots': list_transform(acc.slots, lambda s, i: case when i = p then {_combined_sql(new_wins)} else s end),
            'ix': case when x.phase = 1 then list_concat(acc.ix, {met}) else acc.ix end}} end)[1]) as done
      from blocks
    ),
    merged as (select unnest(done.slots, recursive := true) from replayed)"""


MANUAL_SQL = _merge_sql(_MANUAL_NEW, "x.slots[1].src = 'g' or s.src <> 'g'", False)
INCREMENTAL_SQL = _merge_sql(_SCRAPED_NEW, "x.slots[1].src = 'g' and s.src <> 'g'", True)
_MERGED_COLUMNS = """key as slot_key, value_key as review_key, rating, comment, published_at, updated_at, response, response_date"""


def _merge_output(merged: DataFrame) -> DataFrame:
    return merged.select(
        F.col("ord.key").alias("slot_key"), F.col("reviewKey").alias("review_key"),
        F.col("rating").cast("bigint").alias("rating"), "comment", F.col("publishedAt").alias("published_at"),
        F.col("updatedAt").alias("updated_at"), F.col("ownerResponseText").alias("response"),
        F.col("ownerResponseDate").alias("response_date"),
    )


def _phases(spark: SparkSession, sf_dir: str, new: str) -> tuple[DataFrame, DataFrame]:
    rows = canonical_reviews(spark, sf_dir)
    test = F.expr(new.replace("source", "reviewSource"))
    incoming = rows.where(test).withColumn("ord", F.col("ord").withField("phase", F.lit(INCOMING)))
    return rows.where(~test), incoming


@query("merge_manual", with_reviews(f"select {_MERGED_COLUMNS} from merged", MANUAL_SQL))
def merge_manual_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made additions folded into the stored reviews, newest value preferred, withdrawn keys left out."""
    base, added = _phases(spark, sf_dir, _MANUAL_NEW)
    return _merge_output(merge_manual(base, added, _removals(spark, sf_dir)))


@query("merge_incremental", with_reviews(f"select {_MERGED_COLUMNS} from merged", INCREMENTAL_SQL))
def merge_incremental_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scraped batch folded into the stored reviews, stored value preferred, withdrawn keys left out."""
    current, incoming = _phases(spark, sf_dir, _SCRAPED_NEW)
    return _merge_output(merge_incremental(current, incoming, _removals(spark, sf_dir)))


_VALUES = "value_key as review_key, rating, comment, published_at, updated_at, response, response_date"


@query("merge_delta", with_reviews(f"select {_VALUES} from merged", INCREMENTAL_SQL))
def merge_delta_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scraped batch folded into a published table: only the months it can change are merged and written."""
    current, incoming = _phases(spark, sf_dir, _SCRAPED_NEW)
    root, withdrawn = scratch_path(spark, "delta"), _removals(spark, sf_dir)
    # Read several times; each copy goes when the next one is written.
    stored = cut_lineage(current)
    ordered = keep_order(stored, 1)
    discard(stored)
    # Ranges of the stored order are ranges of dates, so these rows are published without a shuffle.
    alone, linked = (part.select(*STORED_COLUMNS) for part in signed_parts(ordered))
    base = publish(spark, root, {"reviews": linked}, clustered=alone)
    discard(ordered)
    delta = merge_delta(spark, root, base, incoming, withdrawn)
    publish(spark, root, {"reviews": delta.merged}, base, delta.touched, clustered=delta.stay)
    return read_table(spark, root, "reviews").select(
        F.col("reviewKey").alias("review_key"), F.col("rating").cast("bigint").alias("rating"), "comment", F.col("publishedAt").alias("published_at"),
        F.col("updatedAt").alias("updated_at"), F.col("ownerResponseText").alias("response"), F.col("ownerResponseDate").alias("response_date"),
    )


# --- jobs ---------------------------------------------------------------------------------------------------


def _manual_dataset(spark: SparkSession, sf_dir: str) -> jobs.Dataset:
    base, added = _phases(spark, sf_dir, _MANUAL_NEW)
    branches = branch_dim(spark, sf_dir)
    stored = branches.withColumns({"placeUrl": F.when(F.col("branch_ord") % 2 == 1, F.lit("https://stored.example"))})
    return jobs.build_manual(branches, stored, None, base, added, _removals(spark, sf_dir), FETCHED_AT)


@query(
    "run_meta",
    with_reviews(
        f"""select 'manual' as mode, 'Manual update workflow' as source, 'Africa/Johannesburg' as timezone,
        (select count(*) from merged) as review_count,
        (select count(*) from reviews where {_MANUAL_NEW}) as manual_count,
        (select count(distinct review_key) from reviews where {_REMOVED}) as removal_count,
        b.id as branch_id,
        (select count(*) from reviews r where {_MANUAL_NEW} and r.branch_id = b.id) as added,
        (select count(distinct review_key) from reviews r where {_REMOVED} and r.branch_id = b.id) as removed from branch_dim b""",
        MANUAL_SQL,
    ),
)
def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a run, and what every branch has in its maps."""
    branches = branch_dim(spark, sf_dir).select(F.col("id").alias("branch_id"))
    meta = branches.join(_manual_dataset(spark, sf_dir).meta)
    return meta.select(
        "branch_id",
        "mode", "source", "timezone", F.col("reviewCount").alias("review_count"),
        F.col("manualReviewCount").alias("manual_count"), F.col("manualRemovalCount").alias("removal_count"),
        F.coalesce(F.col("manualBranchCounts")[F.col("branch_id")], F.lit(0)).alias("added"),
        F.coalesce(F.col("manualRemovedBranchCounts")[F.col("branch_id")], F.lit(0)).alias("removed"),
    )


@query(
    "run_summary",
    with_reviews(
        f"""select 'Manual refresh' as mode, (select count(*) from merged) as review_count, b.id as branch_id,
        {round1(avg_pos('m.rating'))} as rating, count(m.key) as total_reviews
        from branch_dim b left join merged m on m.branch_id = b.id group by b.id""",
        MANUAL_SQL,
    ),
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.run_summary(_manual_dataset(spark, sf_dir))
    return rows.select(
        F.col("mode_label").alias("mode"), F.col("reviewCount").alias("review_count"), "branch_id", "rating", "total_reviews"
    )


@query(
    "full_sync",
    with_branches(
        f"""select b.id as branch_id, case when t.total > 0 then t.total else coalesce(p.n, 0) end as total_reviews,
          case when t.rating > 0 then t.rating else coalesce(p.mean, 0.0) end as rating, coalesce(l.n, 0) as matched_reviews, l.newest
        from branch_dim b
          left join (select branch_id, count(*) as n, max(created) as newest from last_paged group by 1) l on l.branch_id = b.id
          left join (select branch_id, count(*) as n, {round1(avg_pos('stars'))} as mean from paged group by 1) p on p.branch_id = b.id
          left join (select branch_id, arg_max(k % 50, page_no) filter (where k % 50 > 0) as total,
              arg_max({round1('(k % 51) / 10.0')}, page_no) filter (where k % 51 > 0) as rating
            from page_rows group by branch_id) t on t.branch_id = b.id""",
        PAGES_SQL,
        "last_paged as (select * from paged qualify row_number() over (partition by branch_id, id order by page_no desc) = 1)",
    ),
)
def full_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged payloads replace the dataset: normalised, last row per key, reported totals kept."""
    dataset = jobs.build_full(branch_dim(spark, sf_dir), review_pages(spark, sf_dir), FETCHED_AT, False, None)
    held = dataset.reviews.groupBy("branchId").agg(F.count(F.lit(1)).alias("n"), F.max("publishedAt").alias("newest"))
    return dataset.branches.join(held, dataset.branches["id"] == held["branchId"], "left").select(
        F.col("id").alias("branch_id"), F.col("currentReviewsCount").alias("total_reviews"),
        F.col("currentRating").alias("rating"), F.coalesce("n", F.lit(0)).alias("matched_reviews"), "newest",
    )


@query(
    "sync_meta",
    with_branches(
        """select b.id as branch_id, row_number() over (order by b.branch_ord) as position, coalesce(l.n, 0) as matched_reviews,
          l.n is null as missing, (select count(*) from last_paged) as review_count
        from branch_dim b left join (select branch_id, count(*) as n from last_paged group by 1) l on l.branch_id = b.id""",
        PAGES_SQL,
        "last_paged as (select * from paged qualify row_number() over (partition by branch_id, id order by page_no desc) = 1)",
    ),
)
def sync_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run data of a full sync: the selected branches in configured order, what each matched, which have nothing."""
    meta = jobs.build_full(branch_dim(spark, sf_dir), review_pages(spark, sf_dir), FETCHED_AT, False, None).meta
    rows = meta.select("reviewCount", "branchMatchSummary", "missingBranchIds", F.posexplode("selectedBranchIds").alias("at", "branch_id"))
    return rows.select(
        "branch_id", (F.col("at") + 1).cast("bigint").alias("position"), F.col("branchMatchSummary")[F.col("at")]["matchedReviews"].alias("matched_reviews"),
        F.array_contains("missingBranchIds", F.col("branch_id")).alias("missing"), F.col("reviewCount").alias("review_count"),
    )


@query(
    "branch_enrich",
    with_reviews(
        f"""select b.id as branch_id, coalesce(r.n, 0) as total_reviews, coalesce(r.mean, 0.0) as rating,
          coalesce(case when u.k % 6 = 0 then 'https://place.example/' || u.s_nationkey end,
            case when b.branch_ord % 2 = 1 then 'https://stored.example' end, nullif(b.maps_url, ''), b.profile_url) as place_url,
          coalesce(case when u.k % 3 = 0 then ' P' || u.s_nationkey end, 'S' || b.branch_ord) as place_id,
          case when b.branch_ord % 2 = 1 then 'stored' end as fid,
          coalesce((u.s_nationkey || '0')::bigint, 0) as reported_count, case when u.k is null then 0.0 else 4.5 end::double as reported_rating
        from branch_dim b
          left join (select branch_id, count(*) as n, {round1(avg_pos())} as mean from reviews group by 1) r on r.branch_id = b.id
          left join (select * from dated qualify row_number() over (partition by branch_id order by item_ord desc) = 1) u on u.branch_id = b.id""",
        ITEMS_SQL,
        DATED_SQL,
    ),
)
def branch_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped value, else stored value, else configured value."""
    branches = branch_dim(spark, sf_dir)
    odd = F.col("branch_ord") % 2 == 1
    stored = branches.select(
        "id",
        F.when(odd, F.lit("https://stored.example")).otherwise("").alias("placeUrl"),
        F.concat(F.lit("S"), F.col("branch_ord").cast("string")).alias("placeId"),
        F.when(odd, F.lit("stored")).alias("fid"),
        F.lit("").alias("imageUrl"),
    )
    matched = attach_branch(matching.match_branches(raw_items(spark, sf_dir), branches).where("branch_ord is not null"), branches)
    rows = dim.enrich_incremental(branches, stored, branch_updates(matched), review_rows(spark, sf_dir, "rating"))
    return rows.select(
        F.col("id").alias("branch_id"), F.col("currentReviewsCount").alias("total_reviews"), F.col("currentRating").alias("rating"),
        F.col("placeUrl").alias("place_url"), F.col("placeId").alias("place_id"), "fid",
        F.col("apifyReportedReviewsCount").cast("bigint").alias("reported_count"), F.col("apifyReportedRating").alias("reported_rating"),
    )


@query(
    "usage_projection",
    """select count(*) as branches, count(*) * 20 as daily_reviews, count(*) * 620 as monthly_reviews,
      round_even(count(*) * 620 / 1000 * 0.60::double, 2) as monthly_cost,
      case when count(*) * 620 > 6500 then 'blocked: volume' when count(*) * 620 > 5000 then 'warning' else 'ok' end as status
    from supplier""",
)
def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraping volume if every supplier were a branch."""
    return usage_projection(table(spark, sf_dir, "supplier")).select(
        "branches", F.col("daily_reviews").cast("bigint").alias("daily_reviews"),
        F.col("monthly_reviews").cast("bigint").alias("monthly_reviews"), F.col("monthly_cost").cast("double").alias("monthly_cost"), "status",
    )

