"""The three publishing jobs: manual rebuild, full sync and capped incremental sync.

Each reads landed inputs, runs its checks, and publishes a new version of ``reviews``, ``branches`` and
``meta``. With ``write=False`` a job prepares and checks everything but publishes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.functions.dates import DEFAULT_ZONE
from reviewmill.functions.display import mode_label
from reviewmill.operators import branches as dim
from reviewmill.operators import quality
from reviewmill.operators.delta import STORED_COLUMNS, merge_delta, signed
from reviewmill.operators.dedup import last_per_key
from reviewmill.operators.matching import match_branches
from reviewmill.operators.merge import (
    INCOMING,
    STORED,
    merge_incremental,
    merge_manual,
    rekey,
    stamp_order,
)
from reviewmill.operators.metrics import branch_counts, count_map, usage_projection
from reviewmill.operators.normalize import attach_branch, branch_updates, normalize_items, normalize_paged
from reviewmill.operators.order import ORDER, dataset_date, descending, keep_order, stored_place
from reviewmill.operators.ranking import cap_newest_per_branch
from reviewmill.session import cut_lineage
from reviewmill.sources.csv_inputs import load_additions, load_removals, read_csv, removal_keys
from reviewmill.sources.documents import with_review_columns
from reviewmill.sources.landed import explode_pages, page_totals
from reviewmill.sources.sinks import MONTH, Manifest, choose_root, latest, publish, read_version
from reviewmill.schemas import ADDITIONS, BRANCH_PUBLISHED, REMOVALS


@dataclass
class Dataset:
    """The three tables of one run."""

    reviews: DataFrame
    branches: DataFrame
    meta: DataFrame



def _meta(reviews: DataFrame, **fields: Column) -> DataFrame:
    return reviews.agg(F.count(F.lit(1)).alias("reviewCount")).select(
        *[column.alias(name) for name, column in fields.items()], "reviewCount"
    )


def _counted(counts: DataFrame, total: str, by_branch: str) -> DataFrame:
    """One row with the number of rows in all and by branch, from the counts of the branches."""
    entries = F.collect_list(F.struct("branchId", "n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(total), F.map_from_entries(entries).alias(by_branch))


def stored_rows(reviews: DataFrame) -> DataFrame:
    """Stored reviews with their place in the merge order: as published, as listed in a document, or newest first."""
    if ORDER in reviews.columns:
        return stored_place(reviews)
    if "pos" in reviews.columns:
        return stamp_order(reviews, STORED, F.col("pos")).drop("pos")
    return stamp_order(reviews, STORED)


def prepared(dataset: Dataset, run: int) -> dict[str, DataFrame]:
    """The tables of a whole dataset as they are published: reviews with their stored order and signatures."""
    reviews = dataset.reviews if "ord" in dataset.reviews.columns else stored_rows(dataset.reviews)
    reviews = with_review_columns(reviews)
    place = F.struct("ord.*") if len(reviews.schema["ord"].dataType.fields) == 4 else F.struct(
        F.lit(INCOMING).alias("phase"), F.lit(0).cast("bigint").alias("pos"), descending(dataset_date()).alias("key"), F.col("reviewKey").alias("tie")
    )
    ordered = keep_order(reviews.withColumn("ord", place), run)
    return {"reviews": signed(ordered).select(*STORED_COLUMNS), "branches": dataset.branches, "meta": dataset.meta}


def publish_whole(spark: SparkSession, root: str, dataset: Dataset, **more: DataFrame) -> Manifest:
    """Publish a whole dataset as the next version."""
    base = latest(spark, root)
    return publish(spark, root, prepared(dataset, base.number + 1 if base else 1) | more, base)


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def run_summary(dataset: Dataset) -> DataFrame:
    """Mode, rows and per-branch rating and count, as printed after a run."""
    head = dataset.meta.select(mode_label("mode").alias("mode_label"), "reviewCount")
    rows = dataset.branches.select(
        F.col("id").alias("branch_id"),
        F.coalesce("currentRating", F.lit(0.0)).alias("rating"),
        F.coalesce("currentReviewsCount", F.lit(0)).cast("bigint").alias("total_reviews"),
    )
    return rows.join(head)


def build_manual(
    configured: DataFrame,
    base_branches: DataFrame,
    base_meta: DataFrame | None,
    base: DataFrame,
    additions: DataFrame,
    removals: DataFrame,
    generated_at: str,
) -> Dataset:
    """Base dataset plus additions less removals. Inputs carry ``ord`` and were checked."""
    merged = rekey(merge_manual(base, additions, removals.select("reviewKey")))
    # Written out for the figures are only the columns they need; the whole records are when they are published.
    rated = cut_lineage(merged.select("branchId", "rating"))
    added, removed = cut_lineage(branch_counts(additions)), cut_lineage(branch_counts(removals))
    active = dim.active_branches(configured, base_branches, added)
    published = dim.enrich_manual(active, base_branches, rated)
    meta = _meta(
        rated,
        mode=_text("manual"),
        generatedAt=_text(generated_at),
        source=_text("Manual update workflow"),
        actorId=_text(None),
        actorRunId=_text(None),
        sampled=F.lit(False),
    )
    meta = meta.join(_counted(added, "manualReviewCount", "manualBranchCounts"))
    meta = meta.join(_counted(removed, "manualRemovalCount", "manualRemovedBranchCounts"))
    if base_meta is not None:
        lineage = base_meta.select(
            F.coalesce("timezone", F.lit(DEFAULT_ZONE)).alias("timezone"),
            F.col("generatedAt").alias("baseGeneratedAt"),
            F.col("source").alias("baseSource"),
        )
        meta = meta.join(lineage, how="left", on=F.lit(True))
    else:
        meta = meta.withColumns({"timezone": F.lit(DEFAULT_ZONE), "baseGeneratedAt": _text(None), "baseSource": _text(None)})
    return Dataset(merged, published, meta)


def manual_rebuild(
    spark: SparkSession,
    configured: DataFrame,
    base: Dataset,
    additions_csv: str,
    removals_csv: str,
    target: str,
    generated_at: str,
    write: bool = True,
) -> Dataset:
    added = cut_lineage(load_additions(read_csv(spark, additions_csv, ADDITIONS), configured, base.branches, generated_at))
    removed = cut_lineage(load_removals(read_csv(spark, removals_csv, REMOVALS), configured))
    for rows, name in ((added, "additions"), (removed, "removals")):
        faulty = quality.input_errors(rows).select(F.concat_ws(" ", "file", F.lit("row"), F.concat("row", F.lit(":")), "error").alias("fault"))
        quality.require_none(faulty, f"{name} file", "fault")
    dataset = build_manual(
        configured,
        base.branches,
        base.meta,
        stored_rows(base.reviews),
        stamp_order(added.drop("error"), INCOMING, F.col("row_id")).drop("row_id", "file", "row"),
        removed,
        generated_at,
    )
    if write:
        dataset.reviews = cut_lineage(dataset.reviews)
        publish_whole(spark, choose_root(target, False), dataset)
    return dataset


def build_full(
    selected: DataFrame, pages: DataFrame, generated_at: str, preview: bool, max_reviews: int | None
) -> Dataset:
    """Paged payloads to a complete dataset: normalise, cap, last row per key. No merge, no removals."""
    reviews = normalize_paged(explode_pages(pages), selected, generated_at)
    if max_reviews is not None:
        reviews = cap_newest_per_branch(reviews, max_reviews, F.col("page_no"), F.col("pos")).drop("position")
    # What a branch falls back to counts its landed rows, repeated ones as well.
    landed = cut_lineage(reviews.withColumn("ord", F.struct("page_no", "pos")))
    reviews = cut_lineage(last_per_key(landed))
    reported = page_totals(pages).select(
        F.col("branchId").alias("t_id"), "totalReviewCount", F.col("averageRating").alias("reported_rating")
    )
    rated = dim.branch_rating(landed, selected).join(reported, F.col("id") == F.col("t_id"), "left")
    published = rated.select(
        *[c for c in selected.columns if c not in ("fid", "imageUrl", "pos")],
        F.when(F.col("totalReviewCount") > 0, F.col("totalReviewCount")).otherwise(F.col("computedCount")).alias("currentReviewsCount"),
        F.when(F.col("reported_rating") > 0, F.col("reported_rating")).otherwise(F.col("computedRating")).alias("currentRating"),
        F.coalesce("profileUrl", "mapsSearchUrl").alias("placeUrl"),
        "fid",
        "imageUrl",
    )
    matched = branch_match_summary(selected, reviews)
    listed = F.array_sort(F.collect_list(F.struct("branch_ord", "id", "matchedReviews")))
    meta = _meta(
        reviews,
        mode=_text("preview" if preview else "live"),
        generatedAt=_text(generated_at),
        timezone=_text(DEFAULT_ZONE),
        source=_text("Google Business Profile API"),
        actorId=_text(None),
        actorRunId=_text(None),
        sampled=F.lit(bool(max_reviews)),
        maxReviewsPerBranch=F.lit(max_reviews).cast("int"),
    ).join(
        matched.agg(listed.alias("listed")).select(
            F.transform("listed", lambda b: F.struct(b["id"].alias("id"), b["matchedReviews"].alias("matchedReviews"))).alias("branchMatchSummary"),
            F.transform(F.filter("listed", lambda b: b["matchedReviews"] == 0), lambda b: b["id"]).alias("missingBranchIds"),
            F.transform("listed", lambda b: b["id"]).alias("selectedBranchIds"),
        )
    )
    return Dataset(reviews, published, meta)


def branch_match_summary(selected: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews per selected branch, with its configured position."""
    counts = branch_counts(reviews).withColumnRenamed("branchId", "id")
    rows = selected.select("branch_ord", "id").join(counts, "id", "left")
    return rows.select("branch_ord", "id", F.coalesce("n", F.lit(0)).alias("matchedReviews"))


def full_sync(
    spark: SparkSession,
    configured: DataFrame,
    selected: DataFrame,
    pages: DataFrame,
    target: str,
    generated_at: str,
    preview: bool = False,
    max_reviews: int | None = None,
    write: bool = True,
) -> Dataset:
    allowed = quality.coverage(configured, selected, "full", preview, capped=max_reviews is not None)
    quality.require_none(allowed.where("verdict <> 'ok'"), "run may not publish", "verdict")
    quality.require_none(quality.missing_location_names(selected), "branches without a location name", "id")
    dataset = build_full(selected, pages, generated_at, preview, max_reviews)
    quality.require_none(dataset.meta.where("reviewCount = 0"), "no reviews were landed, rows", "reviewCount")
    quality.require_none(quality.branches_without_reviews(selected, dataset.reviews), "branches without reviews", "id")
    if write:
        publish_whole(spark, choose_root(target, preview), dataset, raw=pages)
    return dataset


def matched_items(items: DataFrame, selected: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Landed items that belong to a branch, with its ``b_`` columns; for ``names`` see :func:`match_branches`."""
    return attach_branch(match_branches(items, selected, names=names).where("branch_ord is not null"), selected)


def normalize_batch(items: DataFrame, selected: DataFrame, fetched_at: str) -> tuple[DataFrame, DataFrame]:
    """Landed items to (reviews, branch updates). Both come from one saved match, so items are matched once."""
    matched = cut_lineage(matched_items(items, selected))
    return cut_lineage(normalize_items(matched, fetched_at)), cut_lineage(branch_updates(matched))


def check_batch(reviews: DataFrame, selected: DataFrame) -> None:
    quality.require_none(quality.repeated_keys(reviews), "duplicate review ids", "reviewKey")
    quality.require_none(quality.repeated_signatures(reviews), "duplicate review signatures", "signature")
    quality.require_none(quality.invalid_ratings(reviews), "invalid ratings", "reviewKey")
    quality.require_none(quality.branches_without_reviews(selected, reviews), "branches without reviews", "id")


def check_merged(current: DataFrame, merged: DataFrame, branches: DataFrame, keys: DataFrame) -> None:
    quality.require_none(quality.shrunk(current, merged, keys), "merged dataset lost rows, rows kept", "merged_rows")
    quality.require_none(quality.repeated_keys(merged), "duplicate review ids after merge", "reviewKey")
    quality.require_none(quality.invalid_ratings(merged), "invalid ratings after merge", "reviewKey")
    quality.require_none(quality.unknown_branches(merged, branches), "unknown branches after merge", "reviewKey")


def build_incremental(
    configured: DataFrame,
    current: Dataset,
    incoming: DataFrame,
    updates: DataFrame,
    keys: DataFrame,
    generated_at: str,
    max_reviews: int,
    preview: bool = False,
    actor_id: str | None = None,
    run_id: str | None = None,
) -> Dataset:
    """Merge a normalised batch into the current dataset. Review inputs carry ``ord``."""
    merged = cut_lineage(rekey(merge_incremental(current.reviews, incoming, keys)))
    published = dim.enrich_incremental(configured, current.branches, updates, merged)
    meta = incremental_meta(configured, incoming, merged, generated_at, max_reviews, preview, actor_id, run_id)
    return Dataset(merged, published, meta)


def incremental_meta(
    configured: DataFrame,
    incoming: DataFrame,
    counted: int | DataFrame,
    generated_at: str,
    max_reviews: int,
    preview: bool,
    actor_id: str | None,
    run_id: str | None,
) -> DataFrame:
    """Run data of an incremental job; ``counted`` are the reviews published or their number."""
    usage = usage_projection(configured, max_reviews).select(
        F.col("daily_reviews").alias("apifyProjectedDailyReviews"),
        F.col("monthly_reviews").alias("apifyProjectedMonthlyReviews"),
        F.col("monthly_cost").alias("apifyProjectedMonthlyCostUsd"),
        F.lit(0.60).alias("apifyPricePerThousandReviewsUsd"),
    )
    scraped = incoming.agg(F.count(F.lit(1)).alias("apifyScrapedReviewCount")).join(
        count_map(incoming, "apifyScrapedBranchCounts")
    )
    fields = {
        "mode": _text("preview" if preview else "live"),
        "generatedAt": _text(generated_at),
        "timezone": _text(DEFAULT_ZONE),
        "source": _text("Apify incremental sync"),
        "actorId": _text(actor_id),
        "actorRunId": _text(run_id),
        "sampled": F.lit(False),
        "apifyMaxReviewsPerBranch": F.lit(max_reviews),
    }
    if isinstance(counted, DataFrame):
        return _meta(counted, **fields).join(scraped).join(usage)
    head = [column.alias(name) for name, column in fields.items()]
    return scraped.join(usage).select(*head, F.lit(counted).cast("bigint").alias("reviewCount"), *scraped.columns, *usage.columns)


def _check_run(configured: DataFrame, selected: DataFrame, items: DataFrame, max_reviews: int, mode: str, preview: bool, explicit: bool) -> None:
    """Refuse a run that may not publish, or landed more than it was allowed to."""
    allowed = quality.coverage(configured, selected, mode, preview, explicit)
    quality.require_none(allowed.where("verdict <> 'ok'"), "run may not publish", "verdict")
    usage = usage_projection(selected, max_reviews).where("status like 'blocked%'")
    quality.require_none(usage, "scraping volume", "status")
    quality.require_none(quality.overfetch(items, selected, max_reviews), "more items than the run allows", "items")


def incremental_sync(
    spark: SparkSession,
    configured: DataFrame,
    selected: DataFrame,
    items: DataFrame,
    current: Dataset,
    removals: DataFrame,
    target: str,
    generated_at: str,
    max_reviews: int = 20,
    mode: str = "incremental",
    preview: bool = False,
    explicit_selection: bool = False,
    write: bool = True,
) -> Dataset:
    """Land, normalise, match, check, merge with a given dataset, check again, publish it whole."""
    _check_run(configured, selected, items, max_reviews, mode, preview, explicit_selection)
    reviews, updates = normalize_batch(items, selected, generated_at)
    check_batch(reviews, selected)
    keys = removal_keys(removals)
    incoming = stamp_order(reviews, INCOMING, F.col("item_ord")).drop("item_ord")
    stored = Dataset(stored_rows(current.reviews), current.branches, current.meta)
    dataset = build_incremental(configured, stored, incoming, updates, keys, generated_at, max_reviews, preview)
    check_merged(current.reviews, dataset.reviews, dataset.branches, keys)
    if write:
        publish_whole(spark, choose_root(target, preview), dataset, raw=items)
    return dataset


def incremental_publish(
    spark: SparkSession,
    configured: DataFrame,
    selected: DataFrame,
    items: DataFrame,
    removals: DataFrame,
    root: str,
    generated_at: str,
    max_reviews: int = 20,
    mode: str = "incremental",
    preview: bool = False,
    explicit_selection: bool = False,
    actor_id: str | None = None,
    run_id: str | None = None,
    base: Manifest | None = None,
    state: dict[str, str | int] | None = None,
) -> Manifest:
    """The incremental job on the table published below ``root``: only what the batch can change is merged and written.

    The version holds reviews, branches, run data and the raw items. Run data that this job doesn't set is carried on
    from the version before.
    """
    base = base or latest(spark, root)
    _check_run(configured, selected, items, max_reviews, mode, preview, explicit_selection)
    reviews, updates = normalize_batch(items, selected, generated_at)
    check_batch(reviews, selected)
    keys = removal_keys(removals)
    incoming = stamp_order(reviews, INCOMING, F.col("item_ord")).drop("item_ord")
    delta = merge_delta(spark, root, base, incoming, keys)
    stored = read_version(spark, root, base, "reviews") if base else None
    every = delta.rows.select("branchId", "reviewKey", "rating")
    if stored is not None:
        every = every.unionByName(stored.where(~F.col(MONTH).isin(delta.touched)).select("branchId", "reviewKey", "rating"))
    branches = read_version(spark, root, base, "branches") if base else None
    branches = spark.createDataFrame([], T.StructType(BRANCH_PUBLISHED.fields)) if branches is None else branches
    published = cut_lineage(dim.enrich_incremental(configured, branches, updates, every))
    # A merge can repeat a key only among what it merged; what stays was checked when it was published.
    quality.require_none(quality.repeated_keys(delta.merged), "duplicate review ids after merge", "reviewKey")
    quality.require_none(quality.invalid_ratings(delta.merged), "invalid ratings after merge", "reviewKey")
    quality.require_none(quality.unknown_branches(every, published), "unknown branches after merge", "reviewKey")
    count = delta.after(base)
    if count < delta.before - delta.gone:
        raise quality.CheckFailed(f"merged dataset lost rows, rows kept: {count}")
    meta = incremental_meta(configured, incoming, count, generated_at, max_reviews, preview, actor_id, run_id)
    before = read_version(spark, root, base, "meta") if base else None
    if before is not None:
        carried = [c for c in before.columns if c not in meta.columns]
        meta = meta.join(before.select(*carried).limit(1), how="left", on=F.lit(True)) if carried else meta
    tables = {"reviews": delta.merged, "branches": published, "meta": meta, "raw": items}
    return publish(spark, root, tables, base, delta.touched, state, delta.stay)
