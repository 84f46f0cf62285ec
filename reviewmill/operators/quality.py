"""Data checks. Each returns the offending rows; a job stops when any check returns one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.numbers import avg_positive, first_number, round_half_up_1, to_int
from reviewmill.functions.text import clean
from reviewmill.operators.branches import unknown_branch_reviews
from reviewmill.operators.dedup import duplicate_keys, exact_signature_dups, first_per_key
from reviewmill.operators.metrics import missing_branches

SHOWN = 10


class CheckFailed(RuntimeError):
    """A job refused to publish."""


def require_none(rows: DataFrame, message: str, label: str) -> None:
    """Raise when a check returned rows, naming the first few in order."""
    held = [str(r[0]) for r in rows.select(F.col(label).cast("string")).orderBy(label).limit(SHOWN).collect()]
    if held:
        raise CheckFailed(f"{message}: {', '.join(held)}")


def unknown_branches(rows: DataFrame, branches: DataFrame) -> DataFrame:
    return unknown_branch_reviews(rows, branches)


def repeated_keys(rows: DataFrame) -> DataFrame:
    return duplicate_keys(rows)


def repeated_signatures(rows: DataFrame) -> DataFrame:
    return exact_signature_dups(rows)


def invalid_ratings(rows: DataFrame) -> DataFrame:
    """Rows whose whole rating is not 1 to 5."""
    return rows.where(~to_int(first_number("rating")).between(1, 5))


def input_errors(loaded: DataFrame) -> DataFrame:
    """Rows of a strictly read input that carry an error."""
    return loaded.where(F.col("error").isNotNull())


def duplicate_branch_ids(branches: DataFrame) -> DataFrame:
    return branches.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_location_names(branches: DataFrame) -> DataFrame:
    return branches.where(clean("googleLocationName") == "")


def branches_without_reviews(branches: DataFrame, reviews: DataFrame) -> DataFrame:
    return missing_branches(branches, reviews)


def check_totals(meta: DataFrame, branches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Declared review count, and sum of branch counts for complete datasets, against the rows held."""
    rows = reviews.agg(F.count(F.lit(1)).alias("rows_held"))
    declared = branches.agg(
        F.coalesce(F.sum(to_int(first_number("currentReviewsCount"))), F.lit(0)).alias("branch_sum")
    )
    one = meta.select(
        F.coalesce("reviewCount", F.lit(0)).alias("declared"), strict_mode().alias("strict")
    ).join(rows).join(declared)
    checks = F.array_compact(
        F.array(
            F.when(F.col("declared") != F.col("rows_held"), F.struct(F.lit("review_count").alias("check"), F.col("declared").alias("declared"), F.col("rows_held").alias("held"))),
            F.when(
                F.col("strict") & (F.col("branch_sum") != F.col("rows_held")),
                F.struct(F.lit("branch_sum").alias("check"), F.col("branch_sum").alias("declared"), F.col("rows_held").alias("held")),
            ),
        )
    )
    return one.select(F.explode(checks).alias("c")).select("c.*")


def published_mode(mode: Column | str = "mode") -> Column:
    return F.lower(clean(mode)).isin("live", "manual")


def strict_mode(mode: str = "mode", sampled: str = "sampled") -> Column:
    """Published and complete datasets must agree exactly."""
    return published_mode(mode) & ~F.coalesce(F.col(sampled), F.lit(False))


def check_dataset(branches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Problems of the document as a whole.

    Without branches that is the only problem told. A review of an unknown branch is told as such and counts for no
    other problem.
    """
    size = branches.agg(F.count(F.lit(1)).alias("branches"))
    empty = size.where("branches = 0").select(F.lit("no branches").alias("problem"), F.lit("").alias("subject"))
    repeated = duplicate_branch_ids(branches).select(F.lit("duplicate branch id").alias("problem"), F.col("id").alias("subject"))
    # One row, or none if there are no branches.
    some = size.where("branches > 0").select(F.lit(True).alias("some"))
    unknown = unknown_branch_reviews(reviews, branches).select(
        F.lit("unknown branch").alias("problem"), F.coalesce("reviewKey", F.lit("<missing id>")).alias("subject")
    )
    known = reviews.join(branches.select(F.col("id").alias("branchId")).distinct(), "branchId", "left_semi")
    twice = duplicate_keys(known).select(F.lit("duplicate review key").alias("problem"), F.col("reviewKey").alias("subject"))
    return empty.unionByName(repeated).unionByName(unknown.join(some).drop("some")).unionByName(twice)


def branch_consistency(branches: DataFrame, reviews: DataFrame, mode: str, sampled: bool = False, order: str | None = None) -> DataFrame:
    """Per branch: count, rating, coverage and name problems, one row each.

    With ``order``, the column that holds the place of a row, only the first row of a repeated key counts.
    Without it keys have to be unique.
    """
    if order is not None:
        reviews = first_per_key(reviews, order=order)
    published = mode.strip().lower() in ("live", "manual")
    strict = published and not sampled
    stats = reviews.groupBy("branchId").agg(
        F.count(F.lit(1)).alias("n"),
        round_half_up_1(avg_positive("rating")).alias("mean"),
        F.min(clean("branchName")).alias("low_name"),
        F.max(clean("branchName")).alias("high_name"),
    )
    rows = branches.join(stats, branches["id"] == stats["branchId"], "left")
    tracked = F.coalesce("n", F.lit(0))
    declared = to_int(first_number("currentReviewsCount"))
    rating = round_half_up_1(first_number("currentRating"))
    mean = F.coalesce("mean", F.lit(0.0))
    wrong_count = declared != tracked if strict else declared < tracked
    problems = F.array_compact(
        F.array(
            F.when(wrong_count, F.lit("count")),
            F.when((tracked > 0) & (declared == tracked) & (rating != mean), F.lit("rating")),
            F.when(F.lit(published) & (tracked == 0), F.lit("empty")),
            F.when((F.col("low_name") != clean("name")) | (F.col("high_name") != clean("name")), F.lit("name")),
        )
    )
    return rows.select("id", tracked.alias("tracked"), declared.alias("declared"), F.explode(problems).alias("problem"))


def overfetch(items: DataFrame, branches: DataFrame, max_reviews: int) -> DataFrame:
    """One row when more items were landed than the guarded limit of the run allows."""
    return overfetch_figures(items, branches, max_reviews).where("items > hard_limit")


def overfetch_figures(items: DataFrame, branches: DataFrame, max_reviews: int) -> DataFrame:
    expected = F.col("branches") * max_reviews
    allowance = F.greatest(F.lit(10), F.floor(expected * 0.20))
    counted = items.agg(F.count(F.lit(1)).alias("items")).join(branches.agg(F.count(F.lit(1)).alias("branches")))
    return counted.select("items", expected.alias("expected"), (expected + allowance).alias("hard_limit"))


def shrink_figures(current: DataFrame, merged: DataFrame, removal_keys: DataFrame) -> DataFrame:
    """Row counts before and after a merge and how many removals explain."""
    explained = current.join(removal_keys.select("reviewKey"), "reviewKey", "left_semi")
    return (
        current.agg(F.count(F.lit(1)).alias("current_rows"))
        .join(explained.agg(F.count(F.lit(1)).alias("explained")))
        .join(merged.agg(F.count(F.lit(1)).alias("merged_rows")))
        .withColumn("least_expected", F.col("current_rows") - F.col("explained"))
    )


def shrunk(current: DataFrame, merged: DataFrame, removal_keys: DataFrame) -> DataFrame:
    """One row when a merge lost more rows than removals explain."""
    return shrink_figures(current, merged, removal_keys).where("merged_rows < least_expected")


def coverage(
    branches: DataFrame,
    selected: DataFrame,
    mode: str,
    preview: bool = False,
    explicit: bool = False,
    capped: bool = False,
) -> DataFrame:
    """Whether a run with this selection may publish; one row with the verdict.

    ``mode`` is ``incremental``, ``scheduled``, ``backfill`` or ``full``.
    """
    sizes = branches.agg(F.count(F.lit(1)).alias("configured")).join(
        selected.agg(F.count(F.lit(1)).alias("selected"))
    )
    partial = F.col("selected") != F.col("configured")
    ok = F.lit("ok")
    if preview:
        verdict = ok
    elif mode == "backfill":
        verdict = (
            F.when(F.lit(not explicit), "backfill needs an explicit selection")
            .when(F.col("selected") >= F.col("configured"), "backfill must leave branches out")
            .otherwise(ok)
        )
    elif mode == "full":
        verdict = F.when(partial, "partial coverage").when(F.lit(capped), "capped run").otherwise(ok)
    elif mode in ("incremental", "scheduled"):
        verdict = F.when(partial, "partial coverage").otherwise(ok)
    else:
        verdict = F.lit("mode may not publish")
    return sizes.withColumn("verdict", verdict)
