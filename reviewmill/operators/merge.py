"""Merging review rows into trusted records.

Two questions are answered apart. *Which record does a row belong to* depends on order and is settled
on narrow rows (``links``, ``slots``). *What does the record hold* then is plain aggregation over the
rows of a record, so the wide columns never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.text import first_nonempty, is_google, nz, review_key
from reviewmill.operators.links import components
from reviewmill.operators.sieve import split, without
from reviewmill.operators.slots import BLOCK_ROWS, INDEX, KEEP_FIRST, KEEP_NEWEST, SCAN, assign_slots
from reviewmill.session import cut_lineage
from reviewmill.schemas import OPTIONAL_FIELDS, RESPONSE_FIELDS, REVIEW_FIELDS
from reviewmill.sources.documents import with_review_columns

STORED, INCOMING = 0, 1


def stamp_order(rows: DataFrame, phase: int, position: Column | None = None, tie: Column | None = None) -> DataFrame:
    """Add ``ord``, the place of a row in the merge order.

    Without a position the stored order applies: newest first, then by key. ``tie`` separates rows that
    agree in both; rows that agree in everything may share their order.
    """
    if position is None:
        position = -F.coalesce(F.unix_micros("published_ts"), F.lit(0))
    tie = F.lit("") if tie is None else tie
    key = F.coalesce("reviewKey", F.lit(""))
    order = F.struct(
        F.lit(phase).alias("phase"), position.cast("bigint").alias("pos"), key.alias("key"), tie.cast("string").alias("tie")
    )
    return rows.withColumn("ord", order)


def apply_removals(rows: DataFrame, removal_keys: DataFrame) -> DataFrame:
    """Rows whose key was not withdrawn; applied to stored and new rows alike.

    Only rows that may have such a key are joined to the keys, so the rows are not shuffled for a long list.
    """
    keys = cut_lineage(removal_keys.select("reviewKey").distinct())
    return without(rows, keys, "reviewKey")


def saved_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both inputs of a merge, written once with the columns it needs: the merge reads them several times."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return cut_lineage(rows.select(*REVIEW_FIELDS, "reviewKey", "published_ts", "ord"))



def _filled(name: str) -> Column:
    """Value of a field when it counts as present: not empty for responses, not null otherwise."""
    return nz(name) if name in RESPONSE_FIELDS else F.col(name)


def fold_records(rows: DataFrame, policy: str) -> DataFrame:
    """One row per ``slot_ord`` from all rows assigned to it.

    ``keep_newest``: a google row replaces anything, another row replaces anything but a google row; so
    the last google row survives, else the last row. ``keep_first``: the first google row survives, else
    the first row. The survivor keeps its empty values, except for the response fields and the fields
    some producers leave out, which are taken from the other rows in the order merging would meet them.
    """
    google = F.col("google")
    rows = rows.withColumn("google", is_google())
    filled_names = list(dict.fromkeys(RESPONSE_FIELDS + OPTIONAL_FIELDS))
    value = F.struct(*REVIEW_FIELDS)
    if policy == KEEP_NEWEST:
        turns = rows.where("google").groupBy("slot_ord").agg(F.min("ord").alias("turn"))
        rows = rows.join(turns, "slot_ord", "left").withColumn(
            "early", F.col("turn").isNull() | (F.col("ord") < F.col("turn"))
        )
        winner = F.max_by(value, F.struct(google.cast("int"), "ord"))
    else:
        winner = F.min_by(value, F.struct((~google).cast("int"), "ord"))

    def pick(aggregate, name: str, condition: Column) -> Column:
        held = F.when(condition, _filled(name))
        return aggregate(held, F.when(held.isNotNull(), F.col("ord")))

    backfill: list[Column] = []
    for name in filled_names:
        if policy == KEEP_NEWEST:
            backfill += [
                pick(F.max_by, name, google).alias(f"{name}_1"),
                pick(F.max_by, name, ~google & F.col("early")).alias(f"{name}_2"),
                pick(F.min_by, name, ~google).alias(f"{name}_3"),
            ]
        else:
            backfill += [pick(F.min_by, name, F.lit(True)).alias(f"{name}_1")]
    folded = rows.groupBy("slot_ord").agg(winner.alias("w"), *backfill)

    def final(name: str) -> Column:
        own = F.col(f"w.{name}")
        if name not in filled_names:
            return own.alias(name)
        own_filled = F.when(own != "", own) if name in RESPONSE_FIELDS else own
        if policy == KEEP_NEWEST:
            others = [F.col(f"{name}_{i}") for i in (1, 2, 3)]
            return F.coalesce(*others, own).alias(name)
        return F.coalesce(own_filled, F.col(f"{name}_1"), own).alias(name)

    records = folded.select(*[final(f) for f in REVIEW_FIELDS], F.col("slot_ord").alias("ord"))
    return with_review_columns(records)


def merge_rows(rows: DataFrame, policy: str, lookup: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merge all rows that lead to one record. Rows that meet no other row pass through untouched, without a shuffle.

    The result keeps ``ord``, the order of the row that opened the record.
    """
    slots = assign_slots(components(rows, lookup == INDEX), policy, lookup, block_rows)
    keys = ["reviewKey", "ord"]
    maybe, never = split(rows, slots, "reviewKey")
    single = maybe.join(slots.select(*keys), keys, "left_anti")
    shared = fold_records(maybe.join(slots, keys), policy)
    columns = [*REVIEW_FIELDS, "reviewKey", "published_ts", "ord"]
    return never.select(*columns).unionByName(single.select(*columns)).unionByName(shared.select(*columns))


def merge_manual(base: DataFrame, additions: DataFrame, removal_keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Base reviews plus hand-made additions, less removals. Both inputs carry ``ord``."""
    rows = apply_removals(saved_rows(base, additions), removal_keys)
    return merge_rows(rows, KEEP_NEWEST, SCAN, block_rows)


def merge_incremental(current: DataFrame, incoming: DataFrame, removal_keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored reviews plus a scraped batch, less removals. Both inputs carry ``ord``."""
    return merge_saved(saved_rows(current, incoming), removal_keys, block_rows)


def merge_saved(rows: DataFrame, removal_keys: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`merge_incremental` of rows that were written already."""
    return merge_rows(apply_removals(rows, removal_keys), KEEP_FIRST, INDEX, block_rows)


def newest_first(reviews: DataFrame) -> DataFrame:
    """Dataset order: newest first by the first date that is not missing, as text."""
    date = F.coalesce(first_nonempty("publishedAt", "updatedAt", "scrapedAt"), F.lit(""))
    return reviews.orderBy(date.desc(), "ord")


def rekey(reviews: DataFrame) -> DataFrame:
    """Recompute the key from the values; a merged record may carry the other row's id."""
    return reviews.withColumn("reviewKey", review_key())
