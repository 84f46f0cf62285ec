import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.operators import links, sieve
from reviewmill.operators.merge import INCOMING, STORED, merge_incremental, merge_manual, stamp_order
from reviewmill.schemas import REVIEW, REVIEW_FIELDS
from reviewmill.sources.documents import with_review_columns
from tests.model import merged

SOURCES = ["Google", "Manual update", "Google Business Profile review"]


def review(**fields):
    row = {name: None for name in REVIEW_FIELDS}
    row.update(
        branchId="a", reviewerName="Ann", rating=5, comment="", publishedAt="2026-01-02T10:00:00Z",
        reviewSource="Google", ownerResponseText="", reviewImageUrls=[], isLocalGuide=False, reviewerReviewCount=0,
    )
    row.update(fields)
    return row


def frame(spark, rows, phase):
    data = [tuple(r[name] for name in REVIEW_FIELDS) + (i,) for i, r in enumerate(rows)]
    schema = T.StructType([*REVIEW.fields, T.StructField("pos", T.LongType())])
    df = spark.createDataFrame(data, schema).coalesce(2)
    return stamp_order(with_review_columns(df), phase, F.col("pos")).drop("pos")


def no_removals(spark):
    return spark.createDataFrame([], "reviewKey string")


def values(rows):
    return sorted(tuple(str(r[n]) for n in REVIEW_FIELDS) for r in rows)


def random_rows(rng, n, ids, prefix=""):
    return [
        review(
            id=f"{prefix}{rng.randrange(ids)}",
            reviewerName=rng.choice(["Ann", "ann ", "Bob"]),
            rating=rng.choice([4, 5]),
            comment=rng.choice(["", "x", "x ", "y", "z"]),
            reviewSource=rng.choice(SOURCES),
            ownerResponseText=rng.choice(["", f"r{i}"]),
            ownerResponseDate=rng.choice([None, f"d{i}"]),
            ownerResponseUpdatedAt=rng.choice([None, "", f"u{i}"]),
            updatedAt=rng.choice([None, f"t{i}"]),
            reviewerProfilePhotoUrl=rng.choice([None, f"p{i}"]),
            scrapedAt=f"{prefix}{i}",
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block_rows", [12, 50_000])
def test_manual_merge_equals_model(spark, seed, block_rows):
    rng = random.Random(seed)
    base, added = random_rows(rng, 40, 60, "b"), random_rows(rng, 15, 60, rng.choice(["b", "m"]))
    got = merge_manual(frame(spark, base, STORED), frame(spark, added, INCOMING), no_removals(spark), block_rows)
    assert values(r.asDict() for r in got.collect()) == values(merged(base, added, True, False))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block_rows", [12, 50_000])
def test_incremental_merge_equals_model(spark, seed, block_rows):
    rng = random.Random(100 + seed)
    stored, new = random_rows(rng, 30, 50, "b"), random_rows(rng, 25, 50, rng.choice(["b", "n"]))
    got = merge_incremental(frame(spark, stored, STORED), frame(spark, new, INCOMING), no_removals(spark), block_rows)
    assert values(r.asDict() for r in got.collect()) == values(merged(stored, new, False, True))


def test_many_small_groups(spark):
    """Other sources in a loose group stand in the index and may hide an earlier row."""
    rng = random.Random(7)

    def some(prefix, n):
        rows = random_rows(rng, n, 10_000, prefix)
        return [{**r, "reviewerName": f"r{rng.randrange(25)}", "id": f"{prefix}{i}"} for i, r in enumerate(rows)]

    stored, new = some("b", 120), some("n", 60)
    got = merge_incremental(frame(spark, stored, STORED), frame(spark, new, INCOMING), no_removals(spark))
    assert values(r.asDict() for r in got.collect()) == values(merged(stored, new, False, True))


def test_removals_win_over_stored_and_new_rows(spark):
    gone = spark.createDataFrame([("a::1",)], "reviewKey string")
    stored, new = [review(id="1", comment="x"), review(id="2", comment="y")], [review(id="1", comment="z")]
    got = merge_incremental(frame(spark, stored, STORED), frame(spark, new, INCOMING), gone).collect()
    assert [r["id"] for r in got] == ["2"]


def test_only_rows_that_may_meet_are_written_and_joined(spark, monkeypatch):
    sizes, keep = [], links.cut_lineage
    monkeypatch.setattr(links, "cut_lineage", lambda df: (sizes.append(df.count()), keep(df))[1])
    rows = [review(id=str(i), reviewerName=f"r{i}") for i in range(300)] + [review(id="x", reviewerName="r1")]
    parts = links.components(frame(spark, rows, STORED)).collect()
    assert sorted(p.reviewKey for p in parts) == ["a::1", "a::x"] and max(sizes) < 20


def test_sieve_loses_and_keeps_what_an_anti_join_does(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([None, "a", "b", "b", "c", ""] * 3)], "reviewKey string, n int")
    keys = spark.createDataFrame([(None,), ("b",), ("z",)], "reviewKey string").distinct()
    got = sieve.without(rows, keys, "reviewKey")
    assert sorted(r.n for r in got.collect()) == sorted(r.n for r in rows.join(keys, "reviewKey", "left_anti").collect())


def test_a_sieve_with_many_keys_lets_few_others_pass(spark, monkeypatch):
    monkeypatch.setattr(sieve, "WORDS", 64)
    bits = sieve.sieve(spark.range(400).select(sieve.key_hash("id").alias("hash")))
    passed = sieve.probe(spark.range(4400), bits, sieve.key_hash("id"), "maybe").where("maybe")
    assert passed.where("id < 400").count() == 400 and passed.count() < 400 + 200


def test_keys_and_signatures_of_rows_that_may_meet_have_a_sieve_each(spark, monkeypatch):
    made, keep = [], links.sieve
    monkeypatch.setattr(links, "sieve", lambda hashes: (made.append(hashes.count()), keep(hashes))[1])
    rows = [review(id=str(i), reviewerName=f"r{i % 3}") for i in range(5)] + [review(id="1", reviewerName="r9")]
    found = links.linkable(frame(spark, rows, STORED)).collect()
    assert sorted(r.id for r in found) == ["0", "1", "1", "3", "4"] and made == [1, 2]
