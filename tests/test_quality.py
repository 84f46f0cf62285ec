"""Whole-dataset checks and overall figures at their edges."""

from reviewmill.operators import metrics, quality

REVIEWS = "branchId string, reviewKey string"


def test_dataset_without_branches_tells_only_that(spark):
    branches = spark.createDataFrame([], "id string")
    reviews = spark.createDataFrame([("a", "a::1"), ("a", "a::1")], REVIEWS)
    assert [tuple(r) for r in quality.check_dataset(branches, reviews).collect()] == [("no branches", "")]


def test_reviews_of_unknown_branches_count_for_no_other_problem(spark):
    branches = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    reviews = spark.createDataFrame([("a", "a::1"), ("a", "a::1"), ("x", "x::1"), ("x", "x::1"), ("b", "b::1")], REVIEWS)
    got = sorted(tuple(r) for r in quality.check_dataset(branches, reviews).collect())
    assert got == [("duplicate branch id", "b"), ("duplicate review key", "a::1"), ("unknown branch", "x::1"), ("unknown branch", "x::1")]


def test_overall_latest_falls_back_to_the_run(spark):
    meta = spark.createDataFrame([("2026-03-01T00:00:00Z",)], "generatedAt string")
    rows = spark.createDataFrame(
        [("2026-01-02T00:00:00Z", None, "x"), ("", "2026-02-02T00:00:00Z", "4"), (None, None, None)], "publishedAt string, scrapedAt string, rating string"
    )
    seen = metrics.effective_reviews(rows)
    assert metrics.overall_latest(seen, meta).first().latest_at == "2026-02-02T00:00:00Z"
    assert sorted(r.rating for r in seen.collect()) == [0.0, 0.0, 4.0]
    assert metrics.overall_latest(seen.limit(0), meta).first().latest_at == "2026-03-01T00:00:00Z"
