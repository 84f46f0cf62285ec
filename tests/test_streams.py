"""Streams over several micro-batches: late rows, foreign versions and fresh checkpoints."""

from datetime import datetime

from pyspark.sql import functions as F

from reviewmill.plans import stream_queries
from reviewmill.streaming.incremental import stream_incremental
from reviewmill.streaming.weekly import add_batch, all_weeks, stream_weekly, weekly_counts


def test_late_reviews_count(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for day in (datetime(2024, 3, 5), datetime(2024, 1, 2), datetime(2024, 3, 6)):
        spark.createDataFrame([("n1", 4, day)], "branchId string, rating int, published_ts timestamp").write.mode("append").parquet(source)
        stream = spark.readStream.schema("branchId string, rating int, published_ts timestamp").parquet(source)
        stream_weekly(stream, target, state).awaitTermination()
    got = {str(r.week_start): (r.n, r.rating_sum) for r in all_weeks(spark, target).collect()}
    assert got == {"2024-03-04": (2, 8), "2024-01-01": (1, 4)}


def test_fresh_checkpoint_is_another_stream(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr("reviewmill.streaming.incremental.merge_batch", lambda *a: seen.append((a[2], a[-1])))
    source = str(tmp_path / "in")
    spark.range(2).write.parquet(source)
    for state in ("a", "b"):
        landed = spark.readStream.schema("id long").parquet(source)
        stream_incremental(landed, lambda rows: rows.select(F.col("id")), str(tmp_path / "table"), str(tmp_path / state)).awaitTermination()
    assert [x[0] for x in seen] == [0, 0] and seen[0][1] != seen[1][1]


def _rows(spark, *rows):
    return spark.createDataFrame([(b, r, datetime.fromisoformat(t)) for b, r, t in rows], "branchId string, rating int, published_ts timestamp")


def test_weeks_of_a_zone_that_changes_its_clock(spark):
    # Sunday 2026-03-29, 23:30 in Berlin is 21:30 UTC, the week before it was 22:30 UTC; 22:30 UTC is Monday after the change.
    rows = _rows(spark, ("a", 1, "2026-03-22T22:30:00"), ("a", 2, "2026-03-29T21:30:00"), ("a", 3, "2026-03-29T22:30:00"), ("a", 4, "2026-10-25T22:30:00"))
    got = {(str(r.week_start), r.rating_sum) for r in weekly_counts(rows, "Europe/Berlin").collect()}
    assert got == {("2026-03-16", 1), ("2026-03-23", 2), ("2026-03-30", 3), ("2026-10-19", 4)}


def test_fresh_checkpoint_neither_replaces_nor_doubles_counts(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "weeks")
    schema = "branchId string, rating int, published_ts timestamp"

    def run(state):
        stream_weekly(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / state)).awaitTermination()
        return [(r.n, r.rating_sum) for r in all_weeks(spark, root).collect()]

    for rating in (4, 5):
        _rows(spark, ("a", rating, "2026-03-03T00:00:00")).coalesce(1).write.mode("append").parquet(source)
        got = run("old")
    assert got == [(2, 9)] and run("old") == [(2, 9)] and run("fresh") == [(2, 9)]
    _rows(spark, ("a", 1, "2026-03-04T00:00:00")).coalesce(1).write.mode("append").parquet(source)
    assert run("fresh") == [(3, 10)]


def test_batch_that_runs_again_adds_nothing(spark, tmp_path):
    root, counts = str(tmp_path / "weeks"), weekly_counts(_rows(spark, ("a", 4, "2026-03-03T00:00:00")))
    for batch in (0, 1, 1, 0):
        add_batch(spark, root, counts, "s", batch)
    assert all_weeks(spark, root).first().n == 2


def test_three_landings_are_three_batches_in_any_number_of_files(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr("reviewmill.streaming.incremental.merge_batch", lambda *a: seen.append((a[2], a[1].count())))
    monkeypatch.setattr("reviewmill.plans.stream_queries.read_table", lambda spark, root, name: spark.createDataFrame([], "x int"))
    monkeypatch.setattr("reviewmill.plans.stream_queries.numbered", lambda rows: rows.selectExpr("x reviewKey", "x branchId", "x rating", "x publishedAt", "x place"))
    rows = [(i, datetime(2024, 1, 1 + i % 5), i % 7, "click", 1.0, '{"k": 3}') for i in range(60)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    stream_queries.stream_three_batches(spark, str(tmp_path))
    assert seen == [(0, 20), (1, 20), (2, 20)]
