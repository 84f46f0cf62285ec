from datetime import datetime

from pyspark.sql import functions as F

from reviewmill.operators.explorer import explore
from reviewmill.sources import sinks

NOW = datetime(2026, 4, 10, 12, 0)
ZONE = "Africa/Johannesburg"


def table(spark):
    rows = [
        ("1", "a", 5, "Ann", "Great", "2026-04-09T22:30:00Z"),  # 10 April in the business zone
        ("2", "a", 4, "Bob", "", "2026-04-08T22:30:00Z"),
        ("3", "b", 1, "Cid", "slow", "2026-04-03T22:00:00Z"),
        ("4", "b", 0, "Dee", None, "2026-03-01T00:00:00Z"),
        ("5", "b", 2, "Eve", "late", "2026-12-01T00:00:00Z"),
        ("6", "b", 2, "Fay", "undated", None),
    ]
    df = spark.createDataFrame(rows, "id string, branchId string, rating int, reviewerName string, comment string, publishedAt string")
    return df.coalesce(1).withColumns(
        {
            "commentTranslated": F.lit(""),
            "ownerResponseText": F.lit("Thanks"),
            "branchName": F.upper("branchId"),
            "published_ts": F.col("publishedAt").cast("timestamp"),
            "ord": F.col("id").cast("int"),
        }
    )


def ids(df):
    return [r["id"] for r in df.collect()]


def test_ranges_rating_and_keywords(spark):
    reviews = table(spark)
    assert ids(explore(reviews, NOW, ZONE)) == ["5", "1", "2", "3", "4", "6"]
    assert ids(explore(reviews, NOW, ZONE, range_name="yesterday")) == ["2"]
    assert ids(explore(reviews, NOW, ZONE, range_name="last_7_days")) == ["5", "1", "2", "3"]
    assert ids(explore(reviews, NOW, ZONE, range_name="last_30_days")) == ["5", "1", "2", "3"]
    assert ids(explore(reviews, NOW, ZONE, range_name="this_month")) == ["1", "2", "3"]
    assert ids(explore(reviews, NOW, ZONE, rating=0)) == ["4"]
    assert ids(explore(reviews, NOW, ZONE, branch_id="b", search="  LATE thanks ")) == ["5"]
    assert ids(explore(reviews, NOW, ZONE, search="bob thanks a")) == ["2"]


def test_published_table_is_pruned_by_month(spark, tmp_path):
    root = str(tmp_path / "out")
    sinks.publish(spark, root, {"reviews": table(spark)})
    stored = sinks.read_table(spark, root, "reviews")
    recent = explore(stored, NOW, ZONE, range_name="last_7_days")
    assert sorted(ids(recent)) == ["1", "2", "3", "5"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "published_month" in filters
