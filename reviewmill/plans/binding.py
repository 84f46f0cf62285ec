"""The driver's test tables seen as reviews, branches and landed payloads.

Only the joins a query needs are made: branch, rating and flags come from ``lineitem`` and ``supplier``,
the date and reviewer from ``orders``, the comment from ``part``. The tables' foreign keys hold, so
leaving a join out changes no row. No join carries a broadcast hint: Spark broadcasts a side only when
its size is below the configured threshold.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions.dates import iso_utc
from reviewmill.functions.text import review_key
from reviewmill.operators.merge import STORED, stamp_order
from reviewmill.schemas import REVIEW
from reviewmill.session import cut_lineage

# Fixed values of the binding.
AS_OF = datetime(2001, 7, 1, 12, 0, 0)
EVENTS_AS_OF = datetime(2024, 1, 31, 0, 0, 0)
ZONE = "Africa/Johannesburg"
FETCHED_AT = "2001-07-01T12:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, read as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DIMS: dict[tuple[str, str], DataFrame] = {}


def branch_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch dimension, written once per session so that joins are planned on its real size."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DIMS:
        _DIMS[key] = cut_lineage(_branch_rows(spark, sf_dir))
    return _DIMS[key]


def _branch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 branches; some lack a place id or cid, every fifth blocks its own name and that name plus a zero."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    text = key.cast("string")
    none = F.lit(None).cast("string")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        key.alias("branch_ord"),
        F.concat(F.lit("n"), text).alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("Branch "), text).alias("shortName"),
        F.col("r_name").alias("location"),
        F.lit("#0d3d7c").alias("color"),
        F.when(key % 4 != 0, F.concat(F.lit("accounts/a1/locations/"), text)).otherwise("").alias("googleLocationName"),
        F.when(key % 5 != 0, F.concat(F.lit("C"), text)).alias("cid"),
        F.when(key % 3 != 0, F.concat(F.lit("P"), text)).alias("placeId"),
        F.concat(F.lit("https://profile.example/"), text).alias("profileUrl"),
        F.concat("n_name", F.lit(" "), "r_name").alias("searchQuery"),
        F.when(key % 2 == 0, F.concat(F.lit("https://maps.example/"), text)).otherwise("").alias("mapsSearchUrl"),
        F.array("n_name", F.concat(F.lower("n_name"), F.lit(" branch"))).alias("aliases"),
        F.when(key % 5 == 1, F.array("n_name", F.concat("n_name", F.lit("0")))).alias("blockedTitles"),
        F.when(key % 7 == 0, F.concat(F.lit("F"), text)).alias("fid"),
        none.alias("imageUrl"),
    )


_FROM_ORDERS = {"reviewerName", "published_ts", "publishedAt", "updatedAt", "scrapedAt", "ord"}
_FROM_PART = {"comment"}


def review_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Line items as reviews with the asked columns (``branchId`` always)."""
    wanted = set(columns)
    rows = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = rows.join(supplier, rows["l_suppkey"] == supplier["s_suppkey"])
    if wanted & _FROM_ORDERS:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        rows = rows.join(orders, rows["l_orderkey"] == orders["o_orderkey"])
    if wanted & _FROM_PART:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
        rows = rows.join(part, rows["l_partkey"] == part["p_partkey"])
    # Made after all joins, so that these shuffle the tables' own narrow columns.
    if wanted & _FROM_ORDERS:
        minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("l_partkey") % 1440).cast("int"))
        rows = rows.withColumn("published_ts", (F.col("o_orderdate") + minutes).cast("timestamp"))
        rows = rows.withColumn("publishedAt", iso_utc("published_ts"))
    rows = rows.withColumn("branchId", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).withColumn(
        "id", F.concat_ws("-", "l_orderkey", "l_linenumber")
    )
    rows = rows.withColumn("reviewKey", review_key())
    made = {
        "rating": lambda: ((F.col("l_orderkey") + 3 * F.col("l_linenumber") + F.col("l_partkey")) % 6).cast("int"),
        "isLocalGuide": lambda: F.col("l_partkey") % 4 == 0,
        "ownerResponseText": lambda: F.when(F.col("l_linestatus") == "F", "Thank you").otherwise(""),
        "ownerResponseDate": lambda: F.when((F.col("l_linestatus") == "F") & (F.col("l_partkey") % 3 == 0), "2001-06-01T00:00:00Z"),
        "reviewSource": lambda: F.when(F.col("l_returnflag") == "R", "Google")
        .when(F.col("l_returnflag") == "A", "Manual update")
        .otherwise("Google Business Profile review"),
        "comment": lambda: F.when(F.col("l_quantity").cast("int") % 3 == 0, "").otherwise(F.col("p_name")),
        "commentTranslated": lambda: F.when(F.col("l_quantity").cast("int") % 6 == 0, " translated ").otherwise(""),
        "reviewerName": lambda: F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")),
        "branchName": lambda: F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")),
        "updatedAt": lambda: F.when(F.col("l_partkey") % 5 != 0, F.col("publishedAt")),
        "scrapedAt": lambda: F.lit(FETCHED_AT),
        "placeId": lambda: F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("P"), F.col("s_nationkey").cast("string"))),
        "cid": lambda: F.when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("C"), F.col("s_nationkey").cast("string"))),
        "title": lambda: _title(),
    }
    for name in made:
        if name in wanted:
            rows = rows.withColumn(name, made[name]())
    if "ord" in wanted:
        tie = F.concat_ws(
            "|",
            F.lpad(F.col("l_partkey").cast("string"), 12, "0"),
            F.lpad(F.col("l_suppkey").cast("string"), 12, "0"),
            F.lpad(F.col("l_quantity").cast("int").cast("string"), 6, "0"),
            F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 14, "0"),
            "l_returnflag",
            "l_linestatus",
        )
        rows = stamp_order(rows, STORED, tie=tie)
    return rows.select("branchId", *[c for c in dict.fromkeys(columns) if c != "branchId"])


def _title():
    """Exact, longer, shorter, unknown and blocked titles."""
    nation = F.col("s_nationkey").cast("string")
    return (
        F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("Nation_"), nation))
        .when(F.col("l_partkey") % 5 == 1, F.concat(F.lit("NATION_"), nation, F.lit("  Branch - east")))
        .when(F.col("l_partkey") % 5 == 2, F.concat(F.lit("branch "), nation))
        .when(F.col("l_partkey") % 5 == 3, F.lit("nat"))
        .otherwise("Elsewhere & Co")
    )


def planned_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All branches, and each once more as a planned one that no review names yet."""
    branches = branch_dim(spark, sf_dir)
    return branches.unionByName(branches.withColumn("id", F.concat(F.lit("planned-"), "id")))


def canonical_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All canonical fields plus key, instant and order."""
    names = [
        "id", "reviewKey", "branchName", "reviewerName", "rating", "isLocalGuide", "comment", "commentTranslated",
        "publishedAt", "updatedAt", "reviewSource", "ownerResponseText", "ownerResponseDate", "scrapedAt",
        "placeId", "cid", "title", "published_ts", "ord",
    ]
    rows = review_rows(spark, sf_dir, *names)
    missing = [f for f in REVIEW.fields if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def _position():
    """Landing position made from the row itself: order, line, part, supplier."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return (line * 100_000 + (F.col("l_partkey") % 10_000) * 10 + F.col("l_suppkey") % 10).cast("bigint")


def _item_ids():
    """Place and listing id of scraped items."""
    k, nation = F.col("l_partkey"), F.col("s_nationkey").cast("string")
    return F.when(k % 3 == 0, F.concat(F.lit(" P"), nation)), F.when(k % 3 == 1, F.concat(F.lit("C"), nation))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scraped items."""
    rows = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = (
        rows.join(supplier, rows["l_suppkey"] == supplier["s_suppkey"])
        .join(orders, rows["l_orderkey"] == orders["o_orderkey"])
        .join(part, rows["l_partkey"] == part["p_partkey"])
    )
    nation = F.col("s_nationkey").cast("string")
    place, cid = _item_ids()
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("l_partkey") % 1440).cast("int"))
    date = iso_utc((F.col("o_orderdate") + minutes).cast("timestamp"))
    k = F.col("l_partkey")
    rating = (F.col("l_orderkey") + 3 * F.col("l_linenumber") + k) % 6
    none = F.lit(None).cast("string")
    return rows.select(
        _position().alias("item_ord"),
        F.when(k % 10 == 0, "  ").otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("reviewId"),
        F.when(F.col("l_quantity").cast("int") % 3 != 0, F.col("p_name")).alias("text"),
        F.when(k % 9 == 0, "translated").alias("textTranslated"),
        F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("name"),
        none.alias("reviewerUrl"),
        F.when(k % 4 != 0, date).alias("publishedAtDate"),
        F.when(k % 4 == 0, F.when(k % 8 == 0, "").otherwise(date)).alias("publishedAt"),
        F.lit("a while ago").alias("publishAt"),
        F.when(k % 5 == 0, date).otherwise("").alias("updatedAtDate"),
        F.when(k % 16 != 0, F.lit(FETCHED_AT)).alias("scrapedAt"),
        none.alias("reviewUrl"),
        F.when(F.col("l_returnflag") == "A", "Tripadvisor").otherwise("").alias("reviewOrigin"),
        F.when(F.col("l_linestatus") == "F", "Thank you").alias("responseFromOwnerText"),
        F.when(F.col("l_linestatus") == "F", date).alias("responseFromOwnerDate"),
        F.when(k % 2 == 0, "de").alias("originalLanguage"),
        F.lit("en").alias("language"),
        none.alias("translatedLanguage"),
        place.alias("placeId"),
        cid.alias("cid"),
        none.alias("fid"),
        F.when(k % 6 == 0, F.concat(F.lit("https://place.example/"), nation)).alias("url"),
        _title().alias("title"),
        none.alias("imageUrl"),
        F.when(k % 2 == 0, rating.cast("string")).otherwise("n/a").alias("stars"),
        F.when(k % 2 == 1, F.concat(rating.cast("string"), F.lit(".0"))).alias("rating"),
        F.lit("4.46").alias("totalScore"),
        F.concat(nation, F.lit("0")).alias("reviewsCount"),
        F.when(k % 3 == 0, "12").otherwise("x").alias("reviewerNumberOfReviews"),
        F.when(k % 4 == 0, True).alias("isLocalGuide"),
        F.lit(None).cast("array<string>").alias("reviewImageUrls"),
    )


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scraped items are matched by; orders and parts add nothing to it, so they aren't joined."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    place, cid = _item_ids()
    rows = rows.join(supplier, rows["l_suppkey"] == supplier["s_suppkey"])
    return rows.select(place.alias("placeId"), cid.alias("cid"), _title().alias("title"))


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as review pages of the customer's branch, one item per page.

    A page of one item needs no grouping, so no page can grow with a hot order.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(
        customer, orders["o_custkey"] == customer["c_custkey"]
    )
    k = F.col("l_partkey")
    words = F.array(*[F.lit(w) for w in ("", "ONE", " two", "Three", "FOUR", "FIVE", "6")])
    date = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:00:00Z"))
    none = F.lit(None).cast("string")
    item = F.struct(
        F.when(k % 20 != 0, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("reviewId"),
        F.when(k % 30 != 1, date).alias("createTime"),
        F.when(k % 2 == 0, F.lit(FETCHED_AT)).alias("updateTime"),
        F.element_at(words, (k % 7 + 1).cast("int")).alias("starRating"),
        F.when(k % 3 != 0, F.concat(F.lit("part "), k.cast("string"))).alias("comment"),
        F.struct(
            F.when(k % 11 != 0, F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("displayName"),
            none.alias("profilePhotoUrl"),
        ).alias("reviewer"),
        F.when(
            F.col("l_linestatus") == "F",
            F.struct(F.lit("Thank you").alias("comment"), F.lit(FETCHED_AT).alias("updateTime")),
        ).alias("reviewReply"),
    )
    return rows.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("branch_id"),
        _position().alias("page_no"),
        (k % 50).cast("bigint").alias("totalReviewCount"),
        ((k % 51) / 10).alias("averageRating"),
        F.lit("").alias("nextPageToken"),
        F.array(item).alias("reviews"),
    )


def event_reviews(events: DataFrame) -> DataFrame:
    """Events as reviews of one google-like source; branch is the event type."""
    rating = (F.get_json_object("props", "$.k").cast("int") % 5 + 1).cast("int")
    rows = events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("branchId"),
        F.col("event_type").alias("branchName"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("reviewerName"),
        rating.alias("rating"),
        F.lit("").alias("comment"),
        F.col("ts").cast("timestamp").alias("published_ts"),
        F.lit("Google").alias("reviewSource"),
        F.lit("").alias("ownerResponseText"),
        F.col("event_id"),
    )
    rows = rows.withColumn("publishedAt", iso_utc("published_ts")).withColumn("reviewKey", review_key())
    missing = [f for f in REVIEW.fields if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
