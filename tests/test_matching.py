from pyspark.sql import functions as F

from reviewmill.functions.text import normalize_match_text
from reviewmill.operators import matching, metrics
from reviewmill.plans import binding
from reviewmill.schemas import BRANCH_CONFIG


def branches(spark, *rows):
    names = BRANCH_CONFIG.fieldNames()
    data = [tuple(row.get(n) for n in names) for row in rows]
    df = spark.createDataFrame(data, BRANCH_CONFIG).coalesce(1)
    order = {row["id"]: i for i, row in enumerate(rows)}
    lookup = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return df.withColumn("branch_ord", lookup[F.col("id")])


def match(spark, dim, items, **options):
    df = spark.createDataFrame([(i, *item) for i, item in enumerate(items)], "n int, placeId string, cid string, title string").coalesce(1)
    rows = matching.match_branches(df, dim, **options).orderBy("n").collect()
    return [(r["branch_ord"], r["match_tier"]) for r in rows]


def test_tiers_order_and_blocks(spark):
    dim = branches(
        spark,
        {"id": "a", "name": "Nation 10", "placeId": "P0", "blockedTitles": ["Auto Box", "nation-1"], "aliases": ["Auto Box"]},
        {"id": "b", "name": "Nation 1", "cid": "C1", "aliases": ["Auto Box & Sons"]},
        {"id": "c", "name": "Nation 1", "placeId": " P0 ", "cid": "C2"},
    )
    got = match(
        spark,
        dim,
        [
            ("P0", "C1", "Nation 1"),  # identifier beats title; first branch with the place
            (None, "C2", "Nation 10"),
            (" ", "", "nation  1"),  # exact, first in order
            (None, None, "Nation 1 East"),  # prefix
            (None, None, "nat"),  # shorter than every name
            (None, None, "AUTO BOX"),  # blocked for the first branch, prefix of the second
            ("P0", None, "Auto Box"),  # block-list does not bar identifiers
            (None, None, "nowhere"),
            (None, None, ""),
        ],
    )
    assert got == [(0, 1), (2, 2), (1, 3), (1, 4), (0, 4), (1, 4), (0, 1), (None, None), (None, None)]


def test_dashboard_matching_has_no_blocklist(spark):
    dim = branches(spark, {"id": "a", "name": "x", "blockedTitles": ["Auto Box"], "aliases": ["Auto_Box"]})
    assert match(spark, dim, [(None, None, "auto box!")], normalizer=normalize_match_text, use_blocks=False) == [(0, 3)]


def locations(spark, *titles):
    return spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "loc_ord long, title string").coalesce(1)


def test_unique_location(spark):
    dim = branches(
        spark,
        {"id": "one", "name": "Alpha", "aliases": ["Alpha", "alpha shop"]},
        {"id": "two", "name": "Beta"},
        {"id": "fuzzy", "name": "Gamma Garage"},
        {"id": "many", "name": "Delta"},
        {"id": "barred", "name": "Eps", "blockedTitles": ["Eps North"]},
    )
    places = locations(spark, "ALPHA", "alpha annex", "Beta", "beta", "Gamma", "Delta A", "Delta B", "Eps North", "Eps South", None)
    got = {r["branch_ord"]: r["loc_ord"] for r in matching.unique_location_match(dim, places).collect()}
    assert got == {0: 0, 1: None, 2: 4, 3: None, 4: 8}


def test_repair_drops_unresolved_and_keeps_last(spark):
    dim = branches(spark, {"id": "a", "name": "Alpha"}, {"id": "b", "name": "Beta", "placeId": "P"})
    rows = spark.createDataFrame(
        [
            ("1", "a", "P", None, None, 0), ("1", "b", None, None, "beta", 1), ("2", "a", None, None, None, 2),
            ("3", "b", None, None, "alpha!", 3),
        ],
        "id string, branchId string, placeId string, cid string, title string, ord int",
    ).withColumn("branchName", F.lit("?"))
    got = sorted((r["reviewKey"], r["ord"]) for r in matching.repair_assignments(rows, dim).collect())
    assert got == [("a::3", 3), ("b::1", 1)]


def test_zero_ratings_count_as_one_star_but_not_in_the_mean(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 5), ("a", 4)], "branchId string, rating int")
    got = rows.groupBy("branchId").agg(*metrics.star_counts(), *metrics.total_measures()).first().asDict()
    assert (got["star_1"], got["star_5"], got["tracked"], got["rated"], got["rating_sum"]) == (1, 1, 3, 2, 9)


def test_titles_come_from_the_given_names(spark, tmp_path):
    """Only the two tables that names need exist, so a title pass over orders or parts would fail."""
    spark.createDataFrame([(20, 1), (23, 1), (21, None)], "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 7)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    names = binding.item_names(spark, str(tmp_path))
    assert sorted((r.placeId, r.cid, r.title) for r in names.collect()) == [(None, None, "Nation_7"), (None, None, "nat")]
    dim = branches(spark, {"id": "a", "name": "Nation_7"})
    assert match(spark, dim, [(None, None, "nation_7"), (None, None, "nation_7 east")], names=names) == [(0, 3), (None, None)]
