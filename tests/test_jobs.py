import json

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import quality
from reviewmill.operators.merge import INCOMING, stamp_order
from reviewmill.plans import jobs
from reviewmill.schemas import ADDITIONS, RAW_ITEM, REVIEW, REVIEW_PAGE
from reviewmill.sources import csv_inputs, documents, landed, sinks
from reviewmill.streaming.incremental import stream_incremental

BRANCHES = [
    {"id": "north", "name": "North Yard", "placeId": "P1", "googleLocationName": "accounts/1/locations/1", "mapsSearchUrl": "m1"},
    {"id": "south", "name": "South Yard", "cid": "C2", "googleLocationName": "accounts/1/locations/2", "profileUrl": "p2"},
]
BASE = {
    "meta": {"mode": "live", "generatedAt": "2026-01-01T00:00:00Z", "source": "seed", "reviewCount": 2},
    "branches": [{"id": "north", "name": "North Yard", "fid": "F1"}],
    "reviews": [
        {"id": "1", "branchId": "north", "branchName": "North Yard", "reviewerName": "Ann", "rating": 5, "comment": "good",
         "publishedAt": "2026-01-01T10:00:00Z", "reviewSource": "Google", "ownerResponseText": ""},
        {"id": "2", "branchId": "north", "branchName": "North Yard", "reviewerName": "Bob", "rating": 3, "comment": "",
         "publishedAt": "2026-01-02T10:00:00Z", "reviewSource": "Google", "ownerResponseText": ""},
    ],
}
HEADER = ",".join(ADDITIONS.fieldNames())


@pytest.fixture()
def base(spark, tmp_path):
    (tmp_path / "branches.json").write_text(json.dumps(BRANCHES))
    (tmp_path / "base.json").write_text(json.dumps(BASE))
    docs = documents.read_documents(spark, str(tmp_path / "base.json"))
    dataset = jobs.Dataset(
        documents.document_reviews(docs).drop("pos"), documents.document_branches(docs), documents.document_meta(docs)
    )
    return documents.read_branches(spark, str(tmp_path / "branches.json")), dataset


def test_csv_with_bom_quotes_and_mistakes(spark, tmp_path, base):
    lines = [
        HEADER,
        'north,Ann,5,2026-04-13,"two\nlines, ""quoted""",,,,,true,7,,',
        ",,,,,,,,,,,,",
        "nowhere,Ann,5,2026-04-13,,,,,,,,,",
        "south,,4.5,2026-04-13,,,,,,,,,",
        "south,,6,2026-04-13,,,,,,,,,",
        "south,,4,,,,,,,,,,",
        "south,,4,someday,,,,,,,,,",
        "south,,4,3 Apr 2026,,,,,r1,,,,",
        "south,,4,13 Apr 2026,,,,,r1,,,,",
    ]
    (tmp_path / "a.csv").write_bytes(("﻿" + "\n".join(lines) + "\n").encode())
    rows = csv_inputs.load_additions(csv_inputs.read_csv(spark, str(tmp_path / "a.csv"), ADDITIONS), base[0], base[1].branches, "now")
    got = [(r["comment"], r["publishedAt"], r["fid"], r["error"]) for r in rows.orderBy("row_id").collect()]
    assert got[0] == ('two\nlines, "quoted"', "2026-04-13T12:00:00Z", "F1", None)
    assert [g[3] for g in got[1:]] == [
        "unknown branch_id", "rating must be a whole number from 1 to 5", "rating must be between 1 and 5",
        "published_at is required", "could not understand date", None, "duplicate review_id",
    ]
    assert [g[1] for g in got[-2:]] == ["2026-04-03T12:00:00Z", "2026-04-13T00:00:00Z"]


def test_missing_csv_is_empty(spark, tmp_path):
    assert csv_inputs.read_csv(spark, str(tmp_path / "none.csv"), ADDITIONS).isEmpty()


def test_manual_rebuild(spark, tmp_path, base):
    configured, dataset = base
    (tmp_path / "a.csv").write_text(f"{HEADER}\nnorth,ann,5,2026-01-01 10:00,Good,Thanks,,,,,,,\nsouth,Cid,4,2026-02-01,,,,,,,,,\n")
    (tmp_path / "r.csv").write_text("branch_id,review_id,reviewer_name,published_at,reason\nnorth,2,,,gone\n")
    result = jobs.manual_rebuild(
        spark, configured, dataset, str(tmp_path / "a.csv"), str(tmp_path / "r.csv"), str(tmp_path / "out"), "2026-03-01T00:00:00Z"
    )
    reviews = sinks.read_table(spark, sinks.choose_root(str(tmp_path / "out"), False), "reviews").orderBy("branchId").collect()
    # Ann's google row stays and takes the manual response; Bob was withdrawn.
    assert [(r["branchId"], r["id"] == "1", r["reviewSource"], r["ownerResponseText"]) for r in reviews] == [
        ("north", True, "Google", "Thanks"),
        ("south", False, "Manual update", ""),
    ]
    meta = result.meta.first().asDict()
    assert (meta["reviewCount"], meta["manualReviewCount"], meta["manualRemovalCount"], meta["baseSource"]) == (2, 2, 1, "seed")
    assert meta["manualBranchCounts"] == {"north": 1, "south": 1}
    assert {r["branch_id"]: r["total_reviews"] for r in jobs.run_summary(result).collect()} == {"north": 1, "south": 1}
    (tmp_path / "a.csv").write_text(f"{HEADER}\nnorth,ann,9,2026-01-01,,,,,,,,,\n")
    with pytest.raises(quality.CheckFailed, match="between 1 and 5"):
        jobs.manual_rebuild(spark, configured, dataset, str(tmp_path / "a.csv"), "none", str(tmp_path / "out"), "x")


def items(spark, tmp_path, *rows):
    path = tmp_path / f"items-{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps(list(rows)))
    return landed.read_items(spark, str(path))


NEW = {"reviewId": "9", "placeId": "P1", "name": "Ann", "stars": "5", "publishedAtDate": "2026-01-05T00:00:00Z", "text": "new", "reviewsCount": "40"}
SOUTH = {"reviewId": "8", "cid": "C2", "name": "Cid", "rating": "4", "publishedAtDate": "2026-01-06T00:00:00Z"}


def test_incremental_sync(spark, tmp_path, base):
    configured, dataset = base
    none = spark.createDataFrame([], "branch_id string, review_id string")
    out = str(tmp_path / "out")

    def sync(rows, **options):
        return jobs.incremental_sync(spark, configured, options.pop("selected", configured), rows, dataset, none, out, "2026-03-01T00:00:00Z", **options)

    result = sync(items(spark, tmp_path, NEW, SOUTH, {"reviewId": "7", "title": "elsewhere", "stars": "1"}))
    assert sinks.read_table(spark, f"{out}/live", "reviews").count() == 4
    meta = result.meta.first()
    assert (meta["reviewCount"], meta["apifyScrapedReviewCount"], meta["apifyScrapedBranchCounts"]) == (4, 2, {"north": 1, "south": 1})
    north = result.branches.where("id = 'north'").first()
    assert (north["currentReviewsCount"], north["apifyReportedReviewsCount"], north["fid"]) == (3, 40, "F1")
    assert quality.branch_consistency(result.branches, result.reviews, "live").isEmpty()
    assert quality.check_totals(result.meta, result.branches, result.reviews).isEmpty()
    version = sinks.current_version(spark, f"{out}/live")
    for rows, options, message in [
        (items(spark, tmp_path, NEW), {}, "branches without reviews"),
        (items(spark, tmp_path, NEW, SOUTH, {**NEW, "reviewId": "10"}), {}, "duplicate review signatures"),
        (items(spark, tmp_path, NEW, NEW, SOUTH), {}, "duplicate review ids"),
        (items(spark, tmp_path, {**NEW, "stars": "7"}, SOUTH), {}, "invalid ratings"),
        (items(spark, tmp_path, NEW), {"selected": configured.where("id = 'north'")}, "partial coverage"),
        (items(spark, tmp_path, *[NEW] * 60), {}, "more items than the run allows"),
        (items(spark, tmp_path, NEW), {"max_reviews": 21}, "scraping volume"),
    ]:
        with pytest.raises(quality.CheckFailed, match=message):
            sync(rows, **options)
    assert sinks.current_version(spark, f"{out}/live") == version


def test_full_sync(spark, tmp_path, base):
    configured, _ = base
    review = {"reviewId": "1", "createTime": "2026-01-01T00:00:00Z", "starRating": "FIVE"}
    pages = [
        {"branch_id": "north", "page_no": 1, "totalReviewCount": 9, "averageRating": 4.44, "reviews": [review, {**review, "starRating": "5"}]},
        {"branch_id": "north", "page_no": 2, "totalReviewCount": 0, "reviews": [{**review, "comment": "later", "reviewReply": {"comment": "ok"}}]},
        {"branch_id": "south", "page_no": 1, "reviews": [{**review, "starRating": "TWO"}, {**review, "reviewId": "2", "starRating": "FOUR"}]},
    ]
    (tmp_path / "pages.json").write_text("\n".join(json.dumps(p) for p in pages))
    read = spark.read.schema(REVIEW_PAGE).json(str(tmp_path / "pages.json"))
    result = jobs.full_sync(spark, configured, configured, read, str(tmp_path / "out"), "2026-03-01T00:00:00Z")
    rows = {r["reviewKey"]: (r["rating"], r["comment"], r["ownerResponseText"]) for r in result.reviews.collect()}
    assert rows == {"north::1": (5, "later", "ok"), "south::1": (2, "", ""), "south::2": (4, "", "")}
    figures = {r["id"]: (r["currentReviewsCount"], r["currentRating"]) for r in result.branches.collect()}
    assert figures == {"north": (9, 4.4), "south": (2, 3.0)}
    meta = result.meta.first()
    assert meta["selectedBranchIds"] == ["north", "south"] and meta["missingBranchIds"] == []
    assert [(b["id"], b["matchedReviews"]) for b in meta["branchMatchSummary"]] == [("north", 1), ("south", 2)]
    with pytest.raises(quality.CheckFailed, match="capped run"):
        jobs.full_sync(spark, configured, configured, read, str(tmp_path / "out"), "x", max_reviews=1)


def test_stream_equals_batches_in_order(spark, tmp_path):
    names = REVIEW.fieldNames()

    def land(n, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        blank = {name: None for name in names}
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({**blank, "n": i, **r}) for i, r in enumerate(rows)))

    row = {"branchId": "a", "reviewerName": "Ann", "rating": 5, "comment": "x", "publishedAt": "2026-01-01T00:00:00Z", "ownerResponseText": ""}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REVIEW.fields) + ", n long"
    to_reviews = lambda df: stamp_order(documents.with_review_columns(df), INCOMING, F.col("n")).drop("n")
    root, state = str(tmp_path / "table"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        stream_incremental(stream, to_reviews, root, state).awaitTermination()
        return sorted((r["id"], r["reviewSource"], r["ownerResponseText"]) for r in sinks.read_table(spark, root, "reviews").collect())

    land(1, {**row, "id": "m1", "reviewSource": "Manual update", "ownerResponseText": "Thanks"}, {**row, "id": "o1", "reviewSource": "Other", "comment": "y"})
    assert run() == [("m1", "Manual update", "Thanks"), ("o1", "Other", "")]
    # The later twin hides the manual row in the index, so the google row opens a record of its own ...
    land(2, {**row, "id": "g1", "reviewSource": "Google", "comment": "z"})
    first = run()
    # ... and the next batch collapses it into the manual row, which keeps its response.
    land(3, {**row, "id": "g2", "branchId": "b", "reviewSource": "Google"})
    second = run()
    assert ("g1", "Google", "Thanks") in second and len(second) == 3
    assert len(first) == 3
    before = sinks.current_version(spark, root)
    assert run() == second and sinks.current_version(spark, root) == before


def test_raw_schema_names_every_read_field():
    assert {"stars", "rating", "totalScore", "title", "placeId"} <= set(RAW_ITEM.fieldNames())


def test_figures_of_a_manual_run_need_no_copy_of_the_whole_records(spark, base, monkeypatch):
    configured, dataset = base
    saved, keep = [], jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda df: (saved.append(set(df.columns)), keep(df))[1])
    rows = jobs.stored_rows(dataset.reviews)
    none = spark.createDataFrame([], "branchId string, reviewKey string")
    made = jobs.build_manual(configured, dataset.branches, None, rows, rows.where("id = '1'"), none, "now")
    meta = made.meta.first()
    assert (meta["reviewCount"], meta["manualReviewCount"], meta["manualBranchCounts"], meta["manualRemovalCount"]) == (2, 1, {"north": 1}, 0)
    assert meta["manualRemovedBranchCounts"] == {} and made.reviews.count() == 2 and not any("comment" in columns for columns in saved)
