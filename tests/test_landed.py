"""Landed JSON lines are compressed and no file holds more than a bounded number."""

import gzip

from reviewmill.plans import cleaning_queries
from reviewmill.schemas import REVIEW_PAGE


def test_pages_are_written_compressed_in_small_files(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([{"branch_id": "n1", "page_no": n, "totalReviewCount": n, "reviews": [{"reviewId": str(n)}]} for n in range(1, 8)], REVIEW_PAGE)
    monkeypatch.setattr(cleaning_queries, "review_pages", lambda spark, sf_dir: pages.coalesce(1))
    monkeypatch.setattr(cleaning_queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(cleaning_queries, "SHARD_ROWS", 3, raising=False)
    row = cleaning_queries.explode_pages(spark, "").first()
    assert (row.pages, row.with_id, row.total_reviews) == (7, 7, 7)
    files = sorted((tmp_path / "pages").glob("part-*"))
    assert [f.suffix for f in files] == [".gz"] * 3 and max(len(gzip.open(f).readlines()) for f in files) == 3
