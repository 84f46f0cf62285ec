"""CSV files read by many tasks: rows know their file and line, records may span blocks, repeated keys may own most rows."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from reviewmill.operators import dedup, quality
from reviewmill.operators.dedup import mark_repeats
from reviewmill.plans import jobs
from reviewmill.schemas import ADDITIONS
from reviewmill.sources.csv_inputs import has_content, read_csv
from reviewmill.sources.csv_records import ends_open
from tests.test_jobs import HEADER, base  # noqa: F401


@pytest.mark.parametrize(
    ("line", "from_start", "from_inside"),
    [
        ("a,b", False, True), ('"a', True, False), ('"a""b', True, False), ('a"b,c', False, False), ('a,"b",c', False, False),
        ('"",x', False, True), ('"""', True, False), ('x,"', True, False), ("", False, True), ('",', True, False), ('"a",', False, False),
    ],
)
def test_quote_state_of_a_line(line, from_start, from_inside):
    assert ends_open(line, False) == from_start and ends_open(line, True) == from_inside


def test_records_over_many_blocks(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        [str(i), rng.choice(["plain", "", "two\nlines", 'say "x", "y"\n\n"', "\n" * 40, "long, " * 60, 'quote " inside'])]
        for i in range(400)
    ]
    for name, part in (("a.csv", rows[:50]), ("b.csv", rows[50:])):
        text = io.StringIO()
        writer = csv.writer(text, lineterminator="\r\n" if name == "a.csv" else "\n")
        writer.writerows([["n", "text"], *part])
        (tmp_path / name).write_bytes(("﻿" + text.getvalue().replace("\n7,", "\n\n7,")).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        schema = T.StructType([T.StructField("n", T.StringType()), T.StructField("text", T.StringType())])
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = read_csv(spark, str(tmp_path), schema).orderBy("row_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks > 20
    # The file that sorts last is the larger one, which Spark would read first.
    assert [(r.n, r.text or "") for r in got] == [(n, t) for n, t in rows]
    assert [(r.file, r.row) for r in got] == [("a.csv", i + 2) for i in range(50)] + [("b.csv", i + 2) for i in range(350)]


def test_first_rows_of_a_key_that_owns_most_rows(spark):
    rows = [("spam" if i % 3 else f"k{i % 40}", i) for i in range(3000)] + [(None, 5000), (None, 5001)]
    df = spark.createDataFrame(rows, "key string, nr long").repartition(7)
    marked = mark_repeats(df, "key", "nr")
    plan = marked._jdf.queryExecution().analyzed().toString()
    assert "key" not in plan.split("Join")[1].split("\n")[0]
    got = {r.nr for r in marked.collect() if not r.repeated}
    first = {}
    for k, n in rows:
        first.setdefault(k if k else n, n)
    assert got == set(first.values())


def test_mistakes_name_file_and_row(spark, tmp_path, base):  # noqa: F811
    configured, dataset = base
    (tmp_path / "a.csv").write_text(f'{HEADER}\nnorth,ann,5,2026-01-01,"two\nlines",,,,,,,,\n\nnorth,bob,9,2026-01-01,,,,,,,,,\n')
    with pytest.raises(quality.CheckFailed, match=r"a\.csv row 3: rating must be between 1 and 5"):
        jobs.manual_rebuild(spark, configured, dataset, str(tmp_path / "a.csv"), "none", str(tmp_path / "out"), "x")


def test_a_record_is_parsed_once_however_many_fields_are_asked(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text(f"{HEADER}\nnorth,ann,5,2026-01-01,,,,,,,,,\n")
    rows = read_csv(spark, str(tmp_path / "a.csv"), ADDITIONS)
    rows = rows.where(has_content(ADDITIONS.fieldNames()))
    rows.explain("formatted")
    assert capsys.readouterr().out.count("from_csv") == 1 and rows.count() == 1


def test_repeats_are_marked_with_one_copy_of_the_rows(spark, monkeypatch):
    wide, keep = [], dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: (wide.append(1) if "text" in df.columns else None, keep(df))[1])
    rows = [("a", 1, "x"), ("b", 2, "x"), ("a", 3, "y"), (None, 4, "z"), (None, 5, "z")]
    marked = mark_repeats(spark.createDataFrame(rows, "key string, nr long, text string"), "key", "nr")
    assert {r.nr: r.repeated for r in marked.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False} and len(wide) == 1
