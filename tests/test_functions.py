"""Literal cases for parsing, rounding, estimates and display."""

import operator
from datetime import datetime
from functools import reduce

import pytest
from pyspark.sql import functions as F

from reviewmill.functions import dates, display, numbers, predicates, text


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def evaluate(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r[0] for r in df.select("i", make("v").alias("o")).orderBy("i").select("o").collect()]


def test_typed_dates(spark):
    cases = {
        "2026-04-13": "2026-04-13T12:00:00Z",
        "13/04/2026": "2026-04-13T12:00:00Z",
        "3 Apr 2026": "2026-04-03T12:00:00Z",
        "13 Apr 2026": "2026-04-13T00:00:00Z",
        " 2026-04-10 12:48 ": "2026-04-10T12:48:00Z",
        "1/4/2026 9:05": "2026-04-01T09:05:00Z",
        "13 apr 2026 07:30": "2026-04-13T07:30:00Z",
        "2026-04-13T10:00:00+02:00": "2026-04-13T08:00:00Z",
        "2026-04-13T10:00:00+0200": "2026-04-13T08:00:00Z",
        "2026-04-13T10:00:00Z": "2026-04-13T10:00:00Z",
        "soon": None,
        "": None,
        None: None,
        "2026-02-30": None,
    }
    assert evaluate(spark, list(cases), dates.normalize_date) == list(cases.values())


def test_ratings_and_casts(spark):
    assert evaluate(spark, ["5", " 3\t", "6", "4.5", "x", "", None, "0"], numbers.parse_rating) == [5, 3, None, None, None, None, None, None]
    assert evaluate(spark, ["ONE", " five ", "5", None, "SIX"], numbers.star_word) == [1, 5, 0, 0, 0]
    assert evaluate(spark, ["12", "-3", "many", None], numbers.optional_int) == [12, -3, 0, 0]
    assert evaluate(spark, ["1", "Yes", " y", "TRUE", "no", None], numbers.optional_bool) == [True, True, True, True, False, False]
    assert one(spark, numbers.first_number(F.lit("0"), F.lit("4"))) == 0.0
    assert one(spark, numbers.first_number(F.lit("x"), F.lit("4"))) == 4.0


def test_numbers_are_cast_only_where_they_can_be(spark):
    texts = ["4", " 4.5 ", "\t-1e3", "+.5", "5.", "NaN", "inf", "-Infinity", "+infinity", "1.5f", "2d", "0x1p3", "n/a", "x", "", "- 1", ".", "info", "4 stars", None]
    plain = evaluate(spark, texts, lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    assert repr(evaluate(spark, texts, numbers.first_number)) == repr(plain)
    assert evaluate(spark, [4, -2, None], numbers.first_number, "int") == [4.0, -2.0, 0.0]
    assert "RLIKE" in str(numbers.first_number("v")).upper()


def test_text_normalisers(spark):
    assert evaluate(spark, ["  Tom & Co-Op\n Ltd ", "a_b É", None], text.normalize_text) == ["tom and co op ltd", "a_b é", ""]
    assert evaluate(spark, ["  Tom & Co-Op ", "a_b É!", None], text.normalize_match_text) == ["tom and co op", "a b", ""]
    assert evaluate(spark, ["  x \t\x1c", "  ", None], text.clean) == ["x", "", ""]
    assert one(spark, text.first_nonempty(F.lit(""), F.lit(None).cast("string"), F.lit(""))) == ""


def test_rounding_and_estimates(spark):
    assert evaluate(spark, [4.25, 4.35, 4.05, 0.0], numbers.round_half_up_1, "double") == [4.3, 4.4, 4.1, 0.0]
    assert one(spark, numbers.five_stars_for_lift(F.lit(4.8), F.lit(100))) == 101
    assert one(spark, numbers.five_stars_for_lift(F.lit(4.95), F.lit(100))) == 0
    assert one(spark, numbers.five_stars_for_lift(F.lit(4.9), F.lit(10))) == 0
    assert one(spark, numbers.one_star_impact(F.lit(4.0), F.lit(10), F.lit(1))) == pytest.approx(4 - 39 / 9)
    assert one(spark, numbers.one_star_impact(F.lit(4.0), F.lit(2), F.lit(2))) == 0.0
    assert one(spark, numbers.positive_or(F.lit("n/a"), F.lit(3)), numbers.positive_or(F.lit("0"), F.lit(3)), numbers.positive_or(F.lit("7"), F.lit(3))) == (3.0, 3.0, 7.0)


def test_display(spark):
    assert evaluate(spark, [1234567.0, 0.0], display.show_integer, "double") == ["1,234,567", "0"]
    assert evaluate(spark, [4.25, -1.0, None], display.show_rating, "double") == ["4.3", "0.0", "0.0"]
    assert evaluate(spark, [45.0, 45.26, 0.0], display.show_percent, "double") == ["45%", "45.3%", "0%"]
    assert evaluate(spark, [0.126, -0.5, 0.0], display.show_signed_decimal, "double") == ["+0.13", "-0.50", "0.00"]
    assert evaluate(spark, [3.0, -1200.0, 0.0], display.show_signed_integer, "double") == ["+3", "-1,200", "0"]
    assert evaluate(spark, [3.5, 0.0, 7.0], display.show_stars, "double") == ["★★★★☆", "☆☆☆☆☆", "★★★★★"]
    moment = F.lit(datetime(2026, 9, 30, 23, 5)).cast("timestamp")
    assert one(spark, display.show_date(moment, "Africa/Johannesburg")) == "01 Oct 2026"
    assert one(spark, display.show_date_time(moment, "UTC")) == "30 Sept 2026, 23:05"


def test_local_calendar_follows_daylight_saving(spark):
    moments = ["2026-03-29 22:30:00", "2026-03-28 22:30:00"]
    days = evaluate(spark, moments, lambda c: dates.zoned_date(F.col(c).cast("timestamp"), "Europe/Berlin").cast("string"))
    assert days == ["2026-03-30", "2026-03-28"]


def test_window_bounds(spark):
    now = datetime(2026, 4, 10, 12, 0)
    moments = ["2026-03-11 12:00:00", "2026-03-11 11:59:59", "2026-04-10 12:00:00", "2026-05-01 00:00:00"]
    assert evaluate(spark, moments, lambda c: dates.since(F.col(c).cast("timestamp"), now, 30)) == [True, False, True, True]
    assert evaluate(spark, moments, lambda c: dates.in_period(F.col(c).cast("timestamp"), now, 0, 30)) == [True, False, False, False]


def test_month_to_date_uses_the_local_month(spark):
    now = datetime(2026, 4, 10, 12, 0)
    moments = ["2026-03-31 22:00:00", "2026-03-31 21:59:59", "2026-04-30 21:59:59", "2026-04-30 22:00:00"]
    got = evaluate(spark, moments, lambda c: dates.in_current_month(F.col(c).cast("timestamp"), now, "Africa/Johannesburg"))
    assert got == [True, False, True, False]


def test_predicates(spark):
    assert one(spark, predicates.has_comment(F.lit(" "), F.lit("there"))) is False
    assert one(spark, predicates.has_comment(F.lit(""), F.lit("there"))) is True
    assert one(spark, predicates.is_low(F.lit(0))) is True
    assert one(spark, predicates.display_comment(F.lit(""), F.lit(None).cast("string"))) == predicates.NO_COMMENT


def test_synthetic_id(spark):
    import hashlib

    want = "manual-" + hashlib.sha1("b|Ann|5|2026-01-01T12:00:00Z|fine".encode()).hexdigest()[:16]
    assert one(spark, text.synthetic_id("manual-", F.lit("b"), F.lit("Ann"), F.lit(5), F.lit("2026-01-01T12:00:00Z"), F.lit(" fine\n"))) == want


def test_a_date_layout_is_tried_only_on_texts_it_can_fit(spark):
    """Failed tries cost an exception each; as many layouts were tried on every text."""
    texts = {
        "2026-01-02": "2026-01-02T12:00:00Z", "2026-1-2 3:04": "2026-01-02T03:04:00Z", "2/1/2026": "2026-01-02T12:00:00Z",
        "2/1/2026 3:04": "2026-01-02T03:04:00Z", "2 Jan 2026": "2026-01-02T12:00:00Z", "12 sep 2026 03:04": "2026-09-12T03:04:00Z",
        "2026-1-2T3:4:5+01:00": "2026-01-02T02:04:05Z", "2026-1-2t3:4:5Z": "2026-01-02T03:04:05Z", "2026-1-2T3:4:5+0100": "2026-01-02T02:04:05Z",
        "soon": None, "31/4/2026": None, "": None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.d for r in rows.select("t", dates.normalize_date("t").alias("d")).collect()} == texts
    fits = [dates._fits(F.col("t"), *marks).cast("int") for marks in (dates.OFFSET_LAYOUTS | dates.PLAIN_LAYOUTS).values()]
    tried = {r.t: r.n for r in rows.select("t", reduce(operator.add, fits).alias("n")).collect()}
    assert tried["2026-01-02"] <= 2 and tried["2/1/2026"] <= 2 and tried["soon"] <= 2
