"""Figures as shown to readers: grouped integers, ratings, percentages, signed deltas, stars, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.functions.numbers import clamp, round_half_up_1
from reviewmill.functions.text import col

STAR, HOLLOW_STAR = "★", "☆"


def _number(c: Column | str) -> Column:
    n = col(c).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(0.0)).otherwise(n)


def show_integer(c: Column | str) -> Column:
    return F.format_number(F.floor(_number(c) + 0.5).cast("bigint"), 0)


def show_rating(c: Column | str) -> Column:
    """One decimal, ``0.0`` for anything not above zero."""
    n = _number(c)
    return F.when(n <= 0, F.lit("0.0")).otherwise(F.format_string("%.1f", round_half_up_1(n)))


def show_percent(c: Column | str) -> Column:
    """At most one decimal, no trailing zero."""
    n = round_half_up_1(_number(c))
    whole = n == F.floor(n)
    return F.concat(
        F.when(whole, F.floor(n).cast("bigint").cast("string")).otherwise(F.format_string("%.1f", n)),
        F.lit("%"),
    )


def _signed(number: Column, magnitude: Column, zero: str) -> Column:
    return (
        F.when(number > 0, F.concat(F.lit("+"), magnitude))
        .when(number < 0, F.concat(F.lit("-"), magnitude))
        .otherwise(F.lit(zero))
    )


def show_signed_integer(c: Column | str) -> Column:
    n = _number(c)
    return _signed(n, show_integer(F.abs(n)), "0")


def show_signed_decimal(c: Column | str) -> Column:
    n = _number(c)
    cents = F.floor(F.abs(n) * 100 + 0.5) / 100
    return _signed(n, F.format_string("%.2f", cents), "0.00")


def show_stars(c: Column | str) -> Column:
    full = clamp(F.floor(_number(c) + 0.5), 0, 5).cast("int")
    return F.concat(F.repeat(F.lit(STAR), full), F.repeat(F.lit(HOLLOW_STAR), F.lit(5) - full))


def _british(c: Column, layout: str) -> Column:
    # British English shortens September to four letters, the formatter's locale to three.
    return F.regexp_replace(F.date_format(c, layout), r"\bSep\b", "Sept")


def show_date(ts: Column | str, zone: str) -> Column:
    local = F.from_utc_timestamp(col(ts), zone)
    return F.coalesce(_british(local, "dd MMM yyyy"), F.lit("No date"))


def show_date_time(ts: Column | str, zone: str) -> Column:
    local = F.from_utc_timestamp(col(ts), zone)
    return F.coalesce(_british(local, "dd MMM yyyy, HH:mm"), F.lit("Unavailable"))


def mode_label(c: Column | str) -> Column:
    # Dataset modes and their labels.
    return (
        F.when(col(c) == "live", "Live data").when(col(c) == "manual", "Manual refresh").otherwise("Demo data")
    )
