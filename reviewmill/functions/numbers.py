"""Numeric parsing, rounding, averages and the rating estimators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.functions.text import clean, col, ws_trim

# Rating words used by the paged review payloads.
STAR_WORDS = {"ONE": 1, "TWO": 2, "THREE": 3, "FOUR": 4, "FIVE": 5}

# Words read as true in the additions file.
TRUE_WORDS = ("1", "true", "yes", "y")

# How every text begins that reads as a number; a cast of any other costs an exception and gives null as well.
_NUMBER_START = r"^[\x00-\x20]*[-+]?(\.?[0-9]|[iI][nN][fF]|[nN][aA][nN])"

# How every text looks that reads as a whole number, as above.
_WHOLE_NUMBER = r"^[\x00-\x20\x7f]*[-+]?[0-9]+[\x00-\x20\x7f]*$"

# Fixed value: from this rating on no further lift is estimated.
NEAR_PERFECT = 4.95


def whole_number(c: Column | str) -> Column:
    """Whole number after trimming, null when the text is anything else."""
    text = ws_trim(c)
    return F.when(text.rlike(_WHOLE_NUMBER), text.try_cast("bigint"))


def parse_rating(c: Column | str) -> Column:
    """Whole number from 1 to 5, null otherwise; the checks report the nulls."""
    n = whole_number(c)
    return F.when(n.between(1, 5), n.cast("int"))


def star_word(c: Column | str) -> Column:
    """Rating word to 1..5; any other text, digits included, is 0."""
    lookup = F.create_map(*[F.lit(x) for pair in STAR_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.upper(clean(c))), F.lit(0))


def star_number(c: Column | str) -> Column:
    """Numeric rating cut to a whole number; outside 1..5 it is 0."""
    n = col(c).try_cast("int")
    return F.coalesce(F.when(n.between(1, 5), n), F.lit(0))


def optional_int(c: Column | str) -> Column:
    return F.coalesce(whole_number(c), F.lit(0))


def optional_bool(c: Column | str) -> Column:
    return F.lower(clean(c)).isin(*TRUE_WORDS)


def first_number(*cs: Column | str) -> Column:
    """First value of texts or numbers that parses as a number, 0.0 when none does. A parsed 0 wins over a later 4."""
    return F.coalesce(*[F.when(col(c).rlike(_NUMBER_START), col(c).try_cast("double")) for c in cs], F.lit(0.0))


def to_int(c: Column) -> Column:
    """Cut a number towards zero; not-a-number and overflow become 0."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def positive_or(reported: Column | str, fallback: Column | str) -> Column:
    """A reported figure when it is a finite number above 0, else the computed one."""
    n = col(reported).try_cast("double")
    usable = n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < float("inf"))
    return F.when(usable, n).otherwise(col(fallback).cast("double"))


def round_half_up_1(c: Column | str) -> Column:
    return F.floor(col(c) * 10 + 0.5) / F.lit(10.0)


def avg_positive(c: Column | str) -> Column:
    """Aggregate: mean over values above 0, and 0.0 for no such value."""
    c = col(c)
    return F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0))


def ratio_or_zero(part: Column, total: Column) -> Column:
    return F.when(total != 0, part.cast("double") / total).otherwise(F.lit(0.0))


def percentage(part: Column | str, total: Column | str) -> Column:
    return ratio_or_zero(col(part), col(total)) * 100


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def five_stars_for_lift(rating: Column | str, count: Column | str, step: float = 0.1) -> Column:
    """How many further 5-star reviews raise the shown rating by ``step``.

    Kept in doubles on purpose: 4.8 with 100 reviews gives 101.
    """
    r, n = col(rating).cast("double"), col(count).cast("double")
    target = F.least(F.lit(5.0), round_half_up_1(r + step))
    room = F.lit(5.0) - target
    done = (r == 0) | (n == 0) | (r >= NEAR_PERFECT) | (room <= 0)
    need = F.ceil(n * (target - r) / F.when(room > 0, room))
    return F.when(done, F.lit(0)).otherwise(F.greatest(F.lit(0), need)).cast("bigint")


def lift_target(rating: Column | str, step: float = 0.1) -> Column:
    return F.least(F.lit(5.0), round_half_up_1(col(rating) + step))


def one_star_impact(rating: Column | str, count: Column | str, one_stars: Column | str) -> Column:
    """Change of the rating caused by the given number of one-star reviews."""
    r, n, k = (col(c).cast("double") for c in (rating, count, one_stars))
    none = (r == 0) | (n == 0) | (k == 0) | (n <= k)
    rest = F.when(n > k, n - k)
    return F.when(none, F.lit(0.0)).otherwise(r - (r * n - k) / rest)
