"""Row predicates over canonical reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.functions.text import clean, col, first_nonempty

# Fixed value: shown in place of a comment that was left out.
NO_COMMENT = "No written comment on this review."


def has_comment(comment: Column | str = "comment", translated: Column | str = "commentTranslated") -> Column:
    """A comment that holds more than white space; the translation only stands in for an empty one."""
    return clean(first_nonempty(comment, translated)) != ""


def has_response(response: Column | str = "ownerResponseText") -> Column:
    return clean(response) != ""


def is_low(rating: Column | str = "rating") -> Column:
    """Two stars or fewer; an unknown rating (0) is low."""
    return col(rating) <= 2


def is_positive(rating: Column | str = "rating") -> Column:
    return col(rating) >= 4


def is_one_star(rating: Column | str = "rating") -> Column:
    return col(rating) == 1


def needs_follow_up(rating: Column | str = "rating", response: Column | str = "ownerResponseText") -> Column:
    """Three stars or fewer and nobody answered."""
    return (col(rating) <= 3) & ~has_response(response)


def display_comment(comment: Column | str = "comment", translated: Column | str = "commentTranslated") -> Column:
    return F.coalesce(F.when(first_nonempty(comment, translated) != "", first_nonempty(comment, translated)), F.lit(NO_COMMENT))
