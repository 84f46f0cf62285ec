"""Missing-value rules, text normalisers, keys, signatures and synthetic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators, prefixes and source names that are part of the data format.
KEY_SEPARATOR = "::"
SIGNATURE_SEPARATOR = "|"
MANUAL_ID_PREFIX = "manual-"
SCRAPED_ID_PREFIX = "apify-"
SOURCE_MANUAL = "manual update"
SOURCE_GOOGLE = "google"
ANONYMOUS = "Anonymous reviewer"

# Unicode white space plus the four separator controls that count as space in landed text.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c: Column | str) -> Column:
    """Trim every kind of white space; without a character list ``trim`` only knows the space."""
    return F.btrim(col(c), F.lit(SPACES))


def clean(c: Column | str) -> Column:
    """Null becomes the empty string, edges trimmed."""
    return ws_trim(F.coalesce(col(c), F.lit("")))


def nz(c: Column | str) -> Column:
    """Null when missing, where missing means null or the empty string."""
    c = col(c)
    return F.when(c != "", c)


def first_nonempty(*cs: Column | str) -> Column:
    """First value that is not missing; when all are missing the last one as it stands."""
    *head, last = [col(c) for c in cs]
    return F.coalesce(*[nz(c) for c in head], last)


def normalize_text(c: Column | str) -> Column:
    """Lower case, ``&`` to ``and``, hyphen to space, white space collapsed and trimmed."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    text = F.replace(text, F.lit("&"), F.lit("and"))
    text = F.replace(text, F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def normalize_match_text(c: Column | str) -> Column:
    """Like :func:`normalize_text`, but only ASCII letters and digits survive."""
    text = F.replace(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("&"), F.lit("and"))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def review_key(branch_id: Column | str = "branchId", review_id: Column | str = "id") -> Column:
    return F.concat(col(branch_id), F.lit(KEY_SEPARATOR), col(review_id))


def loose_signature() -> Column:
    """Branch, reviewer, first ten characters of the stored date string, whole rating."""
    return F.concat_ws(
        SIGNATURE_SEPARATOR,
        normalize_text("branchId"),
        normalize_text("reviewerName"),
        F.substring(F.coalesce(F.col("publishedAt"), F.lit("")), 1, 10),
        F.coalesce(F.col("rating"), F.lit(0)).cast("int").cast("string"),
    )


def exact_signature() -> Column:
    """The loose signature extended by the normalised comment."""
    return F.concat_ws(SIGNATURE_SEPARATOR, loose_signature(), normalize_text("comment"))


def is_google(c: Column | str = "reviewSource") -> Column:
    return normalize_text(c) == SOURCE_GOOGLE


def is_manual(c: Column | str = "reviewSource") -> Column:
    return normalize_text(c) == SOURCE_MANUAL


def synthetic_id(
    prefix: str,
    branch_id: Column | str,
    reviewer: Column | str,
    rating: Column | str,
    published_at: Column | str,
    comment: Column | str,
) -> Column:
    """Prefix plus the first 16 hex digits of a SHA-1 over the identifying fields."""
    text = F.concat_ws(
        SIGNATURE_SEPARATOR,
        col(branch_id),
        col(reviewer),
        col(rating).cast("string"),
        col(published_at),
        clean(comment),
    )
    return F.concat(F.lit(prefix), F.substring(F.sha1(text), 1, 16))
