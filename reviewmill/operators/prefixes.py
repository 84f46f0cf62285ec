"""Prefix matches between two sets of texts by one pass in text order.

In sorted order a name that begins a title stands before it, everything between the two begins with the name as well,
and the names that a title begins stand right behind it. So a task that reads a range of texts in order needs a stack
of the texts that begin the present one, and a text costs one row whatever its length.

A match across the border of two ranges begins the first text of every later range up to the match. Each range
therefore tells, for every prefix of its first text, the first branch among its own names with that prefix; these few
rows (ranges times length of a text) settle both directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.session import cut_lineage

_FOUND = pa.schema(
    [("is_title", pa.bool_()), ("text", pa.string()), ("tier", pa.int32()), ("ord", pa.int64()), ("part", pa.int32()), ("shared", pa.int32())]
)
_FOUND_SQL = "is_title boolean, text string, tier int, ord bigint, part int, shared int"
#: Rows a task hands back at once.
_BATCH = 10_000


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _shared(a: str, b: str, most: int) -> int:
    """Length of the common beginning, at most ``most``."""
    if a[:most] == b[:most]:
        return min(most, len(a), len(b))
    return next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)


class _Open:
    """A text that begins the present one, with the first branch that begins it and the first that it begins."""

    __slots__ = ("above", "asked", "below", "own", "shared", "text")

    def __init__(self, text: str, own: int | None, asked: bool, above: int | None, shared: int):
        self.text, self.own, self.asked, self.above, self.shared = text, own, asked, above, shared
        self.below: int | None = None


def _found(rows: Iterator[tuple[str, int | None, bool, int]]) -> Iterator[tuple]:
    """Answers of one range, given its texts in order: a row per title, then one per prefix of the first text."""
    stack: list[_Open] = []
    first, part, same, least = "", 0, 0, None
    edges: list[tuple[int, int | None]] = []

    def close() -> Iterator[tuple]:
        done = stack.pop()
        if stack:
            stack[-1].below = _least(stack[-1].below, _least(done.own, done.below))
        if done.asked and done.own is not None:
            yield True, done.text, 1, done.own, part, done.shared
        elif done.asked:
            yield True, done.text, 2, _least(done.above, done.below), part, done.shared

    started = False
    for text, own, asked, part in rows:  # noqa: B020
        if not started:
            started, first, same = True, text, len(text)
        now = _shared(first, text, same)
        # Later texts share no more than this one does, so the longer prefixes are settled.
        edges.extend((n, least) for n in range(same, now, -1))
        same, least = now, _least(least, own) if now else least
        while stack and not text.startswith(stack[-1].text):
            yield from close()
        above = _least(stack[-1].above, stack[-1].own) if stack else None
        stack.append(_Open(text, own, asked, above, now))
    while stack:
        yield from close()
    edges.extend((n, least) for n in range(same, 0, -1))
    for n, own in edges:
        yield False, first[:n], None, own, part, n


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in ("text", "ord", "asked", "part")), strict=True)

    kept: list[tuple] = []
    for row in _found(rows()):
        kept.append(row)
        if len(kept) == _BATCH:
            yield _batch(kept)
            kept = []
    if kept:
        yield _batch(kept)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def nearest_names(titles: DataFrame, names: DataFrame) -> DataFrame:
    """The branch of each distinct ``title`` that equals, begins or continues a name: ``title, tier, branch_ord``.

    ``names`` has one ``branch_ord`` per distinct ``candidate``. Tier 1 is an equal name; tier 2 the smallest
    ``branch_ord`` of the names that begin the title or that the title begins. Titles that fit no name are left out,
    so are null and empty texts.
    """
    kind = names.schema["branch_ord"].dataType
    asked = titles.select(F.col("title").alias("text"), F.lit(None).cast("bigint").alias("ord"), F.lit(True).alias("asked"))
    known = names.select(F.col("candidate").alias("text"), F.col("branch_ord").cast("bigint").alias("ord"), F.lit(False).alias("asked"))
    texts = asked.unionByName(known).where("text != ''").groupBy("text").agg(F.min("ord").alias("ord"), F.max("asked").alias("asked"))
    ranges = texts.repartitionByRange("text").sortWithinPartitions("text").withColumn("part", F.spark_partition_id())
    found = cut_lineage(ranges.mapInArrow(_pass, _FOUND_SQL))

    edges = found.where("not is_title").select("text", "part", "shared", "ord")
    own = known.select("text", F.col("ord").alias("name_ord"))
    before = edges.join(own, "text").groupBy("part").agg(F.collect_list(F.struct("shared", "name_ord")).alias("before"))
    behind = edges.where("ord is not null").groupBy("text").agg(F.min("ord").alias("behind"))

    begun = F.transform(
        F.filter("before", lambda x: x["shared"] <= F.col("shared")), lambda x: x["name_ord"]
    )
    best = F.when(F.col("tier") == 1, F.col("ord")).otherwise(F.least("ord", F.array_min(begun), "behind"))
    rows = found.where("is_title").select("text", "tier", "ord", "part", "shared")
    rows = rows.join(cut_lineage(before), "part", "left").join(cut_lineage(behind), "text", "left")
    out = rows.select(F.col("text").alias("title"), "tier", best.cast(kind).alias("branch_ord"))
    return out.where("branch_ord is not null")
