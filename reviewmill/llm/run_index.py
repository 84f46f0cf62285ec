"""Removal of long repeated byte strings with run-length indexes of the corpus's repeats.

A window is ``MATCH`` consecutive bytes of one document. A byte is removed if a window covers it whose bytes also
start anywhere else, in another document or the same one; windows are judged on the input.

1. Anchors. Of the ``GRAM``-byte strings in a window, the one with the lowest hash (the first such) is its anchor.
   Equal windows have equal anchors at equal places, and each window has one anchor, so an occurrence of an anchor
   owns a stretch of windows. Rows are anchor, hash of the stretch and where it is.
2. Repeats. Anchors that occur once own no repeat. Where all stretches of an anchor are the same, all are repeats.
   Of other anchors each different stretch is fetched once.
3. An anchor with more than ``MANY`` different stretches is split by where in a window it lies: windows of one half
   share a longer string around it, which is the anchor in the next round. After at most nine rounds a whole
   window is shared, so that no common passage of any length gathers all its surroundings in one task.
4. Index. Stretches of whole anchors are concatenated to texts of about ``TEXT`` bytes. Of each the Burrows-Wheeler
   transform is built, anchor by anchor, and kept as runs with the text places of both run ends and the common
   prefix at each border. The longest match of any place with another one follows from the last sampled run end
   before it in the text, less one per byte: these matching statistics are streamed over the stretches, and places
   with ``MATCH`` or more are marked.
5. What is marked is put together per document, and the rest is written.

Whole texts are moved once, into buckets; what is joined to them later moves instead. Stretches and rows are told
apart by 64-bit hashes, two of them per stretch. A null text is empty; a null id is an id like any other; repeated
rows are copies of each other; an empty table gives no rows; other columns are ignored. Texts of any length are read
in pieces that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import wordhash
from reviewmill.llm.phrase_dedup import Ranges
from reviewmill.llm.shared import bucketed, saved

MATCH, GRAM = 400, 64
#: Different stretches of an anchor to an index, and bytes of an index.
MANY, TEXT = 512, 1 << 20
#: Bytes of text read at once.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(13).integers(1, 1 << 62, 256, dtype=np.int64).view(np.uint64)


def _grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values from each place on."""
    step, size, out, done = values, 1, None, 0
    while True:
        if k & size:
            n = len(values) - done - size + 1
            out = step[:n] if out is None else out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + step[done : done + n]
            done += size
        if done == k:
            return wordhash.mix(out)
        step = step[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + step[size:]
        size *= 2


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of ``width`` values from each place on."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - width + span], values[width - span :]) if width > span else values


class Stretches:
    """Stretches of pieces of text laid end to end: ``low`` to ``high`` are first and last window, ``at`` the anchor."""

    def __init__(self, pieces: list[bytes], match: int, gram: int):
        data = np.frombuffer(b"\n".join(pieces), dtype=np.uint8)
        size = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
        self.first = np.concatenate(([0], np.cumsum(size + 1)))
        self.low = self.high = self.at = self.piece = np.zeros(0, dtype=np.int64)
        self.anchor = self.body = np.zeros(0, dtype=np.uint64)
        if len(data) < match:
            return
        grams, width = _grams(_VALUE[data], gram), match - gram + 1
        lowest = _slide(grams, width, np.minimum)
        whole = np.ones(len(lowest), dtype=bool)
        for start in self.first[1:-1]:
            whole[max(0, start - match) : start] = False
        # Runs of windows with one lowest hash.
        edge = np.flatnonzero((np.diff(lowest) != 0) | (whole[1:] != whole[:-1]))
        begin, end = np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(lowest) - 1]))
        begin, end = begin[whole[begin]], end[whole[end]]
        if not len(begin):
            return
        pad = np.zeros(width - 1, dtype=np.uint64)
        places = np.flatnonzero(grams == _slide(np.concatenate((pad, lowest, pad)), width, np.maximum))
        # A run's windows belong to the places of that hash in it, each window to the first from it on.
        kinds, kind = np.unique(grams[places], return_inverse=True)
        keys = kind * np.int64(len(data)) + places
        places, keys = places[np.argsort(keys)], np.sort(keys)
        run_kind = np.searchsorted(kinds, lowest[begin])
        a, b = (np.searchsorted(keys, run_kind * np.int64(len(data)) + x) for x in (begin, end))
        count = b - a + 1
        run = np.repeat(np.arange(len(begin)), count)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        self.at = places[a[run] + nth]
        self.high = np.minimum(self.at, end[run])
        self.low = np.where(nth == 0, begin[run], np.concatenate(([0], self.at[:-1])) + 1)
        self.anchor = grams[self.at]
        self.piece = np.searchsorted(self.first, self.low, side="right") - 1
        self.ranges, self.match, self.gram = Ranges(grams), match, gram
        self.body = self.hash(self.low, self.high + match)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes ``begin`` to ``end``, at least ``gram`` of them."""
        return self.ranges.hash(begin, end - self.gram + 1)


_ROW = "anchor long, body long, row long, begin int, end int, size int, at int, near int, far int, copies int"
_ROW_ARROW = pa.schema([(c, pa.int64() if c in ("anchor", "body", "row") else pa.int32()) for c in [x.split()[0] for x in _ROW.split(", ")]])


def _rows(anchor: np.ndarray, body: np.ndarray, row: np.ndarray, low: np.ndarray, size: np.ndarray, at: np.ndarray, near: int, far: int) -> pa.RecordBatch:
    """Stretches of rows as a batch; equal ones of a row are one, but for those that lie apart."""
    order = np.lexsort((low, body, anchor, row))
    anchor, body, row, low, size, at = (x[order] for x in (anchor, body, row, low, size, at))
    new = np.ones(len(row), dtype=bool)
    if len(row):
        new[1:] = (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1]) | (row[1:] != row[:-1]) | (low[1:] > low[:-1] + size[:-1])
    head = np.flatnonzero(new)
    copies = np.diff(np.append(head, len(row)))
    last = np.append(head[1:], len(row)) - 1 if len(head) else head
    ends = low[last] + size[last]
    fixed = [np.full(len(head), x) for x in (near, far)]
    columns = [anchor[head].view(np.int64), body[head].view(np.int64), row[head], low[head], ends, size[head], at[head] - low[head], *fixed, copies]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, _ROW_ARROW.types, strict=True)], schema=_ROW_ARROW)


def stretches(docs: DataFrame, match: int, gram: int) -> DataFrame:
    """All stretches of ``row, text``: where they ``begin`` and end, the anchor's place, and the places it may have in a window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        rows: list[int] = []
        offsets: list[int] = []

        def emit() -> pa.RecordBatch:
            found = Stretches(pieces, match, gram)
            row = np.array(rows, dtype=np.int64)[found.piece]
            shift = np.array(offsets, dtype=np.int64)[found.piece] - found.first[found.piece]
            size = found.high - found.low + match
            return _rows(found.anchor, found.body, row, found.low + shift, size, found.at + shift, 0, match - gram)

        size = 0
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), wordhash.encoded(batch.column("text")), strict=True):
                for offset in range(0, max(1, len(text) - match + 1), PIECE):
                    pieces.append(text[offset : offset + PIECE + match - 1])
                    rows.append(row)
                    offsets.append(offset)
                    size += len(pieces[-1])
                    if size >= PIECE:
                        yield emit()
                        pieces, rows, offsets, size = [], [], [], 0
        if pieces:
            yield emit()

    return docs.select("row", "text").mapInArrow(work, _ROW)


def halves(wanted: DataFrame, match: int, gram: int) -> DataFrame:
    """Stretches of documents with ``wanted`` stretches, split by the anchor's place in a window and named by what each half shares."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, asked in zip(batch.column("row").to_pylist(), wordhash.encoded(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
                data = np.frombuffer(text, dtype=np.uint8)
                begin, size, at, near, far, copies = (np.array([x[c] for x in asked], dtype=np.int64) for c in ("begin", "size", "at", "near", "far", "copies"))
                ranges = Ranges(_grams(_VALUE[data], gram))
                place, middle = begin + at, (near + far) // 2
                for low, high in ((near, middle), (middle + 1, far)):
                    a, b = np.maximum(begin, place - high), np.minimum(begin + size - match, place - low)
                    good = (a <= b) & (low <= high)
                    a, b, p, lo, hi, c = (x[good] for x in (a, b, place, low, high, copies))
                    core = wordhash.mix(ranges.hash(p - lo, p - hi + match - gram + 1) + (lo * match + hi).astype(np.uint64))
                    body = ranges.hash(a, b + match - gram + 1)
                    columns = [core.view(np.int64), body.view(np.int64), np.full(len(a), row), a, b + match, b - a + match, p - a, lo, hi, c]
                    yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(columns, _ROW_ARROW.types, strict=True)], schema=_ROW_ARROW)

    return wanted.select("row", "text", "asked").mapInArrow(work, _ROW)


def fetched(wanted: DataFrame) -> DataFrame:
    """``anchor, row, begin, copies, text``: the bytes of the ``asked`` stretches of documents."""
    schema = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("begin", pa.int32()), ("copies", pa.int64()), ("text", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, asked in zip(batch.column("row").to_pylist(), wordhash.encoded(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
                parts = [text[x["begin"] : x["begin"] + x["size"]] for x in asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["anchor"] for x in asked], pa.int64()), pa.array([row] * len(asked), pa.int64()), pa.array([x["begin"] for x in asked], pa.int32()),
                     pa.array([x["copies"] for x in asked], pa.int64()), pa.array(parts, pa.binary())], schema=schema,
                )

    return wanted.select("row", "text", "asked").mapInArrow(work, "anchor long, row long, begin int, copies long, text binary")


#: Symbols of the first sort, and bits of one.
_SYMBOLS, _BITS = 5, 9


class RunIndex:
    """Run-length Burrows-Wheeler transform of strings, group by group, with sampled run ends.

    Symbols are bytes plus one; every string ends with a border that equals nothing. ``head`` and ``tail`` are the
    text places of each run's first and last row, ``common`` the prefix that a run's first row has in common with the
    row before it.
    """

    def __init__(self, strings: list[bytes], groups: np.ndarray):
        size = np.fromiter((len(s) + 1 for s in strings), dtype=np.int64, count=len(strings))
        self.first = np.concatenate(([0], np.cumsum(size)))[:-1]
        self.n = n = int(size.sum())
        self.text = np.zeros(n, dtype=np.int16)
        inside = np.ones(n, dtype=bool)
        inside[self.first + size - 1] = False
        self.text[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int16) + 1
        string = np.repeat(np.arange(len(strings)), size)
        order = self._sorted(string, groups, inside)
        before = self.text[order - 1]
        # A string's first place follows a border, which is in no run with anything else.
        starts = np.zeros(n, dtype=bool)
        starts[self.first] = True
        alone = starts[order]
        group = groups[string[order]]
        edge = np.ones(n, dtype=bool)
        edge[1:] = (before[1:] != before[:-1]) | alone[1:] | alone[:-1] | (group[1:] != group[:-1])
        at = np.flatnonzero(edge)
        self.symbol, self.length = before[at], np.diff(np.append(at, n))
        self.head, self.tail = order[at], order[np.append(at[1:], n) - 1]
        self.common = np.zeros(len(at), dtype=np.int64)
        inner = np.flatnonzero(group[at[1:]] == group[at[1:] - 1]) + 1
        self.common[inner] = self._prefix(self.tail[inner - 1], self.head[inner])

    def _sorted(self, string: np.ndarray, groups: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Suffixes in order of group and symbols, equal ones by string; each round doubles the symbols compared."""
        n = self.n
        key = np.zeros(n, dtype=np.int64)
        open_ = np.ones(n, dtype=bool)
        padded = np.concatenate((self.text, np.zeros(_SYMBOLS, dtype=np.int16)))
        for k in range(_SYMBOLS):
            symbol = padded[k : k + n]
            open_ = open_ & (symbol > 0)
            key = (key << _BITS) | np.where(open_, symbol, 0)
        key |= groups[string] << (_SYMBOLS * _BITS)
        # Where a border is among the first symbols, the string decides; the sort is stable.
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(n, dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | ~open_[order[1:]]
        del key
        rank = np.empty(n, dtype=np.int64)
        start = np.flatnonzero(new)
        rank[order] = np.repeat(start, np.diff(np.append(start, n)))
        done = _SYMBOLS
        active = np.flatnonzero(~(new & np.append(new[1:], True)))
        while len(active):
            own = order[active]
            pair = rank[own] * n + rank[np.minimum(own + done, n - 1)]
            turn = np.argsort(pair)
            own, pair = own[turn], pair[turn]
            order[active] = own
            fresh = np.ones(len(own), dtype=bool)
            fresh[1:] = pair[1:] != pair[:-1]
            begin = np.flatnonzero(fresh)
            rank[own] = np.repeat(active[begin], np.diff(np.append(begin, len(own))))
            active = active[~(fresh & np.append(fresh[1:], True))]
            done *= 2
        return order

    def _prefix(self, a: np.ndarray, b: np.ndarray, step: int = 32) -> np.ndarray:
        """Common prefix of the suffixes at ``a`` and ``b``."""
        out = np.zeros(len(a), dtype=np.int64)
        text = np.concatenate((self.text, np.zeros(step, dtype=np.int16)))
        rows, along = np.arange(len(a)), np.arange(step)
        while len(rows):
            x, y = (text[np.minimum(v[rows] + out[rows], self.n)[:, None] + along] for v in (a, b))
            other = (x != y) | (x == 0)
            same = ~other.any(axis=1)
            out[rows] += np.where(same, step, other.argmax(axis=1))
            rows = rows[same]
        return out

    def matches(self) -> np.ndarray:
        """Matching statistics: how far the text from each place on also stands elsewhere in its group."""
        up, down = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        # Place and match add up to the same from one sampled run end to the next.
        up[self.head], down[self.tail] = self.head + self.common, self.tail + np.append(self.common[1:], 0)
        place = np.arange(self.n)
        return np.maximum(np.maximum.accumulate(up), np.maximum.accumulate(down)) - place


def matched(strings: DataFrame, match: int) -> DataFrame:
    """``row, begin, end`` of what stands more than once among the stretches of an anchor; of those with copies nothing."""
    schema = pa.schema([("row", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def emit(held: list[tuple]) -> pa.RecordBatch:
        anchors, rows, begins, copies, texts = zip(*held, strict=True)
        groups = np.cumsum(np.diff(np.array(anchors), prepend=anchors[0]) != 0)
        index = RunIndex(list(texts), groups)
        hit = index.matches() >= match
        edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        string = np.searchsorted(index.first, low, side="right") - 1
        alone = np.array(copies)[string] == 1
        low, high, string = low[alone], high[alone], string[alone]
        shift = np.array(begins, dtype=np.int64)[string] - index.first[string]
        return pa.RecordBatch.from_arrays([pa.array(np.array(rows, dtype=np.int64)[string]), pa.array(low + shift), pa.array(high + shift + match)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for one in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and one[0] != held[-1][0] and size >= TEXT:
                    yield emit(held)
                    held, size = [], 0
                if held and one[:3] == held[-1][:3]:
                    continue  # a repeated row
                held.append(one)
                size += len(one[4])
        if held:
            yield emit(held)

    rows = strings.select("anchor", "row", "begin", "copies", "text").repartition("anchor").sortWithinPartitions("anchor", "row", "begin")
    return rows.mapInArrow(work, "row long, begin long, end long")


def repeats(docs: DataFrame, match: int, gram: int, many: int) -> DataFrame:
    """``row, begin, end``: byte ranges of ``row, text`` that repeated windows cover."""
    marks, texts = [], None
    rows = saved(stretches(docs, match, gram))
    while True:
        shared = rows.groupBy("anchor").agg(F.sum("copies").alias("n"), F.min("body").alias("a"), F.max("body").alias("b"))
        shared = saved(shared.where("n > 1").select("anchor", (F.col("a") == F.col("b")).alias("same")))
        found = saved(rows.join(shared, "anchor"))
        marks.append(found.where("same").select("row", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end")))
        other = found.where("not same")
        one = F.min(F.struct("row", "begin", "size", "at", "near", "far")).alias("one")
        kinds = saved(other.groupBy("anchor", "body").agg(F.sum("copies").alias("copies"), one).select("anchor", "body", "copies", "one.*"))
        copied = kinds.where("copies > 1").select("anchor", "body")
        again = other.join(copied, ["anchor", "body"], "left_semi")
        marks.append(again.select("row", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end")))
        large = saved(kinds.groupBy("anchor").count().where(F.col("count") > many).select("anchor"))
        small = kinds.join(large, "anchor", "left_anti")
        texts = _asked(docs, small) if texts is None else texts.unionByName(_asked(docs, small))
        if not large.limit(1).count():
            break
        rows = saved(halves(_asked(docs, kinds.join(large, "anchor", "left_semi")), match, gram))
    marks.append(matched(fetched(texts), match))
    out = marks[0]
    for more in marks[1:]:
        out = out.unionByName(more)
    return out


def _asked(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Documents with the stretches wanted of them."""
    asked = kinds.groupBy("row").agg(F.collect_list(F.struct("anchor", "begin", "size", "at", "near", "far", "copies")).alias("asked"))
    return docs.join(asked, "row").select("row", "text", "asked")


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_KEPT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()),
])


def written(docs: DataFrame, texts: bool) -> DataFrame:
    """The result from documents with ``gone``, the byte ranges to remove, or null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, gone in zip(batch.column("doc_id").to_pylist(), wordhash.encoded(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
                kept, at, removed, spans = [], 0, 0, 0
                for begin, end in sorted((x["begin"], x["end"]) for x in gone or []):
                    if begin > at or not spans:
                        kept.append(text[at:begin])
                        spans += 1
                        at = begin
                    if end > at:
                        removed += end - at
                        at = end
                kept.append(text[at:])
                rest = b"".join(kept)
                digest = hashlib.sha256(rest).hexdigest()
                out.append({"doc_id": doc, "n_bytes": len(text), "n_removed": removed, "n_spans": spans, "kept_sha256": digest, "kept": rest if texts else None})
            yield pa.RecordBatch.from_pylist(out, schema=_KEPT_ARROW)

    return docs.select("doc_id", "text", "gone").mapInArrow(work, _KEPT)


def remove_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM, many: int = MANY, texts: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row; ``kept`` is null without ``texts``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) < match)
    none = written(short.withColumn("gone", F.lit(None).cast("array<struct<begin:long,end:long>>")), texts)
    long = docs.where(F.octet_length("text") >= match).withColumn("row", F.xxhash64("doc_id", "text"))
    long = bucketed(long, "row")
    marks = repeats(long.select("row", "text"), match, gram, many).distinct()
    gone = marks.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("gone"))
    return written(long.join(gone, "row", "left"), texts).unionByName(none)


SQL = r"""
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) x from documents),
w as (select r, x, unnest(range(0, length(x) // 2 - 399)) i from d where length(x) >= 800),
h as (select r, i, md5(substr(x, 2 * i + 1, 800)) h from w),
c as (select h from h group by h having count(*) > 1),
m as (select r, i from h semi join c using (h)),
l as (select r, i, case when i - lag(i) over (partition by r order by i) <= 400 then 0 else 1 end e from m),
g as (select r, i, sum(e) over (partition by r order by i) g from l),
s as (select r, min(i) a, max(i) + 400 b from g group by r, g),
p as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) z from s),
k as (select r, sum(b - a)::bigint n_removed, count(*) n_spans, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) kept
      from p join d using (r) group by r)
select doc_id, (length(x) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
       sha256(unhex(coalesce(kept, x))) kept_sha256
from d left join k using (r)
"""
