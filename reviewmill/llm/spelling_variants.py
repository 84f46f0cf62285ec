"""Groups of spelling variants by blocked Gram matrices of letter counts.

Words are near if they differ by exactly one inserted, deleted or replaced code point. Then their letter counts
have a squared distance of 1 (adjacent lengths) or 2 (one length), and taking out the differing letter leaves
both with the same counts.

1. Words. Each task counts the runs of letters of whole texts and gives one row per word and chunk of texts.
2. Cells. Letters fall into ``CLASSES``. The cell of a word is its length and how many letters of each class it
   has. A word goes to its own cell and to each cell it would have without one letter: near words of adjacent
   lengths meet in the shorter one's cell, near words of one length where both lack the differing letter.
   Every near pair meets exactly once (words of one cell are compared where both lack their first class).
3. Blocks. Rows are sorted by cell; NumPy multiplies blocks of letter counts, which gives the squared distances
   of a block's words. A cell above ``CELL_ROWS`` is dealt to several tasks by pairs of parts.
4. Pairs at a squared distance of at most two are verified letter by letter, and a word's near words are summed
   in the task before they are shuffled.

A null text has no words. A null id deletes no code point. Repeated rows count each time; an empty table gives no
rows; other columns are ignored. Words of any length are compared whole. Ties go to the first in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.shared import saved

#: Shortest word, fewest occurrences, and one in how many runs loses a code point.
SHORTEST, FEWEST, SLIPS = 5, 3, 97
#: Letter classes of a cell: code points by their remainder.
CLASSES = 24
#: Rows of a cell to a task, and rows multiplied at once.
CELL_ROWS, BLOCK = 4096, 512
#: Distinct words a task holds while it counts.
HELD = 400_000
#: Code points of words that are compared at once.
LETTERS = 1 << 24

_LETTER = "A-Za-zÀ-ÿ"


def runs(text: str, doc_id: object, shortest: int = SHORTEST, slips: int = SLIPS) -> Counter:
    """Words of a text with their counts: lower-cased runs of letters, one code point less where ``slips`` divides the hash."""
    found: Counter = Counter()
    # Bytes have only A to Z in lower case.
    said = Counter(re.findall(f"[{_LETTER}]{{{shortest},}}", text.encode().lower().decode()))
    seed = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in said.items():
        if seed is not None:
            h = zlib.crc32(run.encode(), seed)
            if h % slips == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < shortest:
                    continue
        found[run] += n
    return found


def words(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """``word, n`` of words with ``fewest`` occurrences or more in all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.update(runs(text, doc, shortest))
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    return docs.select("doc_id", "text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _codes(said: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, end to end, and each word's first."""
    points = np.frombuffer("".join(said).encode("latin-1"), dtype=np.uint8)
    return points, np.concatenate(([0], np.cumsum([len(w) for w in said]))).astype(np.int64)


def _counts(points: np.ndarray, first: np.ndarray, kinds: int, of: np.ndarray) -> np.ndarray:
    """How often each word has each of ``kinds`` letters or classes; ``of`` names the kind of a code point."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(rows * kinds + of[points], minlength=(len(first) - 1) * kinds).reshape(-1, kinds)


_ALL = np.array([c for c in range(256) if re.match(f"[{_LETTER}]", chr(c)) and not 0x41 <= c <= 0x5A], dtype=np.uint8)
_LETTER_OF = np.zeros(256, dtype=np.int64)
_LETTER_OF[_ALL] = np.arange(len(_ALL))
_CLASS_OF = np.arange(256) % CLASSES
_CELL = pa.schema([("cell", pa.int64()), ("lacks", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
_WEIGHT = np.random.default_rng(11).integers(1, 1 << 62, CLASSES + 1, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def cells(found: DataFrame) -> DataFrame:
    """``cell, lacks, word, n``: a row for a word's own cell (``lacks`` -1) and one per class it has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(0).to_pylist()
            if not said:
                continue
            points, first = _codes(said)
            classes = _counts(points, first, CLASSES, _CLASS_OF)
            size = np.diff(first).astype(np.uint64)
            own = (classes.astype(np.uint64) * _WEIGHT[:CLASSES]).sum(axis=1, dtype=np.uint64) + size * _WEIGHT[CLASSES]
            row, lacks = np.nonzero(classes)
            less = own[row] - _WEIGHT[lacks] - _WEIGHT[CLASSES]
            every = np.concatenate((np.arange(len(said)), row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((own, less)).view(np.int64)),
                    pa.array(np.concatenate((np.full(len(said), -1), lacks)).astype(np.int32)),
                    batch.column(0).take(pa.array(every)),
                    batch.column(1).take(pa.array(every)),
                ],
                schema=_CELL,
            )

    return found.select("word", "n").mapInArrow(work, "cell long, lacks int, word string, n long")


def dealt(rows: DataFrame, most: int = CELL_ROWS) -> DataFrame:
    """``rows`` with ``low, high, part``: cells above ``most`` are cut into parts, and each pair of parts is one unit of work."""
    large = saved(rows.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > most))
    parts = F.coalesce(F.ceil(F.col("rows") / most), F.lit(1)).cast("int")
    rows = rows.join(large, "cell", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "lacks", "word", "n")


class _Block:
    """Rows of whole units of work, sorted by unit."""

    def __init__(self, rows: pa.Table, unit: np.ndarray):
        self.unit = unit
        self.said, self.n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        self.lacks = rows.column("lacks").to_numpy()
        self.part, self.split = rows.column("part").to_numpy(), (rows.column("low").to_numpy() != rows.column("high").to_numpy())
        self.points, self.first = _codes(self.said)
        self.size = np.diff(self.first)
        exact = np.float32 if len(self.said) == 0 or self.size.max() < 2000 else np.float64
        self.letters = _counts(self.points, self.first, len(_ALL), _LETTER_OF).astype(exact)
        self.norm = np.einsum("ij,ij->i", self.letters, self.letters)
        classes = _counts(self.points, self.first, CLASSES, _CLASS_OF)
        self.lowest = (classes > 0).argmax(axis=1)
        self.cell = classes
        real = self.lacks >= 0
        self.cell[real, self.lacks[real]] -= 1

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of one unit whose letter counts have a squared distance of one or two."""
        left, right, n = [], [], len(self.unit)
        last = np.searchsorted(self.unit, self.unit, side="right")
        for a in range(0, n, BLOCK):
            b = min(a + BLOCK, n)
            for c in range(a, int(last[b - 1]), BLOCK):
                d = min(c + BLOCK, int(last[b - 1]))
                away = self.norm[a:b, None] + self.norm[None, c:d] - 2 * (self.letters[a:b] @ self.letters[c:d].T)
                i, j = np.nonzero(away <= 2)
                i, j = i + a, j + c
                keep = (i < j) & (self.unit[i] == self.unit[j])
                left.append(i[keep])
                right.append(j[keep])
        if not left:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(left), np.concatenate(right)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Near rows; each pair once among all units of a cell and all cells."""
        i, j = self.close()
        a, b = self.lacks[i], self.lacks[j]
        keep = ((a >= 0) | (b >= 0)) & ((self.cell[i] == self.cell[j]).all(axis=1))
        # Two words of one cell meet in each cell that lacks a class: only the first of them counts.
        keep &= (a != b) | (self.lowest[i] == a)
        # Parts of a large cell meet in the unit of both; a part's own words in the unit of that part alone.
        keep &= ~self.split[i] | (self.part[i] != self.part[j])
        i, j = i[keep], j[keep]
        swap = self.size[i] < self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        good = np.zeros(len(i), dtype=bool)
        sizes = self.size[i] * 4096 + np.minimum(self.size[i] - self.size[j], 2)
        for kind in np.unique(sizes):
            at = np.flatnonzero(sizes == kind)
            length, less = int(self.size[i[at[0]]]), int(self.size[i[at[0]]] - self.size[j[at[0]]])
            step = max(1, LETTERS // length)
            for s in range(0, len(at) if less < 2 else 0, step):
                some = at[s : s + step]
                x = self.points[self.first[i[some], None] + np.arange(length)]
                y = self.points[self.first[j[some], None] + np.arange(length - less)]
                if less:
                    head = np.logical_and.accumulate(x[:, :-1] == y, axis=1).sum(axis=1)
                    tail = np.logical_and.accumulate((x[:, 1:] == y)[:, ::-1], axis=1).sum(axis=1)
                    good[some] = head + tail >= length - 1
                else:
                    good[some] = (x != y).sum(axis=1) == 1
        return i[good], j[good]

    def near(self) -> dict[str, tuple[int, int, str]]:
        """Of each word with near words: how many, the largest count of one, and the first of that count."""
        i, j = self.pairs()
        out: dict[str, tuple[int, int, str]] = {}
        for a, b in zip(np.concatenate((i, j)).tolist(), np.concatenate((j, i)).tolist(), strict=True):
            word, other, n = self.said[a], self.said[b], int(self.n[b])
            count, most, form = out.get(word, (0, -1, ""))
            if n > most or (n == most and other < form):
                most, form = n, other
            out[word] = (count + 1, most, form)
        return out


_NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("most", pa.int64()), ("form", pa.string())])


def compared(units: DataFrame) -> DataFrame:
    """``word, near, most, form``: what the units a task holds say of a word; several rows of a word add up."""

    def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        keys = [rows.column(c).to_numpy() for c in ("cell", "low", "high")]
        unit = np.cumsum(np.any([np.diff(k, prepend=k[:1]) != 0 for k in keys], axis=0))
        found = _Block(rows, unit).near()
        values = list(found.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), *[pa.array([v[k] for v in values], _NEAR.types[k + 1]) for k in range(3)]], schema=_NEAR
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = letters = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("cell", "low", "high")]
            starts = np.any([np.diff(k) != 0 for k in keys], axis=0)
            if held and any(k[0] != held[-1].column(c)[-1].as_py() for k, c in zip(keys, ("cell", "low", "high"), strict=True)):
                if size >= CELL_ROWS or letters >= LETTERS:
                    yield emit(held)
                    held, size, letters = [], 0, 0
            cut = np.flatnonzero(starts)
            if size + batch.num_rows >= CELL_ROWS and len(cut):
                # Whole units up to the last border go now; the unit that is still open waits for its other rows.
                at = int(cut[-1]) + 1
                yield emit([*held, batch.slice(0, at)])
                held, size, letters = [], 0, 0
                batch = batch.slice(at)
            held.append(batch)
            size += batch.num_rows
            letters += batch.nbytes
        if held:
            yield emit(held)

    units = units.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return units.mapInArrow(work, "word string, near long, most long, form string")


def near_words(found: DataFrame) -> DataFrame:
    """``word, n_near, most, form`` of each word of ``word, n`` that has near words; ``form`` is the near word of largest ``n``."""
    best = F.min(F.struct((-F.col("most")).alias("less"), "form")).alias("best")
    near = compared(dealt(cells(found))).groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return near.select("word", "n_near", (-F.col("best.less")).alias("most"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``, where a form's count is at least twice its word's, so that chains are short and end."""
    jumps = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = saved(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not longer.where("moved").limit(1).count():
            return longer.select("word", "root")
        jumps = longer.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``docs``."""
    found = saved(words(docs, shortest, fewest))
    named = F.when(F.col("most") >= 2 * F.col("n"), F.col("form"))
    out = found.join(near_words(found), "word", "left").withColumn("form_n", F.when(F.col("most") >= 2 * F.col("n"), F.col("most"))).withColumn("form", named)
    out = saved(out.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
    chains = roots(out.where("form is not null"))
    return out.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
with recursive poly as (select i, list_reduce(list_concat([i::bigint], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from range(256) t(i)),
crc as (select list(v order by i) t from poly),
r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w from documents),
d as (select doc_id, w, count(*) k from r where length(w) >= 5 group by all),
b as (select doc_id, w, k, hex(encode(doc_id || ':' || w)) u from d),
h as (select w, k, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(u), 2), lambda i: ('0x' || substr(u, i, 2))::bigint)),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) h from b, crc),
s as (select case when h % 97 = 0 then left(w, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end word, k from h),
v as (select word, sum(k)::bigint n from s where length(word) >= 5 group by word having sum(k) >= 3),
x as (select word, n, unnest(range(1, length(word) + 1)) i from v),
e as (select word, n, i, left(word, i - 1) || substr(word, i + 1) less from x),
p as (select a.word, b.word other, b.n m from e a join e b on a.less = b.less and a.i = b.i and a.word <> b.word and length(a.word) = length(b.word)
      union select e.word, v.word, v.n from e join v on e.less = v.word
      union select v.word, e.word, e.n from e join v on e.less = v.word),
q as (select word, count(*) n_near, max(m) most from p group by word),
f as (select word, min(other) form from p join q using (word) where m = most group by word),
o as (select v.word, case when most >= 2 * n then f.form end form, n, coalesce(n_near, 0)::bigint n_near, case when most >= 2 * n then most end form_n
      from v left join q using (word) left join f using (word)),
g as (select word, word here from o union all select g.word, o.form from g join o on o.word = g.here where o.form is not null)
select o.word, o.form, z.root, o.n, o.n_near, o.form_n
from o join (select g.word, g.here root from g join o on o.word = g.here where o.form is null) z on z.word = o.word
"""
