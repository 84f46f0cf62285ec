"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers make all coordinates of a signature: the first scatters a shingle's
hash, the second, shifted round by k, ranks it for coordinate k; the coordinate is the lowest rank in the set.
``BANDS`` bands of ``ROWS`` coordinates find a pair at likeness 0.8 with a chance of 1 - (1 - 0.8 ** 8) ** 60,
more than 0.99998. Every candidate is confirmed on the full sets.

Documents with equal sets are one class; only the smallest id of a class goes on. Candidates are tested in
three rounds, each after the last one's components: every class with the smallest class of all its buckets,
then with the smallest class of each bucket, then, of buckets that still hold several components, the pairs of
different components that meet on a rare enough shingle (``rare_meetings``, which loses no pair that is alike).
What is left out is in one component already or can't be alike, so no link between components is lost, and a group
of near copies costs about one test per member rather than one per pair, also where many of its members are too
far from one another to be linked.

Defined cases: a null text or a text without words has the empty set and is linked with nothing; fewer words
than a shingle make one shingle; rows with equal ids are one node; a null id is linked with nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import wordhash
from reviewmill.llm.components import components
from reviewmill.llm.shared import saved

BANDS, ROWS = 60, 8
PERCENT = 80
#: Shingles worked on at a time.
_BLOCK = 1 << 16
#: Sizes of one class differ by less than this factor.
_SIZE_STEP = 1.03


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes, one row of ``bands`` for each set; sets are not empty."""
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    scattered = _scatter((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32))
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    rank, shifted = np.empty_like(scattered), np.empty_like(scattered)
    for band in range(bands):
        of_band = np.full(len(sets), band + 1, dtype=np.uint64)
        for row in range(rows):
            # The second permutation, shifted by the coordinate's number.
            np.subtract(scattered, np.uint32(band * rows + row), out=rank)
            np.multiply(rank, np.uint32(0x9E3779B1), out=rank)
            np.right_shift(rank, np.uint32(15), out=shifted)
            np.bitwise_xor(rank, shifted, out=rank)
            np.multiply(rank, np.uint32(0x85EBCA77), out=rank)
            np.right_shift(rank, np.uint32(13), out=shifted)
            np.bitwise_xor(rank, shifted, out=rank)
            of_band = wordhash.mix(of_band * np.uint64(0x100000001B3) + np.minimum.reduceat(rank, first))
        out[:, band] = of_band
    return out


def _sets_of(texts: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Position and shingle set of every text."""
    for begin, end in wordhash.chunks(texts):
        words = wordhash.Words(texts[begin:end], lower=True)
        for i in range(end - begin):
            yield begin + i, wordhash.shingle_set(words.hash[words.first[i] : words.first[i + 1]], k)


_SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])


def signed(docs: DataFrame, k: int) -> DataFrame:
    """Id, size and digest of the shingle set, and band hashes of every document; texts are read once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out: list[dict] = [{"doc_id": i, "n_shingles": 0, "set_id": None, "bands": None} for i in ids]
            waiting, size = [], 0

            def flush(waiting: list, out: list = out) -> None:
                if waiting:
                    bands = signatures([s for _, s in waiting]).view(np.int64).tolist()
                    for (at, _), row in zip(waiting, bands, strict=True):
                        out[at]["bands"] = row

            for at, found in _sets_of(wordhash.encoded(batch.column("text")), k):
                if len(found):
                    out[at]["n_shingles"] = len(found)
                    out[at]["set_id"] = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    waiting.append((at, found))
                    size += len(found)
                if size >= _BLOCK:
                    flush(waiting)
                    waiting, size = [], 0
            flush(waiting)
            yield pa.RecordBatch.from_pylist(out, schema=_SIGNED_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, _SIGNED)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, shingles`` as sorted arrays."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            sets = [s for _, s in _sets_of(wordhash.encoded(batch.column("text")), k)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``a, b`` whose full sets are alike enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _fits(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose sizes allow the likeness, each once."""
    rows = rows.where((F.col("a") != F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _need(a: Column | str, b: Column | str, percent: int) -> Column:
    """Least number of common shingles of sets of ``a`` and ``b`` shingles that are alike enough."""
    both = (F.col(a) if isinstance(a, str) else a) + (F.col(b) if isinstance(b, str) else b)
    return F.ceil(percent * both / F.lit(100 + percent))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(_SIZE_STEP)))


def rare_meetings(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b`` of different components that can be alike enough; every such pair that is alike is among them.

    ``members`` has ``id`` and component ``c``. Shingles are ordered by how many members have them, those of one
    component only first. The first shingle in that order that two sets share bounds how many they share: none
    before it counts. So it stands among the rarest of both, and pairs meet on it within a class of sizes. Members
    that are not alike share only what all their group has, which stands late, and don't meet.
    """
    known = sets.join(members, sets["doc_id"] == members["id"]).select("id", "c", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("row"), "shingles")
    each = known.select("id", "c", "n", "row", F.explode("shingles").alias("t"))
    shared = saved(each.groupBy("t").agg(F.count("*").alias("k"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("t", "k"))
    order = F.sort_array(F.collect_list(F.struct("k", "t")))
    ranked = each.join(shared, "t").groupBy("id", "c", "n", "row").agg(order.alias("met"))
    ranked = ranked.select("id", "c", "n", F.size("met").alias("m"), F.posexplode("met").alias("at", "met"))
    least = F.ceil(percent * F.col("n") / F.lit(100))
    ranked = ranked.select("id", "c", "n", (F.col("n") - F.col("m") + F.col("at")).alias("i"), F.col("met.t").alias("t"))
    ranked = saved(ranked.where(F.col("i") <= F.col("n") - _need(least, "n", percent)))

    small = ranked.where(F.col("i") <= F.col("n") - _need("n", "n", percent))
    small = small.select("t", _size_class(F.col("n")).alias("size"), F.col("id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"))
    large = ranked.withColumn("size", F.explode(F.sequence(_size_class(least), _size_class(F.col("n")))))
    lowest = F.greatest(least, F.ceil(F.pow(F.lit(_SIZE_STEP), F.col("size")) - 1e-6))
    large = large.where(F.col("i") <= F.col("n") - _need(lowest, "n", percent))
    large = large.select("t", "size", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= _need("na", "nb", percent)
    return _fits(small.join(large, ["t", "size"]).where(ordered & enough & (F.col("ca") != F.col("cb"))), percent)


def near_duplicates(docs: DataFrame, k: int = 2) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    marks = saved(signed(docs, k))
    classes = saved(marks.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("class_id")))
    heads = marks.join(classes, "set_id").where("doc_id = class_id").select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    full = heads.groupBy("band").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").drop("last")
    # Members of buckets with more than one class.
    buckets = saved(heads.join(full, "band").select("band", "leader", F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")))
    wanted = saved(buckets.select("id").distinct())
    sets = saved(shingle_sets(docs.select("doc_id", "text").join(wanted, docs["doc_id"] == wanted["id"], "left_semi"), k))
    sizes = buckets.select(F.col("id").alias("leader"), F.col("n").alias("n_leader")).distinct()

    def grouped(links: DataFrame) -> DataFrame:
        return saved(components(links))

    def placed(rows: DataFrame, groups: DataFrame, name: str, out: str) -> DataFrame:
        found = groups.select(F.col("id").alias(name), F.col("component").alias("_c"))
        return rows.join(found, name, "left").withColumn(out, F.coalesce("_c", name)).drop("_c")

    lowest = buckets.groupBy("id").agg(F.min("leader").alias("leader"), F.first("n").alias("n"))
    one = _fits(lowest.join(sizes, "leader").select(F.col("id").alias("a"), F.col("leader").alias("b"), F.col("n").alias("na"), F.col("n_leader").alias("nb")))
    links = saved(confirmed(one, sets))
    groups = grouped(links)

    each = buckets.where("id <> leader").select("id", "n", "leader").distinct().join(sizes, "leader")
    apart = placed(placed(each, groups, "id", "ci"), groups, "leader", "cl").where("ci <> cl")
    two = _fits(apart.select(F.col("id").alias("a"), F.col("leader").alias("b"), F.col("n").alias("na"), F.col("n_leader").alias("nb")))
    links = saved(links.union(confirmed(two, sets)))
    groups = grouped(links)

    known = placed(buckets, groups, "id", "c")
    mixed = known.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("band")
    open_ = saved(known.join(mixed, "band").select("id", "c").distinct())
    links = saved(links.union(confirmed(rare_meetings(open_, sets), sets)))
    groups = grouped(links)

    by_class = classes.join(groups.withColumnRenamed("id", "class_id"), "class_id", "left").select("set_id", F.coalesce("component", "class_id").alias("component"))
    rows = marks.select("doc_id", "n_shingles", "set_id").join(by_class, "set_id", "left")
    # Rows with one id but different texts are one node.
    own = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents),
s as (select doc_id, list_distinct(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                        when len(w) = 1 then w else [] end) s from w),
n as (select doc_id, coalesce(len(s), 0) n from s),
c as (select min(doc_id) rep, list_sort(s) s from s where len(s) > 0 group by list_sort(s)),
m as (select doc_id, rep from s join c on list_sort(s.s) = c.s),
r as (select rep, len(s) n, unnest(s) t from c),
d as (select a.rep a, b.rep b from r a join r b on a.t = b.t and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from d union all select b, a from d),
p as (select rep id, rep seen from c union select e.b, p.seen from p join e on e.a = p.id and p.seen < e.b),
g as (select id, min(seen) component from p group by id)
select n.doc_id, n.n::bigint n_shingles, coalesce(g.component, n.doc_id) component_id, coalesce(g.component, n.doc_id) = n.doc_id kept
from n left join m using (doc_id) left join g on g.id = m.rep
"""
