"""Exact ranked search of documents by their words in sparse ball trees.

A document's vector has an integer for each searched term, by how often the document says it and by its length; an
item's has the terms' weights. The score is their inner product, in integers.

1. Items are searched in blocks of about ``ITEM_BLOCK``, so that the terms of a block are few whatever the number of
   items. Each task turns whole texts into vectors over these terms; counts of documents, words and documents per
   term come from all of them.
2. Documents are dealt out by their heaviest term, so that those with the same rare words lie together, and cut into
   trees of bounded size. Each half of a tree's documents, along the line between two far ones, is a node with its
   centroid and two radii that hold its documents: the Euclidean one, and how far they reach along each term.
   Coordinates are scaled by the root of the weights, which leaves products unchanged and keeps common words from
   filling the radius. Trees are written as a table.
3. An item's nodes are visited best first by ``q·centre`` plus the smaller of ``|q|·radius`` and ``q·reach``, rounded
   up beyond any error of the sums. (An item has few of the terms, where documents lie far apart in the others:
   mostly the reach decides.) A subtree below the item's worst kept score is skipped; a leaf's scores are exact
   64-bit integers. The first trees are searched alone to begin with: their worst kept scores are lower bounds for
   all others.
4. Of each task's trees the best of each item remain, and Spark ranks these.

Terms are compared by 64-bit hashes. A null text has no terms; a null id comes last among equal scores; rows are
documents even if they repeat; an item's terms are those of all rows with its id; no documents or items give no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm import wordhash
from reviewmill.llm.shared import saved

TOP = 50
#: Items searched together, documents and dense cells of a tree, documents of a leaf, trees for the first bounds.
ITEM_BLOCK, TREE, CELLS, LEAF, FIRST_TREES = 256, 4096, 1 << 24, 64, 4
#: A null id, after all others.
_LAST = (1 << 63) - 1

_VECTOR = "doc long, n long, term array<int>, tf array<int>"
_VECTOR_ARROW = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.astype(np.int32)))


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: hashes of the distinct terms of each item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in wordhash.chunks(texts := wordhash.encoded(batch.column("text"))):
                words = wordhash.Words(texts[begin:end], wordhash.ALNUM, lower=True)
                of = np.repeat(np.arange(begin, end), np.diff(words.first))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").cast(pa.int64()).take(pa.array(of)), pa.array(words.hash.view(np.int64))], ["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(work, "item_id long, term long").distinct()


def vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``doc, n, term, tf`` of every document: its words, and which of the sorted ``terms`` it has how often."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for begin, end in wordhash.chunks(texts := wordhash.encoded(batch.column("text"))):
                words = wordhash.Words(texts[begin:end], wordhash.ALNUM, lower=True)
                of = np.repeat(np.arange(end - begin), np.diff(words.first))
                at = np.minimum(np.searchsorted(terms, words.hash), len(terms) - 1)
                known = terms[at] == words.hash
                pair, tf = np.unique(of[known] * len(terms) + at[known], return_counts=True)
                ends = np.cumsum(np.bincount(pair // len(terms), minlength=end - begin))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[begin:end]), pa.array(np.diff(words.first)), _lists(pair % len(terms), ends), _lists(tf, ends)], schema=_VECTOR_ARROW
                )

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text").mapInArrow(work, _VECTOR)


def weights(found: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """The weight of each term, how many documents have a word, and all their words."""
    total = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    having = np.zeros(terms, dtype=np.int64)
    # One row per term of the block.
    for row in found.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        having[row.term] = row["count"]
    docs = total.docs
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(k) + 1))) for k in having], dtype=np.int64), docs, total.words


_TREE = "doc array<long>, begin array<int>, term array<int>, value array<long>, column array<int>, centre binary, reach binary, radius array<double>, depth int, first boolean"
_TREE_ARROW = pa.schema([
    ("doc", pa.list_(pa.int64())), ("begin", pa.list_(pa.int32())), ("term", pa.list_(pa.int32())), ("value", pa.list_(pa.int64())),
    ("column", pa.list_(pa.int32())), ("centre", pa.binary()), ("reach", pa.binary()), ("radius", pa.list_(pa.float64())), ("depth", pa.int32()), ("first", pa.bool_()),
])


def spans(n: int, depth: int) -> list[tuple[int, int]]:
    """Documents of each node, halved ``depth`` times; node k has 2k + 1 and 2k + 2 below it."""
    out = [(0, n)]
    for k in range((1 << depth) - 1):
        low, high = out[k]
        out += [(low, (low + high) // 2), ((low + high) // 2, high)]
    return out


def _tree(docs: np.ndarray, begin: np.ndarray, term: np.ndarray, value: np.ndarray, scale: np.ndarray) -> dict:
    """A ball tree of documents; document i has ``term`` and ``value`` from ``begin[i]`` to ``begin[i + 1]``."""
    column, place = np.unique(term, return_inverse=True)
    n, row = len(docs), np.repeat(np.arange(len(docs)), np.diff(begin))
    points = np.zeros((n, len(column)), dtype=np.float32)
    points[row, place] = value * scale[term]
    depth = max(0, math.ceil(math.log2(n / LEAF)))
    order = np.arange(n)
    ranges = spans(n, depth)
    centre, radius = np.zeros((len(ranges), len(column)), dtype=np.float32), []
    reach = np.zeros_like(centre)
    for k, (low, high) in enumerate(ranges):
        own = points[order[low:high]]
        centre[k] = own.mean(axis=0)
        away = own - centre[k]
        reach[k] = away.max(axis=0)
        far = np.einsum("ij,ij->i", away, away, dtype=np.float64)
        radius.append(math.sqrt(far.max()))
        if 2 * k + 2 < len(ranges):
            a = own[far.argmax()]
            apart = own - a
            b = own[np.einsum("ij,ij->i", apart, apart).argmax()]
            order[low:high] = order[low:high][np.argsort(own @ (b - a), kind="stable")]
    at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in order])
    return {
        "doc": docs[order], "begin": np.concatenate(([0], np.cumsum(np.diff(begin)[order]))), "term": term[at], "value": value[at],
        "column": column, "centre": centre.tobytes(), "reach": reach.tobytes(), "radius": radius, "depth": depth,
    }


def trees(found: DataFrame, weight: np.ndarray, docs: int, words: int, tree: int = TREE) -> DataFrame:
    """The index: one row per tree of documents that have a searched term; ``first`` marks some with the heaviest terms."""
    scale = np.sqrt(weight.astype(np.float64))
    size = max(2, min(tree, CELLS // max(1, len(weight))))
    rank = np.empty(len(weight), dtype=np.int64)
    rank[np.argsort(-weight, kind="stable")] = np.arange(len(weight))

    def heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = batch.column("term").offsets.to_numpy()
            term = batch.column("term").values.to_numpy()
            top = np.minimum.reduceat(rank[term], begin[:-1]) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield batch.append_column("top", pa.array(top))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaviest = TaskContext.get().partitionId() == 0
        for number, part in enumerate(_regrouped(batches, size)):
            n, lists = part.column("n").to_numpy(), part.column("term").combine_chunks()
            begin = lists.offsets.to_numpy().astype(np.int64)
            term, tf = lists.values.to_numpy(), part.column("tf").combine_chunks().values.to_numpy().astype(np.int64)
            term, tf, begin = term[begin[0] : begin[-1]], tf[begin[0] : begin[-1]], begin - begin[0]
            m = np.repeat(100 - 50 + (50 * n * docs) // words, np.diff(begin))
            built = _tree(part.column("doc").to_numpy(), begin, term, (1_000_000_000 * tf) // (1000 * tf + 20 * m), scale)
            yield pa.RecordBatch.from_pylist([built | {"first": heaviest and number < FIRST_TREES}], schema=_TREE_ARROW)

    rows = found.where(F.size("term") > 0).mapInArrow(heaviest, f"{_VECTOR}, top long")
    rows = rows.repartitionByRange("top", F.xxhash64("doc")).sortWithinPartitions("top", F.xxhash64("doc")).drop("top")
    return rows.mapInArrow(work, _TREE)


def _regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``size`` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = size - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in held) == size:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class Tree:
    """A tree as it was written, and the search of one item in it."""

    def __init__(self, rows: pa.RecordBatch, row: int, weight: np.ndarray):
        lists = ("doc", "begin", "term", "value", "column", "radius")
        self.doc, self.begin, self.term, self.value, self.column, self.radius = (rows.column(c)[row].values.to_numpy() for c in lists)
        self.centre, self.reach = (
            np.frombuffer(rows.column(c)[row].as_py(), dtype=np.float32).reshape(len(self.radius), -1).astype(np.float64) for c in ("centre", "reach")
        )
        self.spans = spans(len(self.doc), rows.column("depth")[row].as_py())
        self.weight = weight
        self.scale = np.sqrt(weight.astype(np.float64))
        self.opened = 0

    def bounds(self, has: np.ndarray) -> np.ndarray:
        """Above any score of each node's documents: float32 points and double sums err by far less than a part in a million."""
        query = np.where(has, self.scale, 0.0)
        at = np.flatnonzero(has[self.column])
        own = query[self.column[at]]
        beyond = np.minimum(math.sqrt(float(query @ query)) * self.radius, self.reach[:, at] @ own)
        return (self.centre[:, at] @ own + beyond) * (1 + 1e-6) + 1

    def search(self, has: np.ndarray, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``top`` best that are ``least`` or more."""
        bound, weight = self.bounds(has), np.where(has, self.weight, 0)
        docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        queue = [(-bound[0], 0)]
        while queue:
            best, k = heapq.heappop(queue)
            if -best < least:
                break
            if 2 * k + 2 < len(self.spans):
                for below in (2 * k + 1, 2 * k + 2):
                    heapq.heappush(queue, (max(best, -bound[below]), below))
                continue
            self.opened += 1
            low, high = self.spans[k]
            a, b = self.begin[low], self.begin[high]
            score = np.add.reduceat(weight[self.term[a:b]] * self.value[a:b], self.begin[low:high] - a)
            good = score >= max(least, 1)
            docs, scores = np.concatenate((docs, self.doc[low:high][good])), np.concatenate((scores, score[good]))
            if len(docs) > top:
                order = np.lexsort((docs, -scores))[:top]
                docs, scores = docs[order], scores[order]
            if len(docs) == top:
                least = max(least, int(scores.min()))
        return docs, scores


def searched(index: DataFrame, items: list[np.ndarray], weight: np.ndarray, least: np.ndarray, top: int) -> DataFrame:
    """``item, doc, score``: the best of each task's trees for each item, given as term numbers, that reach its ``least``.

    What a task has kept of an item bounds its search in the trees that follow.
    """
    schema = pa.schema([("item", pa.int32()), ("doc", pa.int64()), ("score", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        bound, kept = least.tolist(), [(none, none)] * len(items)
        for batch in batches:
            for row in range(batch.num_rows):
                tree = Tree(batch, row, weight)
                for item, terms in enumerate(items):
                    has = np.zeros(len(weight), dtype=bool)
                    has[terms] = True
                    found = tree.search(has, top, bound[item])
                    docs, scores = (np.concatenate(pair) for pair in zip(kept[item], found, strict=True))
                    order = np.lexsort((docs, -scores))[:top]
                    kept[item] = docs[order], scores[order]
                    if len(order) == top:
                        bound[item] = max(bound[item], int(scores[order[-1]]))
        for item, (docs, scores) in enumerate(kept):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item, dtype=np.int32)), pa.array(docs), pa.array(scores)], schema=schema)

    return index.mapInArrow(work, "item int, doc long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """``item, rank, doc, score``: the ``top`` of each item."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = ITEM_BLOCK, tree: int = TREE) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item, best first."""
    spark = docs.sparkSession
    wanted = saved(item_terms(items))
    blocks = max(1, math.ceil(wanted.select("item_id").distinct().count() / block))
    out = None
    for number in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        # The terms of a block of items.
        named: dict[int | None, list[int]] = {}
        for row in mine.collect():
            named.setdefault(row.item_id, []).append(row.term)
        if not named:
            continue
        ids = list(named)
        terms = np.unique(np.array([t for v in named.values() for t in v], dtype=np.int64).view(np.uint64))
        numbers = [np.searchsorted(terms, np.array(v, dtype=np.int64).view(np.uint64)) for v in named.values()]
        found = saved(vectors(docs, terms))
        weight, count, words = weights(found, len(terms))
        if not count:
            continue
        index = saved(trees(found, weight, count, words, tree))
        first = searched(index.where("first"), numbers, weight, np.ones(len(ids), dtype=np.int64), top)
        least = np.ones(len(ids), dtype=np.int64)
        # One row per item of the block.
        for row in ranked(first, top).where(F.col("rank") == top).collect():
            least[row.item] = row.score
        best = saved(ranked(searched(index, numbers, weight, least, top), top))
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        part = best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.expr(f"nullif(doc, {_LAST})").alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from documents),
tf as (select doc_id, t, count(*)::bigint tf from t group by all),
n as (select doc_id, sum(tf)::bigint n from tf group by doc_id),
s as (select count(*)::bigint docs, sum(n)::bigint words from n),
df as (select t, count(*)::bigint df from tf group by t),
w as (select t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint w from df, s),
m as (select doc_id, 100 - 50 + ((50 * n * docs) // words) m from n, s),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score
      from i join tf using (t) join w using (t) join m using (doc_id) group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from r where score > 0 qualify rank <= 50
"""
