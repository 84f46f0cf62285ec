"""Benchmark decontamination by containment search with an exact prefix filter on hashes.

Texts are sets of ``SHINGLE``-word shingles over lower-case words of letters and digits. A document contains an
item if at least ``CONTAINMENT`` of the item's shingles are in the document's set.

A signature of a long document says next to nothing about a short item in it, so no MinHash signatures are
compared and nothing is partitioned by size. An item's sketch is its shingles with the lowest hashes, just as many
for its size that a document without any sketched shingle can't contain the item. Documents are read once; a bitmap of fixed largest size says which of
their shingles may be in a sketch, and which in an item. Documents with a sketched shingle give their shingles
that may be in an item, and joining these with the items' gives the exact counts; what the bitmap lets through
in error finds no partner there. Nothing of the items but bitmaps is sent to tasks, at any number of items.

Defined cases: a null text or a text without words has no shingles; fewer words than a shingle make one
shingle; rows with equal ids are one document or item; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import wordhash
from reviewmill.llm.shared import saved

SHINGLE, CONTAINMENT = 5, 0.8
#: Bits of the bitmaps: 16 per entry, within these powers of two.
_LEAST_BITS, _MOST_BITS = 16, 27


def sketch_length(n: int, containment: float) -> int:
    """So many shingles of ``n`` can't all be missing at this containment."""
    return n - ceil(containment * n - 1e-9) + 1


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = wordhash.encoded(batch.column("text"))
    for begin, end in wordhash.chunks(texts):
        words = wordhash.Words(texts[begin:end], wordhash.ALNUM, lower=True)
        for i in range(end - begin):
            yield begin + i, wordhash.shingle_set(words.hash[words.first[i] : words.first[i + 1]], k)


def item_shingles(items: DataFrame, k: int, containment: float) -> DataFrame:
    """``item_id, shingle, n, sketched``: all shingles of every item."""
    schema = pa.schema([("item_id", pa.int64()), ("shingle", pa.int64()), ("n", pa.int64()), ("sketched", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for i, found in _sets(batch, k):
                n = len(found)
                if n:
                    low = np.arange(n) < sketch_length(n, containment)
                    cols = [[ids[i]] * n, found.view(np.int64), [n] * n, low]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(work, "item_id long, shingle long, n long, sketched boolean")


def bitmap(shingles: DataFrame, bits: int) -> np.ndarray:
    """Packed bits at the shingles' remainders; what reaches the driver is bounded by the number of bits."""
    place = F.pmod("shingle", F.lit(1 << bits))
    words = shingles.groupBy(F.shiftright(place, 3).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(pmod(shingle, {1 << bits}) % 8 as int))")).alias("b"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    found = words.toPandas()
    out[found["at"].to_numpy(dtype=np.int64)] = found["b"].to_numpy(dtype=np.uint8)
    return out


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def document_hits(docs: DataFrame, sketches: np.ndarray, items: np.ndarray, k: int) -> DataFrame:
    """``doc_id, shingle``: shingles that may be an item's, of documents with one that may be in a sketch."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((sketches, items))
    schema = pa.schema([("doc_id", pa.int64()), ("shingle", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch_bits, item_bits = sent.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts = wordhash.encoded(batch.column("text"))
            for begin, end in wordhash.chunks(texts):
                words = wordhash.Words(texts[begin:end], wordhash.ALNUM, lower=True)
                counts = np.diff(words.first)
                of = np.repeat(np.arange(end - begin), counts)
                hashes = wordhash.shingles(words.hash, k)
                inside = of[: len(hashes)] == of[k - 1 :] if len(hashes) else np.zeros(0, dtype=bool)
                hashes, owner = hashes[inside], of[: len(inside)][inside]
                short = np.flatnonzero((counts > 0) & (counts < k))
                if len(short):
                    whole = [wordhash.shingle_set(words.hash[words.first[i] : words.first[i + 1]], k) for i in short]
                    hashes, owner = np.concatenate([hashes, *whole]), np.concatenate([owner, short])
                chosen = np.zeros(end - begin, dtype=bool)
                chosen[owner[_in(sketch_bits, hashes)]] = True
                keep = chosen[owner]
                hashes, owner = hashes[keep], owner[keep]
                keep = _in(item_bits, hashes)
                hashes, owner = hashes[keep], owner[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin + owner], pa.int64(), from_pandas=True), pa.array(hashes.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, shingle long").distinct()


def contained_items(docs: DataFrame, items: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, item_id, n_item, n_common, containment`` of every document and item it contains."""
    parts = saved(item_shingles(items, k, containment))
    n = parts.count()
    bits = min(_MOST_BITS, max(_LEAST_BITS, (16 * max(1, n)).bit_length()))
    found = document_hits(docs, bitmap(parts.where("sketched"), bits), bitmap(parts, bits), k)
    sizes = parts.groupBy("item_id").agg(F.countDistinct("shingle").alias("n_item"))
    common = found.join(parts.select("item_id", "shingle").distinct(), "shingle").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_common"))
    share = F.col("n_common") / F.col("n_item")
    return common.join(sizes, "item_id").where(share >= containment - 1e-12).select("doc_id", "item_id", "n_item", "n_common", share.alias("containment"))


SQL = r"""
with t as (select 0 kind, doc_id id, text from documents union all select 1, item_id, text from benchmark),
w as (select kind, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[a-z0-9\x{80}-\x{10FFFF}]+') w from t),
s as (select distinct kind, id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
                                            when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
n as (select id, count(*) n from s where kind = 1 group by id)
select d.id doc_id, b.id item_id, n.n n_item, count(*) n_common, count(*) / n.n containment
from s b join s d on d.s = b.s and d.kind = 0 and b.kind = 1 join n on n.id = b.id
group by d.id, b.id, n.n having count(*) / n.n >= 0.8 - 1e-12
"""
