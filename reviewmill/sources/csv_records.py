"""Records of CSV files that many tasks read at once.

A quoted field may hold line breaks, so where a block of a file begins can't be told from the block: it may lie inside
a field. Each task therefore says of its block how it would end and how many records it would open if it began at a
record, and if it began inside a quoted field. Chained block by block these answers give every block's true beginning
and the number of records before it. In a second reading tasks cut their blocks into records; a record that spans
blocks is put together from its pieces.

Quotes follow the usual rule: a field is quoted if it begins with a quote, a doubled quote inside it is one quote, and
a quote elsewhere is text. Empty lines between records are no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.session import cut_lineage

_BLOCK = "file string, block long, open_after boolean, open_after_open boolean, records long, records_open long"
_PIECE = "rank long, row long, block long, whole boolean, text string"
#: From inside a quoted field to the quote that ends it.
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def ends_open(line: str, is_open: bool) -> bool:
    """Whether a quoted field is open after a line that begins inside one, or at a record."""
    at = 0
    if not is_open and line.startswith('"'):
        at, is_open = 1, True
    while True:
        if is_open:
            found = _QUOTED.match(line, at)
            if not found:
                return True
            at = found.end()
        # Only a quote that begins a field opens one.
        begins = line.find(',"', at)
        if begins < 0:
            return False
        at, is_open = begins + 2, True


def _filled(lines: pa.Array) -> np.ndarray:
    """Lines that aren't empty; an empty line outside of a field is no record."""
    return ~pc.is_in(lines, value_set=pa.array(["", "\r"], lines.type)).to_numpy(zero_copy_only=False)


def _quoted(lines: pa.Array) -> tuple[list[int], list[str]]:
    """Lines with quotes and where they stand; a line without any leaves a field open or closed as it was."""
    held = pc.match_substring(lines, '"')
    return np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist(), lines.filter(held).to_pylist()


def _runs(batches: Iterator[pa.RecordBatch], file: str) -> Iterator[tuple[str | int, int, pa.RecordBatch]]:
    """File, block and the lines of it that stand together in a batch; ``file`` is the column that tells files apart."""
    for batch in batches:
        if batch.num_rows:
            files = batch.column(file).dictionary_encode()
            named, blocks = files.indices.to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(named) != 0) | (np.diff(blocks) != 0)) + 1
            for start, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
                yield files[start].as_py(), int(blocks[start]), batch.slice(start, end - start)


def _passed(lines: pa.Array, states: list[bool]) -> tuple[list[bool], list[int]]:
    """How lines end that begin in each of the states, and how many records they open."""
    before = np.concatenate(([0], np.cumsum(_filled(lines)))).tolist()
    ends, counts, at = list(states), [0] * len(states), 0
    for place, line in zip(*_quoted(lines), strict=True):
        for i, is_open in enumerate(ends):
            counts[i] += 0 if is_open else before[place + 1] - before[at]
            ends[i] = ends[0] if i and is_open == was else ends_open(line, is_open)
            was = is_open
        at = place + 1
    return ends, [n if is_open else n + before[-1] - before[at] for n, is_open in zip(counts, ends, strict=True)]


def _summaries(lines: DataFrame) -> DataFrame:
    """One row per block: how it ends and how many records it opens, for both beginnings."""
    names = [part.split()[0] for part in _BLOCK.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        for file, block, run in _runs(batches, "file"):
            if now is None or (file, block) != tuple(now[:2]):
                out += [now] if now else []
                now = [file, block, False, True, 0, 0]
            now[2:4], (first, second) = _passed(run.column("value"), now[2:4])
            now[4:] = now[4] + first, now[5] + second
        out += [now] if now else []
        yield pa.RecordBatch.from_pydict({n: [row[i] for row in out] for i, n in enumerate(names)}, schema=_schema(_BLOCK))

    return lines.select("file", "block", "value").mapInArrow(work, _BLOCK)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _beginnings(blocks: DataFrame) -> DataFrame:
    """``file, block, is_open, before``: whether a block begins inside a field, and how many records begin before it."""
    step = """
      struct(if(a.is_open, x.open_after_open, x.open_after) as is_open,
        a.before + if(a.is_open, x.records_open, x.records) as before,
        array_append(a.seen, struct(x.block as block, a.is_open as is_open, a.before as before)) as seen)"""
    start = "struct(false as is_open, 0L as before, cast(array() as array<struct<block:bigint,is_open:boolean,before:bigint>>) as seen)"
    chained = F.expr(f"aggregate(array_sort(blocks), {start}, (a, x) -> {step}, a -> a.seen)")
    held = F.collect_list(F.struct("block", "open_after", "open_after_open", "records", "records_open")).alias("blocks")
    # One entry per block of a file.
    return blocks.groupBy("file").agg(held).select("file", F.inline(chained))


def _pieces(lines: DataFrame) -> DataFrame:
    """Records, and pieces of records that span blocks; a block's lines come in order and know how the block begins.

    Records of one line, nearly all, are passed on as Arrow holds them. Files go by their rank, as a path is longer than many a line.
    """
    names = [part.split()[0] for part in _PIECE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, row, is_open, held, begun_here, record = None, 0, False, [], False, 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(names)}, schema=_schema(_PIECE))
            out.clear()
            return batch

        for file, block, run in _runs(batches, "rank"):
            if now != (file, block):
                if held:
                    out.append((now[0], record, now[1], False, "\n".join(held)))
                now, row, is_open, held, begun_here = (file, block), run.column("before")[0].as_py(), run.column("is_open")[0].as_py(), [], False
                record = row
            lines = run.column("value")
            inside, at = np.empty(run.num_rows + 1, bool), 0
            for place, line in zip(*_quoted(lines), strict=True):
                inside[at : place + 1] = is_open
                is_open, at = ends_open(line, is_open), place + 1
            inside[at:] = is_open
            opens = _filled(lines) & ~inside[:-1]
            rows = row + np.cumsum(opens)
            single = opens & ~inside[1:]
            n = int(single.sum())
            same = [pa.repeat(pa.scalar(v, t), n) for v, t in ((file, pa.int64()), (block, pa.int64()), (True, pa.bool_()))]
            text = lines.filter(pa.array(single)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([same[0], pa.array(rows[single], pa.int64()), same[1], same[2], text], schema=_schema(_PIECE))
            parts = np.flatnonzero(inside[:-1] | inside[1:])
            for i, line in zip(parts.tolist(), lines.take(pa.array(parts)).to_pylist(), strict=True):
                if opens[i]:
                    record, begun_here = int(rows[i]), True
                held.append(line)
                if not inside[i + 1]:
                    out.append((file, record, block, begun_here, "\n".join(held)))
                    held = []
            row = int(rows[-1])
            if len(out) >= 10_000:
                yield flush()
        if held:
            out.append((now[0], record, now[1], False, "\n".join(held)))
        yield flush()

    return lines.select("rank", "block", "value", "is_open", "before").mapInArrow(work, _PIECE)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, row_id, text`` of all records but the first of each file, its header.

    ``row`` counts the records of a file from 1, so the first one after the header is 2. ``row_id`` grows with the
    file's name and the row. A missing path has no records.
    """
    try:
        read = spark.read.option("lineSep", "\n").text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "file string, row long, row_id long, text string")
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.withColumn("line", F.monotonically_increasing_id())
    begins = cut_lineage(_beginnings(_summaries(lines)))
    # One row per file.
    files = cut_lineage(begins.select("file").distinct().withColumn("rank", F.row_number().over(Window.orderBy("file")).cast("bigint")))
    begins = cut_lineage(begins.join(files, "file"))
    # The join may deal lines out anew, but a block's lines stay together, and so they do in the order of their numbers.
    known = lines.join(begins, ["file", "block"]).sortWithinPartitions("line")
    pieces = cut_lineage(_pieces(known))
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text")
    spanning = pieces.where("not whole").groupBy("rank", "row").agg(put)
    records = pieces.where("whole").select("rank", "row", "text").unionByName(spanning).where("row > 1")
    row_id = (F.shiftleft("rank", 40) + F.col("row")).alias("row_id")
    return records.join(files, "rank").select("file", "row", row_id, F.regexp_replace("text", "\r$", "").alias("text"))
