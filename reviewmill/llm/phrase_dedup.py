"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words. A word is removed if a window covers it whose words also start in a
document with a smaller id; windows are judged on the input.

1. Anchors. Of the ``PHRASE``-word phrases in a window, the one with the lowest hash (the first such) is its
   anchor. Equal windows have equal anchors, and about one phrase in twenty is an anchor. An occurrence of an
   anchor with the words of all its windows is a context; rows are anchor, context and document.
2. Recurring passages. Contexts are grouped, so that any number of copies is one row with the lowest and highest
   document. Of anchors in two documents or more, each context is fetched once, from its first document, and
   its windows are compared with those of the anchor's other contexts. Windows in two documents are confirmed.
3. Automata. Confirmed phrases are dealt to shards of about ``SHARD_PHRASES``, by the first document that has
   them, so that what is copied together lies together. A shard holds its phrases and confirmed windows.
4. Streaming. Every document that has a confirmed phrase is read again, and its stretches of windows with a
   shard's phrases go to that shard, where a task compiles the automaton once. It finds every occurrence of the
   shard's phrases, and all windows around an occurrence are looked up among the confirmed ones. The rest of a
   document has no window with a confirmed anchor. What a document's shards found is put together where the
   document is written.

Whole texts are moved once, into buckets by document; what is joined to them later moves instead.

Windows are compared by 64-bit hashes, phrases by their text. A null text has no words; a null id counts as
larger than any other; rows with the same id are one document; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import wordhash
from reviewmill.llm.shared import bucketed, file_system, folder, saved

WINDOW, PHRASE = 50, 8
SHARD_PHRASES = 25_000
#: Anchor occurrences of a shard to a task.
SHARD_OCCURRENCES = 50_000
_LAST = (1 << 63) - 1

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _lowest_first(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first lowest value among ``width`` from each position on."""
    at = np.arange(len(values))
    span = 1
    while span * 2 <= width:
        a, b = at[:-span], at[span:]
        at = np.where(values[b] < values[a], b, a)
        span *= 2
    rest = width - span
    if rest:
        a, b = at[:-rest], at[rest:]
        at = np.where(values[b] < values[a], b, a)
    return at


class Ranges:
    """Hashes of ranges of words in constant time."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        power = np.full(n + 1, _BASE, dtype=np.uint64)
        power[0] = 1
        back = np.full(n + 1, _INVERSE, dtype=np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * np.multiply.accumulate(power)[:n], dtype=np.uint64)))

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[begin]) * self.back[begin]
        return wordhash.mix(value + (end - begin).astype(np.uint64))


class Anchors:
    """Anchor occurrences of some texts: text number, phrase position ``at``, windows from ``low`` to ``high``."""

    def __init__(self, texts: list[bytes], window: int, phrase: int):
        self.words = words = wordhash.Words(texts)
        n = len(words.hash)
        self.ranges = Ranges(words.hash)
        of = np.repeat(np.arange(len(texts)), np.diff(words.first))
        self.text = self.at = self.low = self.high = np.zeros(0, dtype=np.int64)
        self.phrase = self.context = np.zeros(0, dtype=np.uint64)
        if n < window:
            return
        whole = np.flatnonzero(of[: n - window + 1] == of[window - 1 :])
        if not len(whole):
            return
        phrases = wordhash.shingles(words.hash, phrase)
        lowest = _lowest_first(phrases, window - phrase + 1)[whole]
        begin = np.flatnonzero(np.diff(lowest, prepend=-1))
        end = np.append(begin[1:], len(whole)) - 1
        self.at, self.low, self.high = lowest[begin], whole[begin], whole[end]
        self.text = of[self.at]
        self.phrase = phrases[self.at]
        span = self.ranges.hash(self.low, self.high + window)
        self.context = wordhash.mix(span + (self.at - self.low).astype(np.uint64))


def _batches(batch: pa.RecordBatch, window: int, phrase: int) -> Iterator[tuple[int, Anchors]]:
    texts = wordhash.encoded(batch.column("text"))
    for begin, end in wordhash.chunks(texts):
        yield begin, Anchors(texts[begin:end], window, phrase)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """``phrase, context, doc`` of all documents."""
    schema = pa.schema([("phrase", pa.int64()), ("context", pa.int64()), ("doc", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for begin, found in _batches(batch, window, phrase):
                yield pa.RecordBatch.from_arrays([_signed(found.phrase), _signed(found.context), pa.array(ids[begin + found.text])], schema=schema)

    return docs.mapInArrow(work, "phrase long, context long, doc long")


def passages(docs: DataFrame, wanted: DataFrame, window: int, phrase: int) -> DataFrame:
    """``phrase, words, low, high, windows`` of the wanted contexts, each read from its first document."""
    schema = pa.schema([("phrase", pa.int64()), ("words", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("windows", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, highs, ids = batch.column("contexts").to_pylist(), batch.column("highs").to_pylist(), batch.column("doc").to_pylist()
            for begin, found in _batches(batch, window, phrase):
                out, given = [], {}
                contexts = found.context.view(np.int64)
                for i, (text, context) in enumerate(zip(found.text.tolist(), contexts.tolist(), strict=True)):
                    if text not in given:
                        given[text] = dict(zip(asked[begin + text], highs[begin + text], strict=True))
                    # A context that the document repeats is told once.
                    high = given[text].pop(context, None)
                    if high is None:
                        continue
                    at = found.at[i]
                    words = found.words
                    said = b" ".join(words.data[a:b].tobytes() for a, b in zip(words.start[at : at + phrase], words.end[at : at + phrase], strict=True))
                    starts = np.arange(found.low[i], found.high[i] + 1)
                    hashes = found.ranges.hash(starts, starts + window).view(np.int64)
                    out.append({"phrase": found.phrase[i].astype(np.int64), "words": said, "low": ids[begin + text], "high": high, "windows": hashes})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    by_doc = wanted.groupBy(F.col("low").alias("doc")).agg(F.collect_list("context").alias("contexts"), F.collect_list("high").alias("highs"))
    return docs.join(by_doc, "doc").mapInArrow(work, "phrase long, words binary, low long, high long, windows array<long>")


def write_shards(rows: DataFrame, root: str) -> DataFrame:
    """One file per shard from ``shard, phrase, words, window, low``; returns ``shard, file``."""
    system, path = file_system(root)
    system.create_dir(path, recursive=True)
    schema = pa.schema([("shard", pa.int64()), ("file", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, phrases, windows, lows = None, {}, [], []

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.shard"
            window, low = np.concatenate(windows), np.concatenate(lows)
            order = np.lexsort((low, window))
            data = zlib.compress(pickle.dumps((list(phrases), window[order], low[order])), 1)
            system, path = file_system(f"{root}/{name}")
            with system.open_output_stream(path, compression=None) as stream:
                stream.write(data)
            return pa.RecordBatch.from_pydict({"shard": [shard], "file": [name]}, schema=schema)

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(shards)), strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    if phrases:
                        yield flush()
                    shard, phrases, windows, lows = int(shards[a]), {}, [], []
                part = batch.slice(a, b - a)
                phrases.update(dict.fromkeys(part.column("words").to_pylist()))
                windows.append(part.column("window").to_numpy())
                lows.append(part.column("low").to_numpy())
        if phrases:
            yield flush()

    return saved(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(work, "shard long, file string"))


class Shard:
    """A compiled automaton and the confirmed windows; texts are UTF-8 bytes taken as characters."""

    def __init__(self, root: str, name: str):
        import ahocorasick

        system, path = file_system(f"{root}/{name}")
        with system.open_input_file(path) as stream:
            phrases, self.windows, self.lows = pickle.loads(zlib.decompress(stream.read()))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for words in phrases:
            key = f" {words.decode('latin-1')} "
            self.automaton.add_word(key, len(key))
        self.automaton.make_automaton()

    def repeated(self, joined: str, begins: np.ndarray, hashes: np.ndarray, doc: int, window: int, phrase: int) -> np.ndarray:
        """Starts of windows that a smaller document has; ``begins`` are the words' places in ``joined``."""
        hits = [end - size + 2 for end, size in self.automaton.iter(joined)]
        if not hits or not len(hashes):
            return np.zeros(0, dtype=np.int64)
        at = np.unique(np.searchsorted(begins, np.array(hits)))
        around = (at[:, None] + np.arange(phrase - window, 1)).ravel()
        starts = np.unique(around[(around >= 0) & (around < len(hashes))])
        found = np.searchsorted(self.windows, hashes[starts])
        found[found == len(self.windows)] = 0
        return starts[(self.windows[found] == hashes[starts]) & (self.lows[found] < doc)]


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def stretches(docs: DataFrame, parts: dict[int, int], window: int, phrase: int) -> DataFrame:
    """``shard, part, doc, digest, begin, text`` from documents with their ``phrases`` and those' ``shards``.

    ``text`` has the words from ``begin`` on that windows with the shard's phrases cover, ``part`` is one of the
    shard's ``parts``.
    """
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("doc", pa.int64()), ("digest", pa.int64()), ("begin", pa.int64()), ("text", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, phrases, shards = (batch.column(c).to_pylist() for c in ("doc", "digest", "phrases", "shards"))
            for first, found in _batches(batch, window, phrase):
                words, out, given, ranges = found.words, [], {}, {}
                rows = zip(*[x.tolist() for x in (found.text, found.phrase.view(np.int64), found.low, found.high + window)], strict=True)
                for text, name, low, high in rows:
                    if text not in given:
                        given[text] = dict(zip(phrases[first + text], shards[first + text], strict=True))
                    shard = given[text].get(name)
                    if shard is None:
                        continue
                    own = ranges.setdefault((text, shard), [])
                    if own and low <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], high)
                    else:
                        own.append([low, high])
                for (text, shard), own in ranges.items():
                    doc, digest = ids[first + text], digests[first + text]
                    part = digest % parts[shard]
                    for low, high in own:
                        said = words.data[words.start[low] : words.end[high - 1]].tobytes()
                        out.append({"shard": shard, "part": part, "doc": doc, "digest": digest, "begin": low - int(words.first[text]), "text": said})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.mapInArrow(work, "shard long, part long, doc long, digest long, begin long, text binary")


def streamed(texts: DataFrame, files: dict[int, str], root: str, window: int, phrase: int) -> DataFrame:
    """``doc, digest, starts`` of repeated windows, from stretches; rows come sorted by shard."""
    schema = pa.schema([("doc", pa.int64()), ("digest", pa.int64()), ("starts", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            out = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("doc", "digest", "shard", "begin", "text")], strict=True)
            for doc, digest, wanted, begin, text in rows:
                if wanted != number:
                    number, shard = wanted, None
                    shard = Shard(root, files[number])
                joined = b" ".join(text.split())
                words = wordhash.Words([joined])
                starts = np.arange(max(0, len(words.hash) - window + 1))
                hashes = Ranges(words.hash).hash(starts, starts + window).view(np.int64)
                found = shard.repeated(f" {joined.decode('latin-1')} ", words.start + 1, hashes, doc, window, phrase)
                if len(found):
                    out.append({"doc": doc, "digest": digest, "starts": found + begin})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return texts.mapInArrow(work, "doc long, digest long, starts array<long>")


def written(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    """The result from documents with ``found``, digests and starts, or null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("doc", "digest", "found")], wordhash.encoded(batch.column("text")), strict=True)
            for doc, digest, found, text in rows:
                words = kept = text.split()
                # Rows with one id may have different texts.
                own = [np.array(x["starts"], dtype=np.int64) for x in found or [] if x["digest"] == digest]
                if own:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    starts = np.unique(np.concatenate(own))
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + window, -1)
                    kept = [w for w, gone in zip(words, (np.cumsum(edges)[:-1] > 0).tolist(), strict=True) if not gone]
                joined = b" ".join(kept)
                out.append({
                    "doc_id": None if doc == _LAST else doc, "n_words": len(words), "n_removed": len(words) - len(kept),
                    "kept_sha256": hashlib.sha256(joined).hexdigest(), "kept": joined.decode() if texts else None,
                })
            yield pa.RecordBatch.from_pylist(out, schema=_KEPT_ARROW)

    return docs.select("doc", "digest", "found", "text").mapInArrow(work, _KEPT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` for every row; ``kept`` is null without ``texts``."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text", F.xxhash64("text").alias("digest"))
    docs = bucketed(docs, "doc")
    marks = saved(anchors(docs, window, phrase))
    contexts = saved(marks.groupBy("phrase", "context").agg(F.min("doc").alias("low"), F.max("doc").alias("high")))
    shared = contexts.groupBy("phrase").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a < b").select("phrase")
    wanted = contexts.join(shared, "phrase", "left_semi").select("context", "low", "high")
    found = saved(passages(docs, wanted, window, phrase))
    windows = found.select("phrase", F.explode("windows").alias("window"), "low", "high")
    windows = windows.groupBy("phrase", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    windows = saved(windows.drop("high"))
    owners = saved(windows.groupBy("phrase").agg(F.min("low").alias("owner")))
    shards = max(1, -(-owners.count() // SHARD_PHRASES))
    owners = owners.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    said = found.select("phrase", "words").dropDuplicates(["phrase"])
    root = folder(spark, "phrase-shards")
    shard_files = write_shards(windows.join(owners.select("phrase", "shard"), "phrase").join(said, "phrase").select("shard", "words", "window", "low"), root)
    routes = saved(marks.join(owners, "phrase").where("doc > owner").select("doc", "phrase", "shard"))
    # One short name and one number per shard.
    files = {r.shard: r.file for r in shard_files.collect()}
    parts = {r.shard: -(-r["count"] // SHARD_OCCURRENCES) for r in routes.groupBy("shard").count().collect()}
    routes = routes.groupBy("doc").agg(F.collect_list(F.struct("phrase", "shard")).alias("way"))
    routed = docs.join(routes.select("doc", F.col("way.phrase").alias("phrases"), F.col("way.shard").alias("shards")), "doc")
    cut = stretches(routed, parts, window, phrase).repartition(max(1, sum(parts.values())), "shard", "part").sortWithinPartitions("shard")
    repeated = streamed(cut, files, root, window, phrase).groupBy("doc").agg(F.collect_list(F.struct("digest", "starts")).alias("found"))
    return written(docs.join(repeated, "doc", "left"), window, texts)


SQL = r"""
with w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 48)) i from w where len(w) >= 50),
h as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) h from s),
m as (select h, min(doc_id) lo from h group by h),
r as (select doc_id, list(i) i from h join m using (h) where lo < doc_id group by doc_id),
g as (select doc_id, list_distinct(flatten(list_transform(i, lambda x: range(x, x + 50)))) g from r),
k as (select w.doc_id, coalesce(len(w), 0)::bigint n_words, coalesce(len(g), 0)::bigint n_removed,
             case when g is null then coalesce(w, [])
                  else list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda x: not list_contains(g, x))), lambda x: w[x]) end k
      from w left join g using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) kept_sha256 from k
"""
