"""WARC archives with a two-level capture index.

Archives: one gzip member per record, so that a record can be read by its byte range. Of records with equal
payloads the one with the smallest page id is a response and the others revisit it; a revisit keeps the HTTP
head, with the length of the payload, and the payload's digest. Tasks write files under names of their own
and return the captures; only returned captures count, so a task that runs twice leaves a file that nothing
refers to.

Index: captures sorted by reversed host, path and page id are cut into ranges. Each range is a file of
compressed blocks of ``BLOCK_LINES`` captures, and a sparse directory of the blocks' first keys at its end.
A look-up finds the range among the ranges' first keys (as many as partitions), the block by binary search
in that file's directory, and the capture by binary search in the block; then it reads the record's bytes.

Defined cases: a null payload is empty; a null url has an empty key; a null page id sorts first, and of equal
payloads it is never the smallest unless all are null; repeated rows with the smallest id are all responses;
an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.shared import file_system, folder, saved

BLOCK_LINES = 512
#: Bytes after which a task begins another archive file.
ARCHIVE_BYTES = 256 << 20
_LOWEST = -(1 << 63)
_CAPTURE = "key string, page_id long, file string, at long, length long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def surt(url: str | None) -> str:
    """``http://www.example.com:80/a?b`` as ``com,example,www:80)/a?b``; what has no host stays as it is."""
    found = re.match(r"(?s)[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[^/?#]*)?(.*)", url or "")
    if not found:
        return url or ""
    host, port, rest = found.groups()
    return ",".join(reversed(host.lower().split("."))) + (port or "") + ")" + (rest if rest.startswith("/") else "/" + rest)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:capture:{'' if page_id is None else page_id}:{digest}>"


def _field(text: str) -> str:
    """Header values are one line."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unfield(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_record_id(refers_to, digest)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "\r\n".join(head).encode() + b"\r\n\r\n"
    return packer.compress(text + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """What a record says; the length and digest of a response are taken from its payload and must agree."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload), base32_sha1(payload)) != (n, digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(x) if (x := fields[name].split(":")[2]) else None
    return {
        "page_id": number("WARC-Record-ID"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To") if revisit else None,
        "url": _unfield(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, "payload": None if revisit else payload,
    }


def _open(root: str, name: str, write: bool = False):
    system, path = file_system(f"{root}/{name}")
    return system.open_output_stream(path, compression=None) if write else system.open_input_file(path)


def _make_folder(root: str) -> None:
    system, path = file_system(root)
    system.create_dir(path, recursive=True)


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to, revisit``: one row per page, joined to the first page of its payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.unhex(F.sha1("html")))
    first = rows.groupBy("sum").agg(F.min("page_id").alias("first"))
    same = (F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "sum").select("page_id", "url", "html", F.when(same, F.col("first")).alias("refers_to"), same.alias("revisit"))


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Archives below ``root``; returns the captures (key, page id, file, byte range), written already."""
    _make_folder(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name, at = None, "", 0
        try:
            for batch in batches:
                out = []
                html = batch.column("html").cast(pa.binary())
                cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit")]
                for i, (page_id, url, refers_to, revisit) in enumerate(zip(*cols, strict=True)):
                    if stream is None or at >= ARCHIVE_BYTES:
                        if stream is not None:
                            stream.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        stream = _open(root, name, write=True)
                    payload = html[i].as_py()
                    member = record(page_id, url, payload, base32_sha1(payload), refers_to, revisit)
                    stream.write(member)
                    out.append({"key": surt(url), "page_id": page_id, "file": name, "at": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(out, schema=_CAPTURE_ARROW)
        finally:
            if stream is not None:
                stream.close()

    return saved(decided(pages, min_bytes).mapInArrow(write, _CAPTURE))


_CAPTURE_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
_RANGE = "file string, first_key string, first_page long, captures long"


def write_index(captures: DataFrame, root: str) -> DataFrame:
    """Index files below ``root``; returns one row per file with its first key."""
    _make_folder(root)
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, at, directory, block, stream = f"{uuid.uuid4().hex}.idx", 0, 0, [], [], None

        def flush() -> None:
            nonlocal at, block
            packed = zlib.compress("\n".join(json.dumps(x) for x in block).encode())
            directory.append([*block[0][:2], at, len(packed)])
            stream.write(packed)
            at, block = at + len(packed), []

        for batch in batches:
            for row in batch.to_pylist():
                stream = stream or _open(root, name, write=True)
                block.append([row["key"], _LOWEST if row["page_id"] is None else row["page_id"], row["file"], row["at"], row["length"]])
                n += 1
                if len(block) == BLOCK_LINES:
                    flush()
        if n:
            if block:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            stream.write(tail + len(tail).to_bytes(8, "big"))
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first_key": [directory[0][0]], "first_page": [directory[0][1]], "captures": [n]}, schema=_RANGE_ARROW)

    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return saved(ordered.mapInArrow(write, _RANGE))


_RANGE_ARROW = pa.schema([("file", pa.string()), ("first_key", pa.string()), ("first_page", pa.int64()), ("captures", pa.int64())])


class _Range:
    """One index file: its directory, and the block read last."""

    def __init__(self, root: str, name: str):
        self.stream = _open(root, name)
        size = self.stream.size()
        n = int.from_bytes(self.stream.read_at(8, size - 8), "big")
        self.directory = json.loads(zlib.decompress(self.stream.read_at(n, size - 8 - n)))
        self.keys = [(_order(k), p) for k, p, _, _ in self.directory]
        self.number, self.block, self.block_keys = -1, [], []

    def find(self, key: str, page: int) -> Iterator[list]:
        want = (_order(key), page)
        # Equal captures may begin in the block before the first that starts with them.
        number = max(0, bisect.bisect_left(self.keys, want) - 1)
        while number < len(self.keys) and self.keys[number] <= want:
            if number != self.number:
                _, _, at, length = self.directory[number]
                lines = zlib.decompress(self.stream.read_at(length, at)).decode().split("\n")
                self.number, self.block = number, [json.loads(x) for x in lines]
                self.block_keys = [(_order(x[0]), x[1]) for x in self.block]
            i = bisect.bisect_left(self.block_keys, want)
            while i < len(self.block) and self.block_keys[i] == want:
                yield self.block[i]
                i += 1
            number += 1


def _order(key: str) -> bytes:
    """Spark orders texts by their bytes."""
    return key.encode("utf-8", "surrogatepass")


def look_up(wanted: DataFrame, ranges: DataFrame, root: str) -> DataFrame:
    """Captures of the wanted ``url, page_id`` through the index."""
    # One row per index file, as many as there are shuffle partitions.
    heads = sorted(((_order(r.first_key), r.first_page), r.file) for r in ranges.collect())
    first, files = [h[0] for h in heads], [h[1] for h in heads]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key, page = surt(row["url"]), _LOWEST if row["page_id"] is None else row["page_id"]
                want = (_order(key), page)
                # Equal captures may spread over ranges; a range whose first key is higher has none.
                for i in range(max(0, bisect.bisect_left(first, want) - 1), bisect.bisect_right(first, want)):
                    out.append({"file": files[i], "key": key, "page": page})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("key", pa.string()), ("page", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, index = row["file"], _Range(root, row["file"])
                for key, page, file, at, length in index.find(row["key"], row["page"]):
                    out.append({"key": key, "page_id": None if page == _LOWEST else page, "file": file, "at": at, "length": length})
            yield pa.RecordBatch.from_pylist(out, schema=_CAPTURE_ARROW)

    routed = wanted.select("url", "page_id").mapInArrow(route, "file string, key string, page long").distinct()
    return routed.sortWithinPartitions("file", "key", "page").mapInArrow(search, _CAPTURE)


def read_records(captures: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records of ``captures``, each by its byte range; ranges of a file are read in their order."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, stream = row["file"], _open(root, row["file"])
                found = parse(stream.read_at(row["length"], row["at"]))
                out.append(found if payloads else found | {"payload": None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.select("file", "at", "length").repartitionByRange(parts, "file", "at").sortWithinPartitions("file", "at")
    return ordered.mapInArrow(read, _RECORD)


def archive_and_read_back(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives and the index, looks every page up and reads its record."""
    spark = pages.sparkSession
    archives, index = folder(spark, "warc"), folder(spark, "warc-index")
    captures = write_archives(pages, archives, min_bytes)
    ranges = write_index(captures, index)
    found = saved(look_up(pages.select("url", "page_id"), ranges, index))
    return read_records(found, archives, payloads=False).drop("payload")


SQL = r"""
with p as (select page_id, url, coalesce(html, '') h, sha1(coalesce(html, '')) d from pages),
f as (select d, min(page_id) lo from p group by d)
select page_id, strlen(h)::bigint payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(d, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') payload_digest,
       case when page_id = lo then 'response' else 'revisit' end record_type, case when page_id <> lo then lo end refers_to, url
from p join f using (d)
"""
