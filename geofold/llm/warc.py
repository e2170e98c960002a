"""WARC archives with revisit records for repeated payloads.

1. ``write`` puts every page into an archive as a response, one gzip member a record.
2. ``headers`` reads archives back, streaming: record headers with place and digest.
3. Headers, without payloads, are grouped by payload digest and size; the largest page
   id of a digest is its original, and the others are joined to it.
4. ``rewrite`` copies each archive with fresh headers: originals with their payload,
   the others as revisit records that name their original.

Archives go to the folder that driver and executors share. A task writes under a fresh
name and reports it; only reported files are read, so a task that is run again leaves
nothing wrong behind. A hot digest costs a header a page: the largest id is summed up
before the shuffle and the join's large side can be split by Spark.

Null html is an empty payload; a null url becomes a urn of the page id; a null page id
stays null and ranks below all others. Of repeated rows with the largest id the first
record is the original.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofold.llm import _store

DATE = "2020-01-01T00:00:00Z"
ROLL = 256 << 20
LEVEL = 1
AT_LEAST = 0
PLACE = "path string, n long"
HEADER = "path string, start long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, sha: str, original: int | None = None, original_url: str | None = None) -> bytes:
    """One record; a revisit has no payload, only the HTTP head and the name of its original."""
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {page_id} {sha} {uri}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Payload-Length", str(size)),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("X-Page-URL", quote(url, safe="")))
    if kind == "revisit":
        there = quote(original_url, safe=":/?#[]@!$&'()*+,;=%~-._") if original_url else f"urn:page:{original}"
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response {original} {sha} {there}')}>"), ("WARC-Refers-To-Target-URI", there), ("WARC-Refers-To-Date", DATE)]
        if original is not None:
            fields.append(("X-Refers-To-Page", str(original)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


class Writer:
    """Writes gzip members below a shared folder, a new file after ROLL bytes."""

    def __init__(self, folder: str):
        self.fs, self.folder = _store.local_or_fs(folder)
        self.out, self.done = None, []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.path, self.size, self.n = f"{self.folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
            self.out = self.fs.open_output_stream(self.path, compression=None)
        z = zlib.compressobj(LEVEL, wbits=31)
        member = z.compress(raw) + z.flush()
        self.out.write(member)
        self.size += len(member)
        self.n += 1
        if self.size >= ROLL:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.n))
            self.out = None

    def report(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in self.done], pa.string()), pa.array([n for _, n in self.done], pa.int64())], ["path", "n"])


def members(folder: str, path: str) -> Iterator[tuple[int, bytes]]:
    """(start, record) of the gzip members of a file, one held at a time."""
    fs, _ = _store.local_or_fs(folder)
    with fs.open_input_stream(path, compression=None) as f:
        at, buf, z, parts, used = 0, b"", None, [], 0
        while True:
            if not buf:
                buf = f.read(1 << 20)
                if not buf:
                    if z is not None:
                        raise ValueError(f"{path}: cut off in the member at {at}")
                    return
            z = z or zlib.decompressobj(wbits=31)
            parts.append(z.decompress(buf))
            used += len(buf) - len(z.unused_data)
            buf = z.unused_data
            if z.eof:
                yield at, b"".join(parts)
                at, z, parts, used = at + used, None, [], 0


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of a record; a revisit's payload is empty."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _whole(x: str | None) -> int | None:
    return None if x is None else int(x)


def _unquoted(x: str | None) -> str | None:
    from urllib.parse import unquote

    return None if x is None else unquote(x)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """(path, n) of the archives written for (page_id, url, html); lazy: write it to keep it."""

    def run(batches):
        w = Writer(folder)
        for b in batches:
            for i, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body = (html or "").encode("utf-8", "surrogatepass")
                w.add(record("response", i, url, body, len(body), digest(body)))
        yield w.report()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, PLACE)


def headers(archives: DataFrame, folder: str, files: int) -> DataFrame:
    """A row per record of the archives; a response's digest and size are taken from its payload."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for at, raw in members(folder, path):
                    f, payload = parse(raw)
                    sha, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if f["WARC-Type"] == "response" and (digest(payload), len(payload)) != (sha, size):
                        raise ValueError(f"{path}: the record at {at} doesn't match its digest")
                    rows.append((path, at, _whole(f.get("X-Page-ID")), _unquoted(f.get("X-Page-URL")), f["WARC-Type"], _whole(f.get("X-Refers-To-Page")), size, sha))
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return archives.select("path").repartition(max(1, files), "path").mapInArrow(run, HEADER)


_KINDS = [("path", pa.string()), ("start", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def _batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in _KINDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _KINDS)], [n for n, _ in _KINDS])


def resolve(heads: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """(path, start, original, original_url) of every record; original names the response of a revisit."""
    place = F.struct("page_id", F.col("path").alias("path"), (-F.col("start")).alias("back"), "url")
    # written by itself: a join right above its sum could not be split where a digest is hot
    best = _store.written(heads.where(F.col("payload_bytes") >= at_least).groupBy("payload_digest", "payload_bytes").agg(F.max(place).alias("top")), "warc-best")
    own = (F.col("top.path") == F.col("path")) & (F.col("top.back") == -F.col("start"))
    return heads.join(best, ["payload_digest", "payload_bytes"], "left").select(
        "path", "start", (F.col("top").isNull() | own).alias("first"), F.col("top.page_id").alias("original"), F.col("top.url").alias("original_url")
    )


def rewrite(decided: DataFrame, source: str, folder: str, files: int) -> DataFrame:
    """(path, n) of the deduplicated archives."""

    def run(batches):
        w, path, stream = Writer(folder), None, None
        for b in batches:
            for p, at, first, original, there in zip(*(b.column(c).to_pylist() for c in ("path", "start", "first", "original", "original_url"))):
                if p != path:
                    path, stream = p, members(source, p)
                place, raw = next(stream)
                while place != at:
                    place, raw = next(stream)
                f, payload = parse(raw)
                i, url, sha, size = _whole(f.get("X-Page-ID")), _unquoted(f.get("X-Page-URL")), f["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload)
                w.add(record("response", i, url, payload, size, sha) if first else record("revisit", i, url, None, size, sha, original, there))
        yield w.report()

    return decided.repartition(max(1, files), "path").sortWithinPartitions("path", "start").mapInArrow(run, PLACE)


def deduplicate(pages: DataFrame, at_least: int = AT_LEAST) -> tuple[DataFrame, str]:
    """(headers of the deduplicated archives, their folder)."""
    spark = pages.sparkSession
    first, second = _store.scratch(spark, "warc-all"), _store.scratch(spark, "warc-dedup")
    made = _store.written(write(pages, first), "warc-list")
    n = made.count()
    heads = _store.written(headers(made, first, n), "warc-head")
    final = _store.written(rewrite(resolve(heads, at_least), first, second, n), "warc-list")
    return headers(final, second, final.count()), second


