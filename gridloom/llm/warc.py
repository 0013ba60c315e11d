"""WARC archives: written one gzip member a record, read back as a stream.

``write_archives`` puts a record per page into files in a shared folder (named by task and attempt) and lists the
finished files in a manifest written by Spark, so files of lost attempts are never read. ``read_archives`` takes each
file in order: zlib decompresses member by member in steps, the header gives the block's length, and block and
payload digests are verified. Of pages with equal payloads of ``least`` bytes or more that with the smallest id is a
``response`` and the others are ``revisit`` records without a payload.

Null html is an empty payload, a null url an empty one; characters that would break a header line are escaped. A null id
is written as ``null`` and comes after all others; of equal rows (same id and payload) each is the response or each a
revisit of another page.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, fresh_path, map_arrow

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16
#: Tasks that archives are dealt to at most; with more archives a task reads several in turn.
READERS = 10_000


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record, not yet compressed; ``refers_to`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {quote(url or '', safe='%:/?#[]@!$&()*+,;=~-._')}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Members:
    """A file object's gzip members, decompressed in steps; ``read`` stays within the present member."""

    def __init__(self, source: BinaryIO):
        self.source, self.raw, self.z, self.out = source, b"", None, bytearray()

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if self.z is not None and (self.out or not self.z.eof):
            raise ValueError("bytes are left in the member")
        if not self.raw:
            self.raw = self.source.read(STEP)
        self.z, self.out = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(STEP)
        if not self.raw:
            raise EOFError("the file ends within a member")
        self.out += self.z.decompress(self.raw, 1 << 20)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self.more():
                raise ValueError("no end of the header")
        found = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in steps."""
        while n:
            if not self.out and not self.more():
                raise ValueError("the block is shorter than its Content-Length")
            part = bytes(self.out[:n])
            del self.out[: len(part)]
            n -= len(part)
            if part:
                yield part


def read_records(source: BinaryIO, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order; raises on a wrong length or digest."""
    stream = Members(source)
    while stream.next_member():
        lines = stream.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        whole, body, http, size, kept = hashlib.sha256(), hashlib.sha256(), b"", 0, []
        in_body = False
        for part in stream.take(int(head["content-length"])):
            whole.update(part)
            if not in_body:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                in_body, part, http = True, http[at + 4 :], http[:at]
            body.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
        if b"".join(stream.take(4)) != b"\r\n\r\n" or stream.out or stream.more() and stream.out:
            raise ValueError("the record does not end after its block")
        if head["warc-block-digest"] != f"sha256:{whole.hexdigest()}":
            raise ValueError("the block's digest differs")
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        full = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        if kind == "response" and (digest != body.hexdigest() or size != full):
            raise ValueError("the payload's digest or length differs")
        yield {
            "page_id": _number(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": kind, "payload_bytes": full, "payload_digest": digest,
            "refers_to": _number(head["warc-refers-to"]) if kind == "revisit" else None, "payload": b"".join(kept) if with_payload and kind == "response" else None,
        }


def _number(urn: str) -> int | None:
    last = urn.strip("<>").rpartition(":")[2]
    return None if last == "null" else int(last)


def _file_system(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, archive_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives under ``folder`` (a URI that all executors reach); returns the manifest: path, records, bytes."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    firsts = base.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # only ids and digests are shuffled to find the revisits
    later = base.select("page_id", "digest", "size").where(F.col("size") >= least).join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    later = later.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first").distinct()
    rows = base.join(later, base["page_id"].eqNullSafe(F.col("_p")) & (base["digest"] == F.col("_d")), "left")
    rows = rows.select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).cast("binary").alias("html"), "digest", "size", "first")

    def run(batches):
        fs, root = _file_system(folder)
        out, path, n, size = None, None, 0, 0
        for batch in batches:
            for page_id, url, html, digest, full, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path)
                out.write(data := member(record(page_id, url, html or b"", digest, full, first, date)))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield {"path": [path], "records": [n], "bytes": [size]}
        if out is not None:
            out.close()
            yield {"path": [path], "records": [n], "bytes": [size]}

    local, root = _file_system(folder)
    local.create_dir(root, recursive=True)
    return cut(map_arrow(rows, run, "path string, records long, bytes long"), "manifest")[0]


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``manifest``: page_id, url, record_type, payload_bytes, payload_digest, refers_to
    (and payload); a file is read by one task, from its start on, and files are dealt over as many tasks, up to READERS."""

    def run(batches):
        fs, _ = _file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out: dict[str, list] = {}
                with fs.open_input_stream(path) as source:
                    for i, r in enumerate(read_records(source, with_payload), 1):
                        for k, v in r.items():
                            if k != "payload" or with_payload:
                                out.setdefault(k, []).append(v)
                        if i % 2000 == 0 or sum(map(len, filter(None, out.get("payload", [])))) > 16 << 20:
                            yield out
                            out = {}
                if out:
                    yield out

    cols = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return map_arrow(manifest.select("path").repartition(max(1, min(READERS, manifest.count()))), run, cols)


def archive_round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back."""
    folder = fresh_path(spark, "warc")
    return read_archives(write_archives(pages, folder, **options), folder)
