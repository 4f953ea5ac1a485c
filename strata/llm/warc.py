"""WARC archives: one gzip member per record, written and read sequentially.

Archives lie in a shared folder. Each task writes one file under a temporary name and renames
it when it is whole, so a lost or repeated task leaves no half-written archive; the names of
the finished files come back as rows. The reader inflates member by member in small chunks,
frames the block by its content length and digests the payload as it passes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize, scratch_path

CHUNK = 1 << 16
DATE = "2020-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{page_id}/{digest}')}>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url or "about:blank")


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member; ``refers_to`` is the page whose record holds an equal payload, or None.

    A revisit's block is the HTTP header alone, whose Content-Length still tells the payload's length.
    """
    digest = base32_sha1(payload)
    head = HTTP.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


class WarcError(ValueError):
    """An archive that is cut short, badly framed or whose digest does not fit."""


class _Members:
    """The inflated bytes of one gzip member after another."""

    def __init__(self, source):
        self.source, self.rest, self.inflate, self.ready = source, b"", None, bytearray()

    def open(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.rest:
            self.rest = self.source.read(CHUNK)
        self.inflate, self.ready = zlib.decompressobj(31), bytearray()
        return bool(self.rest)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.rest or self.source.read(CHUNK)
        if not data:
            raise WarcError("the archive ends within a record")
        self.ready += self.inflate.decompress(data, CHUNK)
        self.rest = self.inflate.unused_data if self.inflate.eof else b""
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes up to and with ``mark``: a header, which is held whole as the writer held it."""
        seen = 0
        while (at := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if not self._more():
                raise WarcError("a header has no end")
        out = bytes(self.ready[: at + len(mark)])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self._more():
                raise WarcError("a block is shorter than its content length")
            part = bytes(self.ready[:n])
            del self.ready[:n]
            n -= len(part)
            yield part

    def end(self) -> None:
        """The two line ends after a block, and nothing else."""
        while not self.inflate.eof:
            self._more()
        if self.ready != b"\r\n\r\n":
            raise WarcError("a record does not end after its content length")


@dataclass
class Record:
    fields: dict[str, str]
    payload_bytes: int
    digest: str
    payload: bytes | None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def read_records(source, payloads: bool = False) -> Iterator[Record]:
    """Records of an open archive in order. A payload is kept only if asked for; digests are checked."""
    members = _Members(source)
    while members.open():
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise WarcError("a member does not begin with a record")
        fields = _fields(head)
        http = members.until(b"\r\n\r\n")
        block, payload, kept, n = hashlib.sha1(http), hashlib.sha1(), [], int(fields["content-length"]) - len(http)
        if n < 0:
            raise WarcError("a block is shorter than its HTTP header")
        for part in members.take(n):
            block.update(part)
            payload.update(part)
            if payloads:
                kept.append(part)
        members.end()
        told = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-block-digest"] != "sha1:" + base64.b32encode(block.digest()).decode():
            raise WarcError(f"block digest of {fields['warc-record-id']}")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and told != base64.b32encode(payload.digest()).decode():
            raise WarcError(f"payload digest of {fields['warc-record-id']}")
        yield Record(fields, int(_fields(http)["content-length"]) if revisit else n, told, b"".join(kept) if payloads else None)


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def payload_of(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, sha, refers_to)``: of equal payloads of at least ``least`` bytes the largest page_id
    is the response, and rows that repeat it too. A null page_id revisits any other."""
    each = pages.select("page_id", F.sha1(payload_of(F.col("html"))).alias("sha"), (F.octet_length(payload_of(F.col("html"))) >= least).alias("shared"))
    each = materialize(each, "payloads")
    last = each.where("shared").groupBy("sha").agg(F.max("page_id").alias("last"))
    refers = F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))
    return each.distinct().join(last, "sha", "left").select("page_id", "sha", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` to archives under ``folder`` -> ``(path, records)``."""
    held = pages.select("page_id", "url", "html", F.sha1(payload_of(F.col("html"))).alias("_sha"))
    known = plan(pages, least)
    todo = held.join(known, F.col("_sha").eqNullSafe(known["sha"]) & held["page_id"].eqNullSafe(known["page_id"]))
    todo = todo.select(held["page_id"].cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, sink, n = uuid.uuid4().hex, None, 0
        for b in batches:
            if sink is None and len(b):
                sink = fs.open_output_stream(f"{base}/.{name}.open", compression=None)
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sink.write(record(page_id, url, (html or "").encode("utf-8"), refers_to))
                n += 1
        if sink is not None:
            sink.close()
            fs.move(f"{base}/.{name}.open", f"{base}/{name}.warc.gz")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.warc.gz"], "records": pa.array([n], pa.int64())})

    return materialize(todo.mapInArrow(run, "path string, records long"), "archives")


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the archives of column ``path``, one task a file at a time."""
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _filesystem(path)
                rows, held = [], 0

                def batch(rows):
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

                with fs.open_input_stream(at, compression=None) as source:
                    for r in read_records(source, payloads):
                        row = (r.fields.get("x-page-id"), r.payload_bytes, r.digest, r.fields["warc-type"], r.fields.get("x-refers-to-page-id"))
                        rows.append((*row, r.payload) if payloads else row)
                        held += len(r.payload or b"")
                        if len(rows) >= 10_000 or held > 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, paths.count())
    return paths.select("path").repartition(n).mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives of all ``pages`` to the shared folder and read them back, one row per record.

    A null html is an empty payload, a null url is written as about:blank. Rows that repeat a page_id are
    records each; of equal payloads the largest page_id is the response, and all rows that repeat it. A null
    page_id revisits any other. Headers and payloads of any length are whole; an empty table gives an empty one.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    kind = dict(pages.dtypes)["page_id"]
    return read_archives(write_archives(pages, folder, least)).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
