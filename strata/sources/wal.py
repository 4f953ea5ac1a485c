"""Log files: records framed as checksummed fragments in blocks of 32 KiB."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.bytesum import crc32c, masked, put_varint, take_varint

# Fixed values of the format.
BLOCK, HEADER = 32768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def fragments(sizes: Iterable[int], offset: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """``(record, type, at, start, length)``: where each fragment lies in the file, given the place to begin.

    A block's last bytes are padded if no header fits; an empty record is one empty fragment.
    """
    at = offset
    for record, size in enumerate(sizes):
        start, begun = 0, False
        while True:
            left = BLOCK - at % BLOCK
            if left < HEADER:
                at += left
                left = BLOCK
            n = min(size - start, left - HEADER)
            ends = start + n == size
            kind = (FULL if ends else FIRST) if not begun else (LAST if ends else MIDDLE)
            yield record, kind, at, start, n
            at, start, begun = at + HEADER + n, start + n, True
            if ends:
                break


def encode(records: list[bytes], offset: int = 0) -> bytes:
    """The bytes to append to a log of length ``offset``."""
    out, at = bytearray(), offset
    for record, kind, place, start, n in fragments(map(len, records), offset):
        out += bytes(place - at)
        data = records[record][start : start + n]
        out += struct.pack("<IHB", masked(crc32c(bytes([kind]) + data)), n, kind) + data
        at = place + HEADER + n
    return bytes(out)


def decode(data: bytes, offset: int = 0) -> Iterator[tuple[bytes | None, int, str | None]]:
    """``(payload, 0, None)`` for records and ``(None, bytes, reason)`` for what is dropped, in order.

    A wrong checksum drops the rest of its block. A header or payload that the end of the file
    cuts short is the mark of a writer that died, not damage.

    Records begin at ``offset`` or after it. Reading starts with its block, or the next one if no header fits
    behind it; fragments before it, and then those of a record begun before it, are passed over silently.
    """
    parts: list[bytes] | None = None
    begun = offset <= 0  # a record has begun at or after the offset
    start = offset - offset % BLOCK + (BLOCK if offset % BLOCK > BLOCK - HEADER else 0) if offset > 0 else 0
    for base in range(start, len(data), BLOCK):
        block = data[base : base + BLOCK]
        last, at = len(block) < BLOCK or base + BLOCK >= len(data), 0
        while at + HEADER <= len(block):
            crc, n, kind = struct.unpack_from("<IHB", block, at)
            body = block[at + HEADER : at + HEADER + n]
            if kind == 0 and n == 0:
                break  # a padded tail
            if len(body) < n:
                if not last:
                    yield None, len(block) - at, "bad record length"
                    if parts is not None:
                        parts = None
                break
            if masked(crc32c(bytes([kind]) + body)) != crc:
                yield None, len(block) - at + sum(map(len, parts or ())), "checksum mismatch"
                parts = None
                break
            place, at = base + at, at + HEADER + n
            if place < offset or not (begun := begun or kind in (FULL, FIRST)):
                continue
            if kind in (FULL, FIRST):
                if parts is not None:
                    yield None, sum(map(len, parts)), "partial record without end"
                parts = [body]
            elif kind in (MIDDLE, LAST):
                if parts is None:
                    yield None, n, "missing start of fragmented record"
                    continue
                parts.append(body)
            else:
                yield None, n + sum(map(len, parts or ())), "unknown record type"
                parts = None
                continue
            if kind in (FULL, LAST):
                yield b"".join(parts), 0, None
                parts = None


def read_logs(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """All records of log files that begin at ``offset`` or after it, one file a task: ``(path, record_no, payload, dropped_bytes, reason)``.

    Dropped stretches are rows with a reason and no payload.
    """
    schema = "path string, record_no long, payload binary, dropped_bytes long, reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(p, i, *x) for i, x in enumerate(decode(content.as_py(), offset))]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def encode_batch(base_seq: int, records: list[tuple[int, bytes, bytes | None]]) -> bytes:
    """A write batch: base sequence, count, then (vtype, key, value) records."""
    out = bytearray(struct.pack("<QI", base_seq, len(records)))
    for vtype, key, value in records:
        out += bytes([vtype]) + put_varint(len(key)) + key
        if vtype == 1:
            out += put_varint(len(value)) + value
    return bytes(out)


def visit_batch(data: bytes, put: Callable[[bytes, bytes], None], delete: Callable[[bytes], None]) -> int:
    """Hand the records of a batch to ``put`` and ``delete`` in order; its base sequence. ValueError tells what is corrupt,
    after the records before it have been handed over."""
    if len(data) < 12:
        raise ValueError("batch too small")
    base, count = struct.unpack_from("<QI", data)
    at, n = 12, 0

    def part(at: int, what: str) -> tuple[bytes, int]:
        try:
            size, at = take_varint(data, at, 5)
        except ValueError:
            raise ValueError(f"bad batch {what}") from None
        if at + size > len(data):
            raise ValueError(f"bad batch {what}")
        return data[at : at + size], at + size

    while at < len(data):
        vtype, at = data[at], at + 1
        if vtype not in (0, 1):
            raise ValueError("unknown batch tag")
        key, at = part(at, "put" if vtype else "delete")
        if vtype:
            value, at = part(at, "put")
            put(key, value)
        else:
            delete(key)
        n += 1
    if n != count:
        raise ValueError("batch has wrong count")
    return base


def decode_batch(data: bytes) -> list[tuple[int, int, bytes, bytes | None]]:
    """``(seq, vtype, key, value)`` of each record; ValueError tells what is corrupt."""
    rows: list[tuple[int, bytes, bytes | None]] = []
    base = visit_batch(data, lambda k, v: rows.append((1, k, v)), lambda k: rows.append((0, k, None)))
    return [(base + i, *r) for i, r in enumerate(rows)]


def replay(logs: DataFrame, paranoid: bool = False) -> DataFrame:
    """Log records -> changelog rows. What does not decode is a row with a reason, or, if ``paranoid``,
    fails the job, as does any stretch that the reader dropped."""
    schema = "user_key binary, seq long, vtype int, value binary, reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for payload in b.column(0).to_pylist():
                try:
                    rows += [(k, s, t, v, None) for s, t, k, v in decode_batch(payload)]
                except ValueError as e:
                    if paranoid:
                        raise
                    rows.append((None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    if paranoid:
        why = F.concat(F.lit("log damaged: "), F.col("reason"))
        logs = logs.withColumn("payload", F.when(F.col("reason").isNotNull(), F.raise_error(why).cast("binary")).otherwise(F.col("payload")))
    return logs.where(F.col("payload").isNotNull()).select("payload").mapInArrow(run, schema)


def recover(spark: SparkSession, folder: str, min_log: int, prev_log: int = 0, paranoid: bool = False) -> DataFrame:
    """The changelog rows of all logs of a folder that the manifest has not made obsolete."""
    number = F.regexp_extract("path", r"(\d+)\.log$", 1).cast("long")
    logs = read_logs(spark, f"{folder}/*.log").withColumn("number", number)
    return replay(logs.where((F.col("number") >= min_log) | (F.col("number") == prev_log)), paranoid)
