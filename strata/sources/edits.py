"""Manifest edits in their byte format: tagged fields, one edit per log record."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.sources.bytesum import put_varint, take_varint

# Fixed values of the format: the tag of each field and the parts that follow it,
# n for a number and b for length-prefixed bytes.
FIELDS = {
    "comparator": (1, "b"),
    "log": (2, "n"),
    "next_file": (3, "n"),
    "last_seq": (4, "n"),
    "compact_ptr": (5, "nb"),
    "del": (6, "nn"),
    "add": (7, "nnnbb"),
    "prev_log": (9, "n"),
}
_BY_TAG = {tag: (kind, parts) for kind, (tag, parts) in FIELDS.items()}


def encode(fields: list[tuple]) -> bytes:
    """``(kind, part, ...)`` for each field, in order."""
    out = bytearray()
    for kind, *values in fields:
        tag, parts = FIELDS[kind]
        out += put_varint(tag)
        for part, v in zip(parts, values, strict=True):
            out += put_varint(v) if part == "n" else put_varint(len(v)) + v
    return bytes(out)


def decode(data: bytes) -> list[tuple]:
    """The fields of an edit; ValueError names an unknown tag or the field that is cut short."""
    at, out = 0, []
    while at < len(data):
        tag, at = take_varint(data, at, 5)
        if tag not in _BY_TAG:
            raise ValueError("unknown tag")
        kind, parts = _BY_TAG[tag]
        values = []
        for part in parts:
            try:
                n, at = take_varint(data, at)
            except ValueError:
                raise ValueError(f"bad {kind}") from None
            if part == "b":
                if at + n > len(data):
                    raise ValueError(f"bad {kind}")
                n, at = data[at : at + n], at + n
            values.append(n)
        out.append((kind, *values))
    return out


SCHEMA = "edit_id long, pos long, kind string, level long, file_no long, file_size long, smallest binary, largest binary, num long, text string, reason string"


def read_edits(records: DataFrame) -> DataFrame:
    """Log records ``(record_no, payload)`` -> edit rows as ``operators.manifest`` takes them.

    An edit that does not decode is one row with a reason.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]

    def rows_of(no: int, payload: bytes) -> Iterator[dict]:
        try:
            fields = decode(payload)
        except ValueError as e:
            yield {"edit_id": no, "reason": str(e)}
            return
        for pos, (kind, *v) in enumerate(fields):
            row = {"edit_id": no, "pos": pos, "kind": kind}
            if kind == "add":
                row |= dict(zip(("level", "file_no", "file_size", "smallest", "largest"), v, strict=True))
            elif kind == "del":
                row |= {"level": v[0], "file_no": v[1]}
            elif kind == "compact_ptr":
                row |= {"level": v[0], "text": v[1].hex()}
            else:
                row |= {"text": v[0].decode()} if kind == "comparator" else {"num": v[0]}
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for no, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows_of(no, p)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return records.where(F.col("payload").isNotNull()).select("record_no", "payload").mapInArrow(run, SCHEMA)
