"""Byte codecs and checksums as column expressions.

Binary columns go in and out. Codecs run inside the JVM; arithmetic on 32-bit words is done in
longs and masked, as ANSI mode raises on overflow. Checksums and hashes, which the JVM functions
could only do byte by byte, take all rows of an Arrow batch at once in NumPy.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strata.sources.bytesum import CRC_MASK_DELTA, HASH_SEED, MASK32, crc32c_of, fixed_of, hash32_of

# Fixed values of the formats.
RECORD_TYPES = ("zero", "full", "first", "middle", "last")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _hex_byte(x: Column) -> Column:
    return F.lpad(F.hex(x), 2, "0")


def bytes_of(b: Column) -> Column:
    """The unsigned bytes of a binary as an array of longs."""
    n = F.octet_length(b)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("long"))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def fixed(x: Column, width: int) -> Column:
    """Little-endian binary of ``width`` bytes; negative longs as two's complement."""
    x, swapped = x.cast("long"), F.lit(0).cast("long")
    for i in range(width):
        swapped = swapped.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255).cast("long")), 8 * (width - 1 - i)))
    return F.unhex(F.lpad(F.hex(swapped), 2 * width, "0"))


@F.arrow_udf(LongType())
def _read_fixed(b: pa.Array, width: pa.Array) -> pa.Array:
    return fixed_of(b, width[0].as_py() if len(width) else 8)


def read_fixed(b: Column, width: int) -> Column:
    """The little-endian number in the first ``width`` bytes; null if there are fewer."""
    return _read_fixed(b, F.lit(width))


def varint_length(x: Column) -> Column:
    """Bytes of the varint of a long, 10 for negative ones."""
    n = F.lit(1)
    for i in range(1, 10):
        n = n + (F.shiftrightunsigned(x.cast("long"), 7 * i) != 0).cast("int")
    return n


def varint(x: Column) -> Column:
    """Seven bits a byte, lowest first; all but the last byte have the high bit set."""
    x = x.cast("long")
    parts = [_hex_byte(x.bitwiseAND(F.lit(127)) + F.when(F.shiftrightunsigned(x, 7) != 0, 128).otherwise(0))]
    for i in range(1, 10):
        rest = F.shiftrightunsigned(x, 7 * i)
        more = F.when(F.shiftrightunsigned(x, 7 * i + 7) != 0, 128).otherwise(0) if i < 9 else F.lit(0)
        parts.append(F.when(rest != 0, _hex_byte(rest.bitwiseAND(F.lit(127)) + more)).otherwise(""))
    return F.unhex(F.concat(*parts))


def read_varint(b: Column, most: int = 10) -> Column:
    """The varint at the start of a binary; null if it is cut short or longer than ``most`` bytes."""

    def decode(x: Column) -> Column:
        last = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(x, i) < 128)
        end = F.get(last, 0)
        return F.when(
            end.isNotNull(),
            F.aggregate(
                F.slice(x, 1, end + 1),
                F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("unit"), F.lit(0).alias("i")),
                lambda acc, y: F.struct(
                    (acc["v"].bitwiseOR(F.try_multiply(y.bitwiseAND(F.lit(127)), acc["unit"]))).alias("v"),
                    F.when(acc["i"] < 8, acc["unit"] * 128).otherwise(acc["unit"]).alias("unit"),
                    (acc["i"] + 1).alias("i"),
                ),
                lambda acc: acc["v"],
            ),
        )

    return let(bytes_of(F.substring(b, 1, most)), decode)


def length_prefixed(b: Column) -> Column:
    return F.concat(varint(F.octet_length(b)), b)


def read_length_prefixed(b: Column) -> Column:
    """The bytes after a varint length; null if they are cut short."""
    return let(
        read_varint(b, 5),
        lambda n: F.when(F.octet_length(b) >= varint_length(n) + n, F.substring(b, (varint_length(n) + 1).cast("int"), n.cast("int"))),
    )


def block_handle(offset: Column, size: Column) -> Column:
    return F.concat(varint(offset), varint(size))


def _kept_null(found, *columns: pa.Array) -> pa.Array:
    missing = columns[0].is_null()
    for c in columns[1:]:
        missing = pa.compute.or_(missing, c.is_null())
    return pa.compute.if_else(missing, pa.scalar(None, pa.int64()), pa.array(found, pa.int64()))


@F.arrow_udf(LongType())
def _crc(b: pa.Array) -> pa.Array:
    return _kept_null(crc32c_of(b), b)


@F.arrow_udf(LongType())
def _crc_after(b: pa.Array, start: pa.Array) -> pa.Array:
    return _kept_null(crc32c_of(b, start.fill_null(0).to_numpy(zero_copy_only=False)), b, start)


@F.arrow_udf(LongType())
def _hash(b: pa.Array, seed: pa.Array) -> pa.Array:
    return _kept_null(hash32_of(b, seed[0].as_py() if len(seed) else 0), b)


def crc32c(b: Column, start: Column | None = None) -> Column:
    """CRC-32C (Castagnoli); ``start`` is the checksum of what comes before ``b``."""
    return _crc(b) if start is None else _crc_after(b, start)


def mask_crc(crc: Column) -> Column:
    """Rotate right by 15 bits and add a constant, so that checksums can be stored among checked data."""
    turned = F.shiftrightunsigned(crc, 15).bitwiseOR(F.shiftleft(crc, 17).bitwiseAND(F.lit(MASK32)))
    return (turned + F.lit(CRC_MASK_DELTA)).bitwiseAND(F.lit(MASK32))


def unmask_crc(masked: Column) -> Column:
    turned = (masked - F.lit(CRC_MASK_DELTA)).bitwiseAND(F.lit(MASK32))
    return F.shiftrightunsigned(turned, 17).bitwiseOR(F.shiftleft(turned, 15).bitwiseAND(F.lit(MASK32)))


def hash32(b: Column, seed: int = HASH_SEED) -> Column:
    """A 32-bit hash of a binary: words of four bytes are mixed in by multiplication and shifts."""
    return _hash(b, F.lit(seed).cast("long"))


def shard_of(b: Column, bits: int = 4) -> Column:
    """The cache shard of a key: the highest bits of its hash."""
    return F.shiftrightunsigned(hash32(b, 0), 32 - bits)


def record_type(code: Column) -> Column:
    """The name of a log record's type; ``unknown`` for codes beyond the last."""
    out = F.when(code == 0, RECORD_TYPES[0])
    for i, name in enumerate(RECORD_TYPES[1:], 1):
        out = out.when(code == i, name)
    return out.otherwise("unknown")
