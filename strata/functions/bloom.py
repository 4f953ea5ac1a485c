"""Bloom filters as relations: bit positions, building, and membership by join or by expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.codec import hash32, let
from strata.sources.bytesum import HASH_SEED, MASK32

# Fixed values of the format.
MIN_BITS, MOST_PROBES, WINDOW_BITS = 64, 30, 11


def probes(bits_per_key: int) -> int:
    return max(1, min(MOST_PROBES, int(bits_per_key * 0.69)))


def filter_bits(n_keys: Column, bits_per_key: int) -> Column:
    """Bits of a filter for so many keys: at least 64, in whole bytes."""
    return F.ceil(F.greatest(n_keys * bits_per_key, F.lit(MIN_BITS)) / 8).cast("long") * 8


def positions(key: Column, bits: Column, bits_per_key: int) -> Column:
    """The bits a key sets, by double hashing."""

    def at(h: Column) -> Column:
        delta = F.shiftrightunsigned(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(F.lit(MASK32)))
        return F.transform(F.sequence(F.lit(0), F.lit(probes(bits_per_key) - 1)), lambda j: (h + j * delta).bitwiseAND(F.lit(MASK32)) % bits)

    return let(hash32(key, HASH_SEED), at)


def _bits_set(keys: DataFrame, group: list[str], key: str, bits_per_key: int) -> DataFrame:
    """``(group..., bits, p)``: the positions that the keys of each group set."""
    counted = keys.select(*group, key).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    sized = keys.select(*group, F.col(key).cast("binary").alias("_k")).join(counted, group).withColumn("bits", filter_bits(F.col("n"), bits_per_key))
    return sized.select(*group, "bits", F.explode(positions(F.col("_k"), F.col("bits"), bits_per_key)).alias("p"))


def build(keys: DataFrame, group: list[str], key: str = "user_key", bits_per_key: int = 10) -> DataFrame:
    """``(group..., byte_no, byte_value, bits)``: the bytes of each group's filter that are not zero.

    A filter is a set of rows, so it may be larger than any one task; bits are combined by a
    partial aggregate before they are shuffled.
    """
    split = _bits_set(keys, group, key, bits_per_key).withColumns({"byte_no": F.shiftright("p", 3), "bit": F.expr("shiftleft(1L, cast(p % 8 as int))")})
    return split.groupBy(*group, "bits", "byte_no").agg(F.bit_or("bit").alias("byte_value"))


#: Bits of a filter in one bitmap of ``bitmaps``.
PART = 1 << 15


def bitmaps(keys: DataFrame, group: list[str], key: str = "user_key", bits_per_key: int = 10) -> DataFrame:
    """``(group..., bits, part, bitmap)``: each filter as one binary, or one for each PART bits of it."""
    each = _bits_set(keys, group, key, bits_per_key)
    return each.groupBy(*group, "bits", F.floor(F.col("p") / PART).cast("long").alias("part")).agg(F.bitmap_construct_agg(F.col("p") % PART).alias("bitmap"))


def _is_set(bitmap: Column, p: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright((p % PART).cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (p % 8).cast("int")) == 1


def probe(asked: DataFrame, filters: DataFrame, group: list[str], key: str = "user_key", bits_per_key: int = 10) -> DataFrame:
    """``asked(group..., key)`` and ``bitmaps`` -> the distinct asked rows with ``may_match``; a group without a filter
    matches nothing. A key meets its filter in one row, or in one for each part of it that its positions lie in."""
    sizes = filters.select(*group, "bits").distinct()
    each = asked.distinct().join(sizes, group, "left").withColumn("_p", positions(F.col(key).cast("binary"), F.coalesce("bits", F.lit(MIN_BITS).cast("long")), bits_per_key))
    parts = F.array_distinct(F.transform("_p", lambda p: F.floor(p / PART).cast("long")))
    met = each.withColumn("part", F.explode(parts)).join(filters.drop("bits"), [*group, "part"], "left")
    here = F.filter("_p", lambda p: F.floor(p / PART).cast("long") == F.col("part"))
    hit = F.coalesce(F.col("bitmap").isNotNull() & F.forall(here, lambda p: _is_set(F.col("bitmap"), p)), F.lit(False))
    return met.groupBy(*group, key).agg(F.bool_and(hit).alias("may_match"))


def may_match(key: Column, filter_: Column) -> Column:
    """Membership in an encoded filter: its bits, then one byte with the number of probes.

    Null filters and those under two bytes hold nothing; a probe count above 30 is reserved and
    matches everything.
    """
    n = F.octet_length(filter_)
    k = F.conv(F.hex(F.substring(filter_, n, F.lit(1))), 16, 10).cast("int")
    bits = (n - 1) * 8

    def held(h: Column) -> Column:
        delta = F.shiftrightunsigned(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(F.lit(MASK32)))

        def is_set(j: Column) -> Column:
            p = (h + j * delta).bitwiseAND(F.lit(MASK32)) % bits
            byte = F.conv(F.hex(F.substring(filter_, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
            return F.floor(byte / F.pow(F.lit(2.0), p % 8)).cast("long") % 2 == 1

        return F.forall(F.sequence(F.lit(0), k - 1), is_set)

    return F.when(F.coalesce(n, F.lit(0)) < 2, False).when(k > MOST_PROBES, True).otherwise(let(hash32(key, HASH_SEED), held))


def encode(bits: list[int], size: int, bits_per_key: int = 10) -> bytes:
    """The encoded filter of bit positions: for export of one file's filter."""
    out = bytearray(size // 8)
    for p in bits:
        out[p // 8] |= 1 << (p % 8)
    return bytes(out) + bytes([probes(bits_per_key)])


def window_of(offset: Column) -> Column:
    """The filter of a data block: one for each 2 KiB of file offset."""
    return F.shiftrightunsigned(offset, WINDOW_BITS)
