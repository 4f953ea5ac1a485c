"""Block layout of sorted entries: shared prefixes, restart points, cuts and index keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions.codec import varint_length
from strata.functions.keys import short_successor, shortest_separator
from strata.operators.fold import fold


def shared_prefix(a: Column, b: Column) -> Column:
    """Length in bytes of the common prefix of two keys."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differs, 0) - 1, n)).cast("int")


def prefix_deltas(entries: DataFrame, group: str, key: str = "user_key", interval: int = 16) -> DataFrame:
    """Add ``restart``, ``shared`` and ``suffix`` of each entry in key order within its group."""
    order = Window.partitionBy(group).orderBy(key)
    out = entries.withColumns({"restart": (F.row_number().over(order) - 1) % interval == 0, "_p": F.lag(key).over(order)})
    shared = F.when(F.col("restart"), 0).otherwise(shared_prefix(F.col("_p"), F.col(key)))
    return out.withColumn("shared", shared.cast("int")).withColumn("suffix", F.expr(f"substring({key}, shared + 1)")).drop("_p")


def cut_blocks(entries: DataFrame, group: str, key: str = "user_key", value: str = "value", size: int = 4096, interval: int = 16) -> DataFrame:
    """``block_no`` of each entry: a block closes once its entries and restart array reach ``size``.

    The size of a block depends on where the last one was cut, so each file is folded in order. Only
    the lengths of values take part; the result has all columns but ``value``.
    """
    rows = entries.withColumns({"_k": F.col(key).cast("binary"), "_n": F.coalesce(F.octet_length(value), F.lit(0))}).drop(value)

    def begin():
        block, used, count, last = 0, 0, 0, b""
        width = lambda x: max(1, -(-int(x).bit_length() // 7))

        def step(k: bytes, n: int) -> tuple[int]:
            nonlocal block, used, count, last
            shared, now = 0, block
            if count % interval:
                least = min(len(k), len(last))
                while shared < least and k[shared] == last[shared]:
                    shared += 1
            used += width(shared) + width(len(k) - shared) + width(n) + len(k) - shared + n
            count, last = count + 1, k
            if used + 4 * (-(-count // interval)) + 4 >= size:
                block, used, count = block + 1, 0, 0
            return (now,)

        return step

    return fold(rows, group, ["_k"], ["_k", "_n"], begin, "block_no long").drop("_k", "_n")


def block_index(blocked: DataFrame, group: str, key: str = "user_key") -> DataFrame:
    """One index key per block: a short key from its last key up to the next block's first, and a
    short successor for the last block."""
    ends = blocked.groupBy(group, "block_no").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n_entries"))
    after = F.lead("first_key").over(Window.partitionBy(group).orderBy("block_no"))
    out = ends.withColumn("next_key", after)
    a, b = F.col("last_key").cast("binary"), F.col("next_key").cast("binary")
    return out.withColumn("index_key", F.when(b.isNull(), short_successor(a)).otherwise(shortest_separator(a, b)))


def entry_bytes(shared: Column, suffix: Column, value: Column) -> Column:
    n = lambda x: F.octet_length(x)
    return varint_length(shared) + varint_length(n(suffix)) + varint_length(n(value)) + n(suffix) + n(value)
