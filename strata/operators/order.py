"""Totals, ranks and neighbours over a global order, without a global window.

Rows are dealt into buckets at places of the order that a sample of the rows divides evenly, so
no choice of keys makes a bucket of them all, and a key with very many rows is divided too where
the order has further columns. Windows run within buckets; what crosses them is carried by a
table with one row per bucket. The places are literals: the same in every branch of a plan and
in every attempt of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets for each shuffle partition, and at most; rows of the sample for each bucket.
PER_PARTITION, MOST, SAMPLE = 2, 4096, 32
#: Places that a row is compared with by a tree of conditions; beyond, the places between two of them are counted.
TREE = 64


def places(rows: DataFrame, order: list[str], per: int | None = None) -> list[tuple]:
    """Places of ``order`` that divide the rows about evenly, in order: for buckets of ``per`` rows, or by default as many
    as the shuffle's partitions call for.

    Two jobs over the columns of the order alone: a count and a sample, which reaches the driver.
    """
    keys = rows.select(*order)
    held = keys.count()
    n = PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) if per is None else max(2, held // per)
    n = min(MOST, n)
    want = SAMPLE * n
    if held > want:
        keys = keys.sample(min(1.0, 1.2 * want / held), seed=7)
    # strings compare by code points here and by their bytes in Spark, which is the same order; nulls come first
    sample = sorted((tuple(r) for r in keys.collect()), key=lambda r: [(v is not None, bytes(v) if isinstance(v, bytearray) else v) for v in r])
    found = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []
    return list(dict.fromkeys(found))


def bucket_of(cuts: list[tuple], order: list[str], kinds: dict[str, str]) -> Column:
    """The number of places at or before a row."""
    lit = lambda cut: [F.lit(v).cast(kinds[c]).alias(c) for v, c in zip(cut, order, strict=True)]
    own = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    at = (lambda cut: lit(cut)[0]) if len(order) == 1 else (lambda cut: F.struct(*lit(cut)))
    step = -(-len(cuts) // TREE) if len(cuts) > TREE else 1

    def count(low: int, high: int) -> Column:
        """Of the places low * step to high * step, given that the first is at or before the row and the last is not."""
        if high - low == 1:
            between = cuts[low * step + 1 : high * step] if low >= 0 else cuts[: max(0, high * step)]
            more = F.size(F.filter(F.array(*map(at, between)), lambda c: c <= own)) if between else F.lit(0)
            return F.lit(max(0, low * step + 1)) + more
        middle = (low + high) // 2
        return F.when(own >= at(cuts[middle * step]), count(middle, high)).otherwise(count(low, middle))

    return count(-1, -(-len(cuts) // step)).cast("int") if cuts else F.lit(0)


def bucketed(df: DataFrame, order: list[str], cuts: list[tuple] | None = None, into: str = "_b") -> DataFrame:
    """Add the bucket of each row; ``cuts`` by default from the rows themselves."""
    cuts = places(df, order) if cuts is None else cuts
    return df.withColumn(into, bucket_of(cuts, order, dict(df.dtypes)))


def running_total(df: DataFrame, order: list[str], value: Column, into: str, cuts: list[tuple] | None = None, total: str | None = None) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and with each row, and if ``total`` names a column, over all rows."""
    rows = bucketed(df.withColumn("_v", value), order, cuts)
    inner = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("_b").agg(F.sum("_v").alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"), *([F.sum("_s").over(Window.partitionBy()).alias(total)] if total else []))
    return rows.withColumn("_run", F.sum("_v").over(inner)).join(before, "_b").withColumn(into, F.col("_run") + F.col("_before")).drop("_b", "_v", "_run", "_before")


def rank_all(df: DataFrame, order: str, into: str = "rank", descending: bool = False, cuts: list[tuple] | None = None) -> DataFrame:
    """Add the 1-based rank of each row by ``order``, which is unique."""
    out = running_total(df, [order], F.lit(1).cast("long"), "_up", cuts, "_all")
    return out.withColumn(into, F.col("_all") + 1 - F.col("_up") if descending else F.col("_up")).drop("_up", "_all")


def neighbours(df: DataFrame, order: str, cuts: list[tuple] | None = None) -> DataFrame:
    """Add ``next_<order>`` and ``prev_<order>`` of each row; ``order`` is unique."""
    rows = bucketed(df, [order], cuts)
    inner = Window.partitionBy("_b").orderBy(order)
    edges = rows.groupBy("_b").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    across = Window.orderBy("_b")
    edges = edges.select("_b", F.lag("_hi").over(across).alias("_last"), F.lead("_lo").over(across).alias("_first"))
    return (
        rows.withColumns({"_n": F.lead(order).over(inner), "_p": F.lag(order).over(inner)})
        .join(edges, "_b")
        .withColumns({f"next_{order}": F.coalesce("_n", "_first"), f"prev_{order}": F.coalesce("_p", "_last")})
        .drop("_b", "_n", "_p", "_first", "_last")
    )
