"""Write batches: sequence assignment, checks, appending and group commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.operators.fold import fold
from strata.operators.order import running_total

HEADER = 12
PUT, DELETE = 1, 0
GROUP_CAP, SMALL_HEAD = 1 << 20, 128 << 10


def record_bytes(key: Column, value: Column, vtype: Column) -> Column:
    """A record: tag, length-prefixed key and, for puts, length-prefixed value."""
    from strata.functions.codec import varint_length

    part = lambda b: varint_length(F.octet_length(b)) + F.octet_length(b)
    return (F.lit(1) + part(key) + F.when(vtype == PUT, part(value)).otherwise(0)).cast("long")


def assign_sequences(records: DataFrame, last_seq: int) -> DataFrame:
    """``(batch_id, pos)`` -> with ``base_seq`` of the batch and ``seq`` of the record.

    Batches are numbered in order of their ids; each begins one above the last of its predecessor.
    """
    sizes = records.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    bases = running_total(sizes, ["batch_id"], F.col("n"), "upto").select("batch_id", (F.col("upto") - F.col("n") + last_seq + 1).alias("base_seq"))
    order = Window.partitionBy("batch_id").orderBy("pos")
    return records.join(bases, "batch_id").withColumn("seq", F.col("base_seq") + F.row_number().over(order) - 1)


def summarise(records: DataFrame) -> DataFrame:
    """Count and encoded size of each batch."""
    return records.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_records"), (F.sum(record_bytes(F.col("user_key"), F.col("value"), F.col("vtype"))) + HEADER).cast("long").alias("n_bytes")
    )


def validate(headers: DataFrame, records: DataFrame) -> DataFrame:
    """``headers(batch_id, told)`` -> a status for each batch: wrong counts and unknown tags are corrupt."""
    found = records.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("vtype").isin(PUT, DELETE)).alias("bad"))
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    status = F.when(bad > 0, "unknown tag").when(n != F.col("told"), "wrong count").otherwise("ok")
    return headers.join(found, "batch_id", "left").select("batch_id", status.alias("status"))


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of ``second`` after those of the batch of the same id in ``first``; the receiver's base stays."""
    sizes = first.groupBy("batch_id").agg((F.max("pos") + 1).alias("shift"))
    moved = second.join(sizes, "batch_id", "left").withColumn("pos", F.col("pos") + F.coalesce("shift", F.lit(0))).drop("shift")
    return first.unionByName(moved)


def group_commit(queue: DataFrame, by: str = "queue") -> DataFrame:
    """``(queue, pos, n_bytes, sync)`` -> with ``group_no``: the greedy merge of waiting batches.

    A group starts at its head; later batches join while the group stays within 1 MiB, or within
    the head's size and 128 KiB for a small head. A sync batch never joins a head that is not sync.
    Each step depends on the last cut, so a queue is folded in order.
    """

    def begin():
        size, cap, sync, group = 0, -1, False, -1

        def step(n: int, s: bool) -> tuple[int]:
            nonlocal size, cap, sync, group
            if group < 0 or size + n > cap or (s and not sync):
                group, size, sync = group + 1, 0, s
                cap = n + SMALL_HEAD if n <= SMALL_HEAD else GROUP_CAP
            size += n
            return (group,)

        return step

    return fold(queue, by, ["pos"], ["n_bytes", "sync"], begin, "group_no long")
