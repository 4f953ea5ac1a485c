"""A live table that follows a changelog as a stream.

The state is the newest version of each key, kept by a streaming aggregate; keeping the
greatest sequence does not depend on the order of arrival, so no watermark is needed. Each
micro-batch writes the keys it changed to its own folder, named by the batch, so that a
repeated batch replaces itself. ``compact`` merges the folders of all batches but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators import mvcc
from strata.schema import VALUE

COLUMNS = ("user_key", "seq", "vtype", "value")


def changes(stream: DataFrame) -> DataFrame:
    top = stream.groupBy("user_key").agg(F.max(F.struct("seq", "vtype", "value")).alias("_t"))
    return top.select("user_key", "_t.seq", "_t.vtype", "_t.value")


def follow(stream: DataFrame, table: str, checkpoint: str, trigger: dict | None = None, every: int = 0) -> StreamingQuery:
    """Start following; ``trigger`` as for ``DataStreamWriter.trigger``, by default all there is and then stop.
    After each ``every`` batches the older ones are compacted."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        if every and batch_id % every == every - 1:
            compact(batch.sparkSession, table)

    return changes(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live(spark: SparkSession, table: str) -> DataFrame:
    """The live rows of a followed table; its batches may repeat a version."""
    held = spark.read.parquet(table).select(*COLUMNS)
    return mvcc.newest_of_few(held).where(F.col("vtype") == VALUE).select("user_key", "seq", "value")


def compact(spark: SparkSession, table: str) -> int:
    """Merge the folders of all batches but the last, which may yet be repeated, into one; how many went into it.

    The merged folder appears by renaming, before the ones it replaces go. A reader that sees both, or a
    run that ended between, sees versions twice, which are the same.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path(table))]
    number = lambda n: int(n.removeprefix("batch=").removesuffix("-merged"))
    names = sorted((n for n in names if n.startswith("batch=")), key=lambda n: (number(n), n))
    older = [n for n in names if number(n) < number(names[-1])] if names else []
    if len(older) < 2:
        return 0
    if older[-1].endswith("-merged"):  # a run ended before it deleted what it had merged
        older.pop()
    else:
        merged = mvcc.newest_of_few(spark.read.option("basePath", table).parquet(*[f"{table}/{n}" for n in older]).select(*COLUMNS))
        temp = f"{table}/_{uuid.uuid4().hex}"
        merged.write.parquet(temp)
        fs.rename(path(temp), path(f"{table}/{older[-1]}-merged"))
    for n in older:
        fs.delete(path(f"{table}/{n}"), True)
    return len(older)
