"""Reads of a multi-versioned changelog ``(user_key, seq, vtype, value)``.

A read at sequence S sees, of each key, the row with the largest seq <= S, and sees the key
only if that row is a value. Aggregates by key combine within tasks before the shuffle, so a
key with very many versions costs no single task more than its partial results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.schema import DELETION, VALUE


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest visible version of each key, deletions included; (key, seq) is unique in a log.

    The largest sequence of each key is found by hashing, from two narrow columns; the rows themselves
    meet it in one join, so that neither values nor whole rows are sorted on both sides of a shuffle.
    """
    rows = visible(log, snapshot).select("user_key", "seq", "vtype", "value")
    return rows.join(rows.groupBy("user_key").agg(F.max("seq").alias("seq")), ["user_key", "seq"]).select("user_key", "seq", "vtype", "value")


def newest_of_few(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The same where a filter on keys leaves little of the log: one pass, one shuffle."""
    top = visible(log, snapshot).groupBy("user_key").agg(F.max(F.struct("seq", "vtype", "value")).alias("_t"))
    return top.select("user_key", "_t.seq", "_t.vtype", "_t.value")


def scan(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The live rows at a snapshot: ``(user_key, seq, value)``."""
    return newest(log, snapshot).where(F.col("vtype") == VALUE).select("user_key", "seq", "value")


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """The live row of one key, or none; the key's filter reaches the scan."""
    found = newest_of_few(log.where(F.col("user_key") == F.lit(key)), snapshot)
    return found.where(F.col("vtype") == VALUE).select("user_key", "seq", "value")


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``keys(user_key)`` -> ``(user_key, status, value)`` for each asked key, repeats included."""
    asked = keys.select("user_key")
    found = newest(log.join(asked.distinct(), "user_key", "left_semi"), snapshot)
    status = F.when(F.col("vtype") == VALUE, "FOUND").when(F.col("vtype") == DELETION, "DELETED").otherwise("NOT_FOUND")
    return asked.join(found, "user_key", "left").select("user_key", status.alias("status"), F.when(F.col("vtype") == VALUE, F.col("value")).alias("value"))


def as_of(log: DataFrame, probes: DataFrame, width: int = 1 << 16) -> DataFrame:
    """``probes(user_key, snapshot)`` -> the same with the version each sees: ``(seq, vtype, value)``.

    Both sides are merged by sequence within each key and stretch of ``width`` sequences, so a
    hot key is many groups; what a stretch begins with comes from a table of one row per key
    and stretch. Nothing is joined by inequality. Probes that see nothing have nulls.
    """
    rows = log.select("user_key", F.col("seq").alias("at"), F.lit(0).alias("kind"), F.struct("seq", "vtype", "value").alias("v"))
    asks = probes.select("user_key", F.col("snapshot").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["v"].dataType).alias("v"))
    both = rows.unionByName(asks).withColumn("stretch", F.floor(F.col("at") / width).cast("long"))
    inner = Window.partitionBy("user_key", "stretch").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("seen", F.last("v", ignorenulls=True).over(inner)).where("kind = 1")
    ends = both.groupBy("user_key", "stretch").agg(F.max("v").alias("end"))
    before = Window.partitionBy("user_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).select("user_key", "stretch", "carried")
    out = seen.join(carried, ["user_key", "stretch"]).withColumn("seen", F.coalesce("seen", "carried"))
    return out.select("user_key", F.col("at").alias("snapshot"), "seen.seq", "seen.vtype", "seen.value")


def key_range(rows: DataFrame, low=None, high=None, key: str = "user_key") -> DataFrame:
    """Rows with low <= key < high; a bound of None is open. The plain comparison reaches the scan."""
    out = rows if low is None else rows.where(F.col(key) >= F.lit(low))
    return out if high is None else out.where(F.col(key) < F.lit(high))


def prefix_range(rows: DataFrame, prefix: str, key: str = "user_key") -> DataFrame:
    return rows.where(F.col(key).startswith(prefix))


def seek(rows: DataFrame, targets: list, key: str = "user_key") -> DataFrame:
    """For each target of a short list, the first key at or after it; all in one pass over the keys."""
    found = rows.agg(*[F.min(F.when(F.col(key) >= F.lit(t), F.col(key))).alias(f"t{i}") for i, t in enumerate(targets)])
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"t{i}").alias(key)) for i, t in enumerate(targets)])
    return found.select(F.explode(pairs).alias("_p")).select("_p.*")


#: Sequences in a stretch: a key's versions are ordered within stretches, so a hot key is many groups.
STRETCH = 1 << 20


def newer_seq(entries: DataFrame, into: str = "p", width: int = STRETCH) -> DataFrame:
    """Add the sequence of the next newer entry of the key; null for the newest.

    It is looked up within the stretch; for the last entry of a stretch it is the first one of the
    key's next stretch, from a table of one row per key and stretch.
    """
    rows = entries.withColumn("_s", F.floor(F.col("seq") / width).cast("long"))
    inner = Window.partitionBy("user_key", "_s").orderBy(F.col("seq").desc())
    firsts = rows.groupBy("user_key", "_s").agg(F.min("seq").alias("_m"))
    after = firsts.withColumn("_next", F.lead("_m").over(Window.partitionBy("user_key").orderBy("_s"))).drop("_m")
    found = rows.withColumn("_in", F.lag("seq").over(inner)).join(after, ["user_key", "_s"])
    return found.select(*entries.columns, F.coalesce("_in", "_next").alias(into))


def all_versions(log: DataFrame, width: int = STRETCH) -> DataFrame:
    """Every entry with the sequence of the next newer entry of its key, null for the newest."""
    return newer_seq(log.select("user_key", "seq", "vtype", "value"), "newer_seq", width)


def first_last(rows: DataFrame, key: str = "user_key") -> DataFrame:
    return rows.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """The union of sorted sources; each row tells its source, which settles ties of (key, seq)."""
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged)


def in_internal_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("user_key").asc(), F.col("seq").desc(), F.col("vtype").desc())
