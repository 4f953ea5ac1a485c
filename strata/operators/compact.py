"""What a compaction keeps, where it cuts its outputs and where a flushed file goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.operators.files import covered, merged, met
from strata.operators.fold import fold
from strata.operators.mvcc import newer_seq
from strata.operators.order import places, running_total
from strata.schema import DELETION, GRANDPARENT_FACTOR, MAX_MEMTABLE_LEVEL, TARGET_FILE_SIZE


def smallest_snapshot(snapshots: DataFrame, last_seq: int) -> int:
    """The oldest live snapshot, or the last sequence if there is none."""
    row = snapshots.agg(F.min("seq").alias("s")).head()
    return last_seq if row["s"] is None else row["s"]


def drop_hidden(entries: DataFrame, snapshot: int) -> DataFrame:
    """Without entries that a newer one at or below the snapshot hides from every reader."""
    return newer_seq(entries).where(F.col("p").isNull() | (F.col("p") > snapshot)).drop("p")


def at_base_level(keys: DataFrame, deeper: DataFrame) -> DataFrame:
    """Rows of ``keys`` whose key no deeper file covers."""
    return keys.join(covered(keys, deeper), "user_key", "left_anti")


def drop_obsolete(entries: DataFrame, snapshot: int, deeper: DataFrame | None) -> DataFrame:
    """``drop_hidden``, and without deletions at or below the snapshot that have nothing deeper to hide.
    ``deeper(smallest, largest)`` are the files of all levels below the output's; None says there are none."""
    kept = drop_hidden(entries, snapshot)
    dead = (F.col("vtype") == DELETION) & (F.col("seq") <= snapshot)
    if deeper is None:
        return kept.where(~dead)
    # only the deletions at issue are looked up
    hides = kept.where(dead)
    # by buckets of the entries, which are read for it, not of what is left of them
    found = covered(hides, deeper, places(entries, ["user_key"]))
    return kept.where(~dead).unionByName(hides.join(found, "user_key", "left_semi").select(*kept.columns))


def with_corrupt(entries: DataFrame, snapshot: int) -> DataFrame:
    """``entries`` with ``is_valid`` and ``pos``: invalid keys are never dropped, and the entry after one
    counts as the first of its key. Invalid keys are counted within buckets of positions, then across them."""
    broken = F.when(F.col("is_valid"), 0).otherwise(1).cast("long")
    runs = running_total(entries, ["pos"], broken, "run")
    p = F.lag("seq").over(Window.partitionBy("run", "user_key", "is_valid").orderBy(F.col("seq").desc()))
    return runs.withColumn("p", F.when(F.col("is_valid"), p)).where(~F.col("is_valid") | F.col("p").isNull() | (F.col("p") > snapshot)).drop("run", "p")


def split_by_size(entries: DataFrame, limit: int = TARGET_FILE_SIZE) -> DataFrame:
    """Add ``output_no``: the entries in key order, cut where their running size passes a multiple of ``limit``."""
    size = F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = entries.withColumn("_size", size.cast("long"))
    # ties of a key stay in sequence order: newest first
    total = running_total(rows.withColumn("_neg", -F.col("seq")), ["user_key", "_neg"], F.col("_size"), "_upto")
    return total.withColumn("output_no", F.floor((F.col("_upto") - F.col("_size")) / limit).cast("long")).drop("_size", "_neg", "_upto")


def grandparent_cuts(keys: DataFrame, grandparents: DataFrame, cap: int) -> DataFrame:
    """``keys(compaction, user_key, seq)`` in internal order -> with ``cut``: whether an output ends before the key.

    While the keys pass files two levels down, ``grandparents(largest, file_size)``, those files' sizes are
    summed; above ``cap`` the sum starts anew and the output is cut. What lies before each key comes from an
    ordered merge with the running size of the files; the fold over a compaction only tells where it starts anew.
    """
    placed = running_total(grandparents.select("largest", "file_size"), ["largest"], F.col("file_size"), "_upto")
    held = placed.select(F.lit(0).alias("level"), "largest", (F.col("_upto") - F.col("file_size")).alias("before"))
    asked = keys.select(F.lit(0).alias("level"), "user_key").distinct()
    found = merged(asked, held, "largest", places(keys, ["user_key"])).select("user_key", F.col("found.before").alias("_before"))
    whole = grandparents.agg(F.sum("file_size")).head()[0] or 0
    passed = keys.join(found, "user_key").withColumn("_passed", F.coalesce("_before", F.lit(whole).cast("long"))).withColumn("_neg", -F.col("seq"))

    def begin():
        base = None

        def step(passed: int) -> tuple[bool]:
            nonlocal base
            base = passed if base is None else base
            cut = passed - base > cap
            base = passed if cut else base
            return (cut,)

        return step

    return fold(passed, "compaction", ["user_key", "_neg"], ["_passed"], begin, "cut boolean").select(*keys.columns, "cut")


def trivial_moves(candidates: DataFrame, cap: int = GRANDPARENT_FACTOR * TARGET_FILE_SIZE) -> DataFrame:
    """``(n_inputs, n_next, grandparent_bytes)`` -> with ``trivial``: the file may move down unread."""
    return candidates.withColumn("trivial", (F.col("n_inputs") == 1) & (F.col("n_next") == 0) & (F.col("grandparent_bytes") <= cap))


def memtable_levels(flushed: DataFrame, files: DataFrame, cap: int = GRANDPARENT_FACTOR * TARGET_FILE_SIZE) -> DataFrame:
    """``flushed(range_no, low, high)`` -> the level each new file goes to.

    Level 0 if level 0 overlaps; else down while the next level has no overlap and the level after
    it not too much, to level 2 at most.
    """
    per = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("file_size"))), F.lit(0))
    found = met(flushed, files.select("level", "smallest", "largest", "file_size")).select("range_no", "level", "file_size")
    bytes_ = flushed.select("range_no").join(found, "range_no", "left").groupBy("range_no").agg(*[per(i).alias(f"b{i}") for i in range(MAX_MEMTABLE_LEVEL + 2)])
    level = F.lit(MAX_MEMTABLE_LEVEL)
    for i in reversed(range(MAX_MEMTABLE_LEVEL)):
        level = F.when((F.col(f"b{i + 1}") > 0) | (F.col(f"b{i + 2}") > cap), i).otherwise(level)
    return bytes_.select("range_no", F.when(F.col("b0") > 0, 0).otherwise(level).cast("long").alias("level"))
