"""The manifest: a log of edits whose replay gives the live files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.keys import file_kind, file_number


def replay(edits: DataFrame, upto: int | None = None) -> DataFrame:
    """``(edit_id, pos, kind, level, file_no, ...)`` -> the files added and not deleted since.

    The last action on (level, file) counts, in order of edits and, within one, deletions first.
    The maximum combines within tasks, so a manifest of any length is one small shuffle.
    """
    rows = edits.where(F.col("kind").isin("add", "del"))
    rows = rows if upto is None else rows.where(F.col("edit_id") <= upto)
    payload = [c for c in edits.columns if c not in ("edit_id", "pos", "kind", "level", "file_no")]
    order = F.struct("edit_id", (F.col("kind") == "add").cast("int").alias("is_add"), "pos")
    last = rows.groupBy("level", "file_no").agg(F.max_by(F.struct("kind", *payload), order).alias("_l"))
    return last.where("_l.kind = 'add'").select("level", "file_no", *[F.col(f"_l.{c}") for c in payload])


def live_set(edits: DataFrame, versions: list[int]) -> DataFrame:
    """The files that any of the versions in use names, each version being the state after an edit."""
    return reduce(DataFrame.union, [replay(edits, v).select("level", "file_no") for v in versions]).distinct()


def pointers(edits: DataFrame) -> DataFrame:
    """The last compaction pointer of each level."""
    rows = edits.where("kind = 'compact_ptr'")
    return rows.groupBy("level").agg(F.max_by("text", F.struct("edit_id", "pos")).alias("pointer"))


def numbers(edits: DataFrame) -> DataFrame:
    """The last value of each counter: log numbers, next file, last sequence."""
    return edits.where(F.col("num").isNotNull()).groupBy("kind").agg(F.max_by("num", F.struct("edit_id", "pos")).alias("num"))


def missing(edits: DataFrame) -> DataFrame:
    """The counters that a complete manifest has and this one lacks."""
    needed = edits.sparkSession.createDataFrame([("next_file",), ("log",), ("last_seq",)], "kind string")
    return needed.join(numbers(edits), "kind", "left_anti")


def parse_listing(names: DataFrame) -> DataFrame:
    return names.select("name", file_kind(F.col("name")).alias("kind"), file_number(F.col("name")).alias("number"))


def classify(listing: DataFrame, live: DataFrame, pending: DataFrame, log_no: int, prev_log: int, manifest_no: int) -> DataFrame:
    """Every recognised file with ``keep``: tables and temporary files if live or pending, logs and
    manifests from the current number on, the rest always."""
    held = live.select("file_no").union(pending.select("file_no")).distinct().withColumn("held", F.lit(True))
    rows = listing.where("kind is not null").join(held, listing["number"] == held["file_no"], "left")
    kept = (
        F.when(F.col("kind").isin("table", "temp"), F.coalesce("held", F.lit(False)))
        .when(F.col("kind") == "log", (F.col("number") >= log_no) | (F.col("number") == prev_log))
        .when(F.col("kind") == "manifest", F.col("number") >= manifest_no)
        .otherwise(True)
    )
    return rows.select("name", "kind", "number", kept.alias("keep"))


def lost(live: DataFrame, listing: DataFrame) -> DataFrame:
    """Live files that the listing lacks."""
    there = listing.where("kind = 'table'").select(F.col("number").alias("file_no"))
    return live.join(there, "file_no", "left_anti")


def logs_to_replay(listing: DataFrame, min_log: int, prev_log: int) -> DataFrame:
    return listing.where((F.col("kind") == "log") & ((F.col("number") >= min_log) | (F.col("number") == prev_log))).orderBy("number")
