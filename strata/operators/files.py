"""File tables ``(level, file_no, smallest, largest, file_size, n_entries)``.

Files of level 0 may overlap, so all of them that hold a key are looked up; compactions keep them few, nothing
else does. Files of deeper levels are disjoint, so a key has at most one file there, which an ordered merge finds.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from strata.operators.order import bucketed, places, running_total
from strata.schema import L0_COMPACTION, LEVELS, allowed_seeks, level_bytes


def metadata(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries -> one row per file, with its size as key + 8 + value and its seek budget."""
    size = F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))
    out = entries.groupBy(*by).agg(
        F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.sum(size).cast("long").alias("file_size"), F.count(F.lit(1)).alias("n_entries")
    )
    return out.withColumn("allowed_seeks", allowed_seeks(F.col("file_size")))


def level_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("n_bytes"))


def level_summary(files: DataFrame) -> DataFrame:
    """``files[ a b c d e f g ]``: the number of files of each level."""
    counts = files.agg(*[F.count_if(F.col("level") == i).cast("string").alias(f"l{i}") for i in range(LEVELS)])
    return counts.select(F.concat(F.lit("files[ "), F.concat_ws(" ", *[f"l{i}" for i in range(LEVELS)]), F.lit(" ]")).alias("summary"))


def scores(files: DataFrame) -> DataFrame:
    """The compaction score of each level that has files: 1 or more means due. The last level has none."""
    level = F.col("level")
    by_bytes = F.col("n_bytes") / level_bytes(level)
    return level_counts(files).where(level < LEVELS - 1).withColumn("score", F.when(level == 0, F.col("n_files") / float(L0_COMPACTION)).otherwise(by_bytes))


def pick_level(files: DataFrame) -> DataFrame:
    """The level with the largest score, the lowest of equals."""
    best = F.max_by(F.struct("level", "score"), F.struct("score", -F.col("level")))
    return scores(files).agg(best.alias("_b")).select("_b.level", "_b.score", (F.col("_b.score") >= 1).alias("due"))


def overlapping(files: DataFrame, low=None, high=None) -> DataFrame:
    """Files that hold keys of [low, high]; None is open."""
    out = files if low is None else files.where(F.col("largest") >= F.lit(low))
    return out if high is None else out.where(F.col("smallest") <= F.lit(high))


#: Files and ranges of a bucket of keys, about, where they meet.
PER_BUCKET = 32
#: Buckets of a node's child, as a power of two; groups into which the ranges and the files that reach over one of the largest nodes are dealt.
FAN, RANGE_GROUPS, FILE_GROUPS = 4, 32, 8


def _with_nodes(df: DataFrame, columns: list[str], nodes: Callable[..., list[int]]) -> DataFrame:
    """A row for each of a row's ``nodes(n, *columns)``, in ``_node``, n being its number in the task.

    Batches are mapped in Python: a filter on an expression of the places would be evaluated below aggregates, for each entry.
    """
    out = StructType([*df.schema.fields, StructField("_nodes", ArrayType(LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            found = [nodes(n + i, *values) for i, values in enumerate(zip(*(b.column(c).to_pylist() for c in columns), strict=True))]
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], out.names)

    return df.mapInArrow(run, out).withColumn("_node", F.explode("_nodes")).drop("_nodes")


def met(ranges: DataFrame, files: DataFrame, by: tuple[str, ...] = (), cuts: list[tuple] | None = None) -> DataFrame:
    """``ranges(low, high, ...)`` with each file they overlap, null bounds open; columns ``by`` of both must be equal.

    A file either begins within the range, or the range begins within the file, after its first key. Either way a key lies in
    a stretch of keys. Keys are cut into buckets that files and ranges divide evenly, buckets into nodes of 1, 16 and 256 of
    them: a stretch is a row of the few nodes that it is made of, a key one of each node around it, and they meet by an
    equality join in exactly one node. What reaches over the largest nodes is dealt into groups, so that no task has all of it.
    """
    if cuts is None:
        begins = files.select(F.col("smallest").alias("at")).union(ranges.where("low is not null").select("low"))
        cuts = places(begins, ["at"], PER_BUCKET)
    at = [bytes(c) if isinstance(c, bytearray) else c for (c,) in cuts if c is not None]
    top = 2 if len(at) >= 1 << 2 * FAN else 1 if len(at) >= 1 << FAN else 0
    place = lambda key: bisect_right(at, key)

    def number(side: int, level: int, node: int, group: int) -> int:
        return ((side * 4 + level) << 32 | node) << 8 | group

    def stretch(side: int, low: int, high: int, group: int) -> list[int]:
        found, level, high = [], 0, high + 1
        while low < high:
            if level == top:
                return found + [number(side, level, i, group) for i in range(low, high)]
            up = min(high, -(-low >> FAN) << FAN)
            down = max(up, high >> FAN << FAN)
            found += [number(side, level, i, 0) for i in (*range(low, up), *range(down, high))]
            if up == down:
                break
            low, high, level = up >> FAN, down >> FAN, level + 1
        return found

    def around(side: int, bucket: int, groups: int) -> list[int]:
        return [number(side, level, bucket >> FAN * level, g) for level in range(top + 1) for g in range(groups if level == top else 1)]

    def of_range(n: int, low, high) -> list[int]:
        inside = stretch(0, 0 if low is None else place(low), len(at) if high is None else place(high), n % RANGE_GROUPS)
        return inside if low is None else inside + around(1, place(low), FILE_GROUPS)

    def of_file(n: int, smallest, largest) -> list[int]:
        first = place(smallest)
        return around(0, first, RANGE_GROUPS) + stretch(1, first, place(largest), n % FILE_GROUPS)

    # as many partitions whatever the rows' bytes: what they make is more than what they are
    parts = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(at) >> FAN)
    left = _with_nodes(ranges, ["low", "high"], of_range).repartition(parts, "_node", *by)
    both = left.join(_with_nodes(files, ["smallest", "largest"], of_file).repartition(parts, "_node", *by), ["_node", *by])
    low, inside = F.col("low"), F.shiftright("_node", 42) == 0
    meets = (low.isNull() | (F.col("largest") >= low)) & (F.col("high").isNull() | (F.col("smallest") <= F.col("high")))
    return both.where(meets & (inside == (low.isNull() | (F.col("smallest") >= low)))).drop("_node")


def range_matches(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """``ranges(range_no, low, high)`` with the files each overlaps, null bounds open."""
    return met(ranges, files)


def some_overlap(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """The ``ranges(range_no, low, high)`` that any file overlaps, null bounds open.

    Of the files that begin at or before a range's end the largest key decides: it comes from a running maximum in the merged
    order of ends and files, within buckets and then across them, so no range meets the files it overlaps one by one.
    """
    ends = ranges.where("high is not null")
    begins = files.select(F.col("smallest").alias("at"), F.lit(0).alias("kind"), F.col("largest").alias("reach"), F.lit(None).cast(ranges.schema).alias("r"))
    asks = ends.select(F.col("high").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(files.schema["largest"].dataType).alias("reach"), F.struct(*ranges.columns).alias("r"))
    both = bucketed(begins.union(asks), ["at"], places(files, ["smallest"]), "bucket")
    inner = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = both.groupBy("bucket").agg(F.max("reach").alias("most"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("bucket", F.max("most").over(earlier).alias("before"))
    reach = F.greatest("near", "before")
    found = both.withColumn("near", F.max("reach").over(inner)).where("kind = 1").join(tops, "bucket").where(reach.isNotNull() & (F.col("r.low").isNull() | (reach >= F.col("r.low")))).select("r.*")
    whole = files.agg(F.max("largest").alias("_most"))
    openly = ranges.where("high is null").crossJoin(F.broadcast(whole)).where(F.col("_most").isNotNull() & (F.col("low").isNull() | (F.col("_most") >= F.col("low")))).drop("_most")
    return found.unionByName(openly)


def islands(files: DataFrame) -> DataFrame:
    """Groups of files whose ranges are connected by overlaps: ``(level, island, low, high, n_files)``."""
    order = Window.partitionBy("level").orderBy("smallest", "file_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = files.withColumn("reach", F.max("largest").over(before))
    cut = cut.withColumn("starts", F.when(F.col("reach").isNull() | (F.col("smallest") > F.col("reach")), 1).otherwise(0))
    return (
        cut.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("level", "island")
        .agg(F.min("smallest").alias("low"), F.max("largest").alias("high"), F.count(F.lit(1)).alias("n_files"))
    )


def closure(files: DataFrame, low, high) -> list[int]:
    """Level-0 files that overlap [low, high] once the range is widened by each file found.

    The widening is sequential, so all rows of level 0, which are metadata, are looked at here, on the driver.
    """
    held = sorted((r["file_no"], r["smallest"], r["largest"]) for r in files.where("level = 0").select("file_no", "smallest", "largest").collect())
    chosen: set[int] = set()
    grown = True
    while grown:
        grown = False
        for no, a, b in held:
            if no not in chosen and (low is None or b >= low) and (high is None or a <= high):
                chosen.add(no)
                low, high = (None if low is None else min(low, a)), (None if high is None else max(high, b))
                grown = True
    return sorted(chosen)


def merged(keys: DataFrame, files: DataFrame, by: str, cuts: list[tuple] | None = None) -> DataFrame:
    """Each (level, key) with the first file whose ``by`` bound is at or after the key.

    Keys and bounds are merged within buckets that a sample of the keys divides evenly; the first file
    after a bucket comes from a table of one row per level and bucket.
    """
    rows = files.select("level", F.col(by).alias("at"), F.lit(1).alias("kind"), F.struct(*files.columns).alias("f"))
    asks = keys.select("level", F.col("user_key").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["f"].dataType).alias("f"))
    cuts = places(keys, ["user_key"]) if cuts is None else cuts
    both = bucketed(rows.unionByName(asks), ["at"], cuts, "bucket")
    ahead = Window.partitionBy("level", "bucket").orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    heads = both.groupBy("level", "bucket").agg(F.min_by("f", F.when(F.col("f").isNotNull(), F.col("at"))).alias("head"))
    later = Window.partitionBy("level").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    carried = heads.withColumn("carried", F.first("head", ignorenulls=True).over(later)).select("level", "bucket", "carried")
    near = both.withColumn("near", F.first("f", ignorenulls=True).over(ahead)).where("kind = 0").join(carried, ["level", "bucket"])
    return near.select("level", F.col("at").alias("user_key"), F.coalesce("near", "carried").alias("found"))


def covered(keys: DataFrame, ranges: DataFrame, cuts: list[tuple] | None = None) -> DataFrame:
    """The distinct ``user_key``s that lie in any of ``ranges(smallest, largest)``.

    Overlapping ranges are joined to disjoint ones first; each key then meets one of them at most, by
    an ordered merge. No join by inequality, however many ranges there are.
    """
    numbered = ranges.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("file_no"), "smallest", "largest")
    disjoint = islands(numbered).select("level", F.col("low").alias("smallest"), F.col("high").alias("largest"))
    asked = keys.select(F.lit(0).alias("level"), "user_key").distinct()
    return merged(asked, disjoint, "largest", places(keys, ["user_key"]) if cuts is None else cuts).where(F.col("found.smallest") <= F.col("user_key")).select("user_key")


def find_file(keys: DataFrame, files: DataFrame) -> DataFrame:
    """``keys(level, user_key)`` -> the first file of the level whose largest key is at or after the key."""
    return merged(keys.distinct(), files, "largest", places(keys, ["user_key"])).select("level", "user_key", F.col("found.file_no").alias("file_no"))


def files_to_search(keys: DataFrame, files: DataFrame) -> DataFrame:
    """``keys(user_key)`` -> ``(user_key, level, file_no, probe_order)``: the files a lookup may read.

    Level 0 first, its newest file first, then the one covering file of each deeper level.
    """
    asked = keys.select("user_key").distinct()
    points = asked.select("user_key", F.col("user_key").alias("low"), F.col("user_key").alias("high"))
    cuts = places(keys, ["user_key"])
    young = met(points, files.where("level = 0"), (), cuts).select("user_key", "level", "file_no")
    levels = asked.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS - 1))))
    deep = merged(levels, files.where("level > 0"), "largest", cuts).where(F.col("found.smallest") <= F.col("user_key"))
    both = young.unionByName(deep.select("user_key", "level", F.col("found.file_no").alias("file_no")))
    order = Window.partitionBy("user_key").orderBy("level", F.col("file_no").desc())
    return both.withColumn("probe_order", F.row_number().over(order).cast("long"))


def next_level_overlap(files: DataFrame) -> DataFrame:
    """For each file from level 1 on, the bytes of the next level it overlaps."""
    above = files.where("level > 0").select("level", "file_no", F.col("smallest").alias("low"), F.col("largest").alias("high"))
    below = files.select((F.col("level") - 1).alias("level"), "smallest", "largest", F.col("file_size").alias("bytes"))
    found = met(above, below, ("level",)).groupBy("level", "file_no").agg(F.sum("bytes").alias("bytes"))
    return above.select("level", "file_no").join(found, ["level", "file_no"], "left").select("level", "file_no", F.coalesce("bytes", F.lit(0)).cast("long").alias("overlap_bytes"))


def approximate_sizes(ranges: DataFrame, entries: DataFrame) -> DataFrame:
    """``ranges(range_no, low, high)`` -> bytes stored in [low, high).

    Sizes are summed by key first; each bound then takes the running total at its place in the
    merged order of keys and bounds, so no range is joined to the keys it spans.
    """
    size = F.octet_length("user_key") + 8 + F.coalesce(F.octet_length("value"), F.lit(0))
    keys = entries.groupBy("user_key").agg(F.sum(size).cast("long").alias("bytes"))
    rows = keys.select(F.col("user_key").alias("at"), F.lit(1).alias("kind"), "bytes", F.lit(None).cast("long").alias("range_no"), F.lit(0).alias("side"))
    bound = lambda c, side: ranges.where(F.col(c).isNotNull()).select(F.col(c).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bytes"), "range_no", F.lit(side).alias("side"))
    both = rows.unionByName(bound("low", -1)).unionByName(bound("high", 1))
    cuts = [(*at, 0) for at in places(entries, ["user_key"])]
    totals = running_total(both, ["at", "kind"], F.col("bytes"), "before", cuts).where("kind = 0")
    return totals.groupBy("range_no").agg(F.greatest(F.sum(F.col("before") * F.col("side")), F.lit(0)).cast("long").alias("bytes"))
