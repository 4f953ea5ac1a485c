"""Mixing sources to target weights, on DataFrame functions.

Word counts are summed by source, targets are filled by weight up to twice each source's
size, and every document is emitted floor(rate) times plus one further copy with the
probability of the fraction, drawn from a hash of the seed and the document's id.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import WORD, materialize

#: Weights by the rank of the source's name, repeating; the share of all words to take; most copies of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = "mix-1"
#: Sources that one task sorts, about.
RANGE = 1 << 16


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{WORD}+")).cast("long")


def ranked(sizes: DataFrame, most: int = RANGE) -> DataFrame:
    """Add ``rank``, from 0 on, of each source by code point, null last. Sources are sorted within ranges of about
    ``most`` of them, and a range begins where the counts of those before it end; no task holds them all."""
    name = F.col("source")
    ranges = -(-sizes.count() // most)
    if ranges > 1:
        dealt = sizes.withColumn("_null", name.isNull()).repartitionByRange(ranges, "_null", "source").withColumn("_part", F.spark_partition_id())
        dealt = materialize(dealt.drop("_null"), "ranges")
        counts = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())  # a row a range
    else:
        dealt, counts = sizes.withColumn("_part", F.lit(0)), [(0, 0)]
    starts = zip([p for p, _ in counts], accumulate((n for _, n in counts), initial=0), strict=False)
    begin = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(name.asc_nulls_last())) - 1
    return dealt.withColumn("rank", F.try_element_at(begin, F.col("_part")) + place).drop("_part")


def level_of(sources: DataFrame, share: float = SHARE, most: int = MOST) -> float:
    """``(source_size, weight, bound)`` -> the words per unit of weight at which the targets add up to ``share`` of all.

    Beginning with no source full, each round adds up the sources that the last level fills and those it
    does not; what the full ones cannot take raises the level of the rest, until no further one is full.
    """
    level, full = None, -1
    while True:
        is_full = F.lit(False) if level is None else F.col("bound") <= F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("all"), F.max("bound").alias("top"), F.count_if(is_full).alias("full"),
            F.sum(F.when(is_full, most * F.col("source_size"))).alias("caps"), F.sum(F.when(~is_full, F.col("weight"))).alias("open"),
        ).head()
        if row["full"] == full or row["all"] is None:
            return level or 0.0
        if row["open"] is None:
            return row["top"]
        level, full = (share * row["all"] - (row["caps"] or 0)) / row["open"], row["full"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size)`` -> the same with ``target`` and ``rate``.

    All sources share ``share`` of the words by weight, each stopped at ``most`` times its size. A source
    without words has target and rate 0.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double")
    sources = materialize(ranked(sizes).withColumn("weight", weight).withColumn("bound", most * F.col("source_size") / F.col("weight")), "sources")
    target = F.least(most * F.col("source_size").cast("double"), F.lit(level_of(sources, share, most)) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def chance(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the key; 52 bits of an md5, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan(sized: DataFrame, source: str = "source") -> DataFrame:
    """Rows with ``_size`` -> the source table with its targets: one small row per source, in the shared folder."""
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum("_size").alias("source_size"))
    return targets(materialize(sizes, "sizes")).select(F.col("source").alias("_source"), "source_size", "target", "rate")


def draw(sized: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Add source_size, target and copies to every row with a ``_size``. The source table is joined
    back on its name, null included; rows that repeat a key get the same number of copies."""
    made = plan(sized, source)
    copies = F.floor("rate").cast("int") + (chance(F.col(key)) < F.col("rate") - F.floor("rate")).cast("int")
    return sized.join(made, F.col(source).eqNullSafe(F.col("_source")), "left").withColumn("copies", copies)


def emit(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as drawn. Words are counted once; the texts
    are read again to be emitted and are never shuffled, as only the source table is joined. Null texts have
    no words and are emitted as their source's rate says; a null source is a source; an empty table stays empty."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("_src"), size_of(F.col(text)).alias("_size"))
    out = draw(row, "_key", "_src").where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("_row.*")


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it. A null
    text has no words, a null source is a source, rows that repeat a key are drawn alike; an empty table gives an
    empty one. Other columns of ``docs`` are left out."""
    sized = materialize(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("_size")), "sizes")
    return draw(sized).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"))
