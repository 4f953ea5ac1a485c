"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, materialize

#: The rows of a hub are spread over so many keys before they meet its minimum.
SALTS = 16


def with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Join the per-node minimum to the links of the node, salted so that a hub with a large
    share of all links spreads over SALTS tasks (and can be split further at run time)."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # never broadcast: the planner would judge the copies by the size of what they are made from
    return salted.join(copies.hint("merge"), ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = with_least(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.xxhash64("u", "v") % F.lit(1 << 31)).cast("decimal(38,0)")).alias("s"),
    ).head()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` long, any direction, repeats and loops allowed -> ``(node, component)``.

    A node's component is the smallest node it reaches. Only nodes with a link to another
    node other than the component itself are returned; every other node is its own component.
    Nothing but two numbers a round reaches the driver. The number of rounds grows with the
    logarithm of the longest chain.
    """
    start = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(start, "edges")
    state = _state(now)
    while state[0]:
        after = materialize(_small_star(_large_star(now)), "edges")
        reached = _state(after)
        discard(now)
        now, before, state = after, state, reached
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
