"""Shared pieces: the shared scratch folder, table reading and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import scratch
from strata.functions.codec import let  # noqa: F401  used by the operators

#: A word is a run of characters other than these.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


scratch_path, remove_path = scratch.path, scratch.remove


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost
    executors cost no recomputation beyond their own tasks. The table's size is then known
    to the planner, which broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strata_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    remove_path(df.sparkSession, df._strata_path)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")
