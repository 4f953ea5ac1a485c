"""A training-data pipeline over the ``documents`` table.

Each stage takes what its predecessor kept and returns rows with the columns of documents,
but for the last, which returns the packed pieces. Between stages the rows are written as
Parquet to the shared folder and read again.

1. quality rules: documents that a base rule or a rule enforced in their source rejects go;
2. SimHash near-duplicates: of each group the document with the smallest id stays;
3. secret scans: every secret is replaced by a mark, all documents stay;
4. mixing: each document is emitted as often as its source's rate and its draw say;
5. best-fit packing into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import mixing, packing, quality_rules, secrets, simhash
from strata.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Fingerprints and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
