"""A training corpus from ``documents``: five stages, each over all rows that the one before it kept.

1. quality rules: documents that break a rule go;
2. near-duplicates: of each group of near copies one document stays;
3. secret scans: secrets are replaced in the texts, no document goes;
4. mixing: sources are brought to their target weights, documents repeated or cut where a budget ends;
5. packing: what is left is tokenised and packed into sequences.

Every stage's result is written below ``spark.checkpoint.dir`` and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifold.llm import minhash_forest, mixing, packing, quality_rules, secret_scan
from motifold.llm.work import documents, stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_forest.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenising and near-duplicate components have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
