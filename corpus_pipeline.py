"""From raw documents to encoded training text: rules, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
stage's docs. All but the last return the columns of documents.

Edge cases: documents without text or with fewer than 50 words go with the rules; very long texts are taken whole at every
stage; of repeated rows and copies one stays, and the mix may take it twice; null doc_id, lang or source are values of their
own; an empty table passes through empty; extra columns stay, whatever their names, up to the encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from incipit.llm import bpe, mixing, quality, secrets, simhash
from incipit.scale import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their group's robust scatter go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id) of each group stays; shingles and bits as the contract of op3 has them."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become a mark."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixing.mix(docs, shard_as=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_documents(docs, bpe.default_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Fingerprints by XXH64, covariance steps and merges cannot be expressed in DuckDB SQL; tests/llm/test_pipeline.py holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
