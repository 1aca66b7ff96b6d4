"""The corpus pipeline: drop poor and toxic documents, near-duplicates and benchmark leaks, mix the sources, deal out shards.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. The last returns the corpus:
the mixed rows with their texts, a shard and a slot each. A row is there once for each pass of the mix over its source, and a source's last
document may be cut to the words that were still asked for, so rows go by shard and slot, not by ``doc_id``.

Null, empty and blank texts go with the first stage, so no later one meets them in a run; by themselves all stages take them. Null ids, sources and
languages are kept as such. Rows that repeat an id and a text become one in the second stage. Of linked documents the one of the smallest id stays, null ids last.
Without labels only blank texts go, without a benchmark nothing leaks, and an empty table gives an empty corpus. Extra columns of the documents are
carried through all stages, whatever their names, but for ``shard`` and ``slot``, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, minhash, mixing, quality, sharding
from quillon.llm.common import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs)


STAGES = [
    ("quality classifier", classify),
    ("minhash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

#: The classifier is trained and signatures are hashed, which SQL does not express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
