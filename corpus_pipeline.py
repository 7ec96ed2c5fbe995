"""Corpus preparation: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; :func:`run` writes each result to the
shared folder and gives it, read again, to the next stage; what a stage wrote besides is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontam import decontamination_stage
from tessera.llm.minhash import minhash_stage
from tessera.llm.mixing import mixing_stage
from tessera.llm.quality import quality_stage
from tessera.llm.sharding import shard_stage
from tessera.llm.store import forget, scratch, stage, table

STAGES = [
    ("quality rules", quality_stage),
    ("minhash near-dedup", minhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", shard_stage),
]

#: MinHash, the fitted classifier and the rates are beyond SQL; tests/llm/test_pipeline.py checks by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, apply in STAGES:
        with scratch(spark) as made:  # only the stage's result outlives it
            docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
            result = made.pop()
        if before:
            forget(spark, before)
        before = result
    return docs
