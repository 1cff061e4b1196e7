"""Documents through the stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import op04_simhash, op06_decontam, op08_toxicity, op09_bpe, op10_pii
from pathloom.llm.common import materialize

STAGES = [
    ("toxicity", op08_toxicity.stage),
    ("near_dedup", op04_simhash.stage),
    ("decontamination", op06_decontam.stage),
    ("pii", op10_pii.stage),
    ("bpe", op09_bpe.stage),
]
#: Training, Viterbi decoding and BPE are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
