"""A corpus pipeline of five stages over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import scratch
from shelfmark.llm.contamination import decontaminate_stage
from shelfmark.llm.minhash import dedup_stage
from shelfmark.llm.mixing import mix_stage
from shelfmark.llm.sharding import shard_stage
from shelfmark.llm.tables import read
from shelfmark.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("benchmark_leaks", decontaminate_stage),
    ("mix_sources", mix_stage),
    ("shards", shard_stage),
]
ORACLE_SQL = None  # the classifier and the searches aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written, and read again as the next one's documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
