"""The corpus pipeline: stages over documents, each one's rows written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.bpe import encode_stage
from riskloom.llm.common import table
from riskloom.llm.decontam import decontamination_stage
from riskloom.llm.quality import quality_stage
from riskloom.llm.simhash import near_duplicate_stage
from riskloom.llm.toxicity import toxicity_stage
from riskloom.sources.storage import materialise

STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("byte_pair_encoding", encode_stage),
]

#: Neither the models' decisions nor the merges can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
