"""The corpus pipeline: from raw documents to packed sequences, one operator a stage.

Each stage is written as Parquet to the shared folder and read back as the next one's documents, so a lost executor
costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import cotraining, cube_mixing, cutting_stock, hyperminhash, quality_rules
from parlance.llm.common import Stash, table

STAGES = [
    ("quality rules", quality_rules.stage),
    ("quality classifier", cotraining.stage),
    ("near-duplicates", hyperminhash.stage),
    ("mixing", cube_mixing.stage),
    ("packing", cutting_stock.stage),
]
#: Trained models, hashed choices and a linear program: SQL can't express the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    stash = Stash(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stash.put(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            stash.drop(f"stage-{i - 1}")
    return docs
