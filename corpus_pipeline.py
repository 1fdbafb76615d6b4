"""From raw documents to token ids: language, exact and near duplicates, source weights, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from habitscope.llm import stages
from habitscope.llm.common import table, written

STAGES = [
    ("language ID", stages.identify_language),
    ("exact dedup", stages.drop_exact),
    ("MinHash near-dedup", stages.drop_near),
    ("mixing sources", stages.mix_sources),
    ("BPE encoding", stages.encode),
]

# A trained classifier, signatures and a tokenizer have no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage gives is written, and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage {name}".replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
