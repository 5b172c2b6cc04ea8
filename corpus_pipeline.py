"""A corpus pipeline of operators from ``driftmark.llm``; each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftmark.llm import stages
from driftmark.sources.scratch import materialize
from driftmark.sources.tables import read_table

STAGES = [
    ("language ID", stages.identified),
    ("n-gram Jaccard join", stages.deduplicated),
    ("secret scans", stages.masked),
    ("mixing sources to target weights", stages.mixed),
    ("byte-level BPE encoding and decoding", stages.encoded),
]

#: No SQL can express the language model and the byte-pair merges; tests/llm checks every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
