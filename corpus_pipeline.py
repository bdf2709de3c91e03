"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import minhash, mixing, packing, pii, toxicity
from frameloom.llm.common import free, stage, table

STAGES = [
    ("toxicity", toxicity.stage_toxicity),
    ("near_duplicates", minhash.stage_near_duplicates),
    ("personal_data", pii.stage_pii),
    ("mix", mixing.stage_mix),
    ("pack", packing.stage_pack),
]
#: Training, near duplicates and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        free(before)  # the table of the stage before; the input itself is not a staged one
    return STAGES[-1][1](spark, docs, sf_dir)
