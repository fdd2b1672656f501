"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage is one corpus operator and works on all that its predecessor kept.  Between
stages the documents are written as Parquet to the shared folder and read again, so a
lost executor costs at most the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrel.llm.common import materialize, table
from spindrel.llm.language import language_stage
from spindrel.llm.mixing import mix_stage
from spindrel.llm.neardup import near_duplicate_stage
from spindrel.llm.packing import pack_stage
from spindrel.llm.pii import pii_stage

STAGES = [
    ("language identification", language_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("pii surrogates", pii_stage),
    ("source mixing", mix_stage),
    ("sequence packing", pack_stage),
]

#: Language identification and near-duplicate components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
