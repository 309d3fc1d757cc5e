"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents (the
last: packed pieces). The caller writes and rereads each result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import dropped, scratch, stored, table
from lectern.llm.jaccard import near_stage
from lectern.llm.lines import line_stage
from lectern.llm.mixing import mix_stage
from lectern.llm.packing import pack_stage
from lectern.llm.quality import rule_stage

STAGES = [
    ("quality rules", rule_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("mix to targets", mix_stage),
    ("pack", pack_stage),
]
#: Tokenisation and fitted cutoffs are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written once; what it was made from goes then."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch() as kept:
            made = stored(stage(spark, docs, sf_dir))
            kept.append(made)
        if k:
            dropped(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
