"""A corpus from raw documents to packed windows: quality, exact and near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents.

Defined cases are those of the operators. In short: NULL and blank texts go at the quality stage; rows equal in doc_id and text are one document from
the exact stage on; texts of any length are worked on whole; columns that documents has besides, whatever their names, are carried to the
mixing stage and end there; empty documents give no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from idloom.llm import exact_dedup, mixing, packing, quality, simhash
from idloom.llm.common import clear, mark, table, written

STAGES = [
    ("quality", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash", simhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't express the classifier's training, fingerprints of words, or packing; tests/llm holds run(), stage by stage, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed windows of the table ``documents``. What a stage and the one before it have written is deleted once its result is."""
    docs = table(spark, sf_dir, "documents")
    start = mark()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            clear(spark, start, docs)
    return docs
