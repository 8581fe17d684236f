"""Training-corpus pipeline: each stage's rows are written as Parquet and read again by the next.

The last stage turns texts into pieces for training: its rows are doc_id, log_prob, log_inclusion and pieces of the first
sampled segmentation, the other samples, and whether all decode to the text; so lang, source and text end there. All stages
before it return the columns of documents.

Defined cases: null and empty texts are harmless, classes of their own, lose nothing, hold no benchmark window and have no
pieces; rows that repeat doc_id and text are one document, of which near-dedup keeps one row; rows without doc_id are kept
apart by their texts; a text that consists of repeats goes on as an empty one; an empty table gives an empty result;
columns of any other name go through all stages but the last unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import chunk_dedup, decontamination, minhash_dedup, pieces, toxicity
from tidewright.llm.common import shared_folder, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("near-dedup", minhash_dedup.stage),
    ("substring-dedup", chunk_dedup.stage),
    ("decontamination", decontamination.stage),
    ("sentencepiece", pieces.stage),
]

#: Fitting, hashing and sampling have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents. What a stage keeps is written to the folder in spark.checkpoint.dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
