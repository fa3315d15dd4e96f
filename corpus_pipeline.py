"""The corpus pipeline: four operators of ``showerloom.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a stage's rows as
Parquet in the shared folder and reads them again as the next one's docs.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from showerloom.llm.common import table, use_checkpoints
from showerloom.llm.minhash_dedup import dedup_stage
from showerloom.llm.mixing import mixing_stage
from showerloom.llm.quality_crf import quality_stage
from showerloom.llm.sentencepiece_lattice import encode_stage

STAGES = [
    ("quality_crf", quality_stage),
    ("minhash_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encode_stage),
]

#: the classifier is trained, which SQL can't express; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    use_checkpoints(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return docs
