"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of ``docs``; the last one returns
pieces with their sequences. ``run`` writes every stage as Parquet below the shared scratch folder and reads it again.

In all stages null text counts as empty text and very long texts are read whole; repeated rows are rows like others; no rows in give no rows out; columns of other names pass through, also where a
stage's own helper columns have the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoopline.llm import decontaminate, exact_dedup, near_dedup, packing, quality_cnn
from hoopline.llm.common import free_name, read_table, saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``quality_cnn.KEEP``; empty texts are scored too. Without labels of both kinds all have the same score."""
    name = free_name(docs, "quality_score")
    scored = quality_cnn.score(docs, read_table(spark, sf_dir, "labels"), name)
    return scored.filter(F.col(name) >= quality_cnn.KEEP).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id (null is the smallest; of rows equal in both, one); empty texts are one text."""
    return exact_dedup.keep_one_copy(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest doc_id. Empty texts and rows without an id stay."""
    return near_dedup.keep_one_near_copy(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; texts without words stay, an empty benchmark keeps all."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All ids of the documents in sequences; an empty text is one closing id."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
