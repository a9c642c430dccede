"""A corpus pipeline out of five of the operators: each stage works on all that its predecessor kept.

Every stage takes tables with further columns, of any names, and ignores them; an empty table gives an empty one. Equal scores, sizes and similarities are
settled by doc_id, so that a run repeats itself. What nulls, empty texts and repeated rows give is told at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.decontamination import decontaminate
from keystrata.llm.jaccard_join import keep_one
from keystrata.llm.line_dedup import drop_common_lines
from keystrata.llm.quality_resampling import resample
from keystrata.llm.shared import written
from keystrata.llm.source_mixing import mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance resample go.

    Null and empty texts have weight 0 and are judged by it; rows that repeat a doc_id and text go or stay together. Without labelled good documents all stay.
    """
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that ten or more documents have; n_chars follows. No row goes.

    Each row is a document, so repeated rows count each. A null or empty text is one empty line, and empty afterwards.
    """
    return drop_common_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays; of rows that repeat a doc_id and text, one.

    Texts without words are like nothing and stay, as rows without a doc_id do.
    """
    return keep_one(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any benchmark item occurs go, each row judged by itself. Null and empty texts stay; an empty benchmark removes nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered by copy.

    A null source is a source, ranked last. Texts without words share their source's rate; a source without any word goes. Rows that repeat a doc_id share a draw.
    """
    return mix(docs).select(*COLUMNS, "copy")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]
#: The quality classifier's model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
