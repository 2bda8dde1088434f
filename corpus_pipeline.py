"""The corpus pipeline: five operators one after the other, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import decontamination, ngram_join, quality_model, secret_scan, source_mixing
from scriptloom.llm.scratch import cleared, table

#: Least score of a document that stays.
QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labelled ones, doesn't reject."""
    network = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_model.score_column(spark, F.col("text").cast("string"), network) >= QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    return ngram_join.deduplicated(docs, k=5, num=8, den=10)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets masked."""
    text = secret_scan.masked(F.col("text").cast("string"))
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order in which a training run takes the documents: a row for each time one is taken."""
    return source_mixing.mixed(docs, source_mixing.Target())


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_copies),
    ("decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
]

#: SQL can't express the trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; what each returns is written to the shared folder.

    What a stage but the last wrote on its way is deleted once its result is
    written.  Null texts, ties and repeated rows go by each stage's operator; an
    empty table gives no rows; other columns stay up to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with cleared(spark):
            docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
