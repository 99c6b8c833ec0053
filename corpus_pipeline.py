"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.

Defined results, for every stage: an empty table gives an empty one; repeated rows get the same result
each; other columns, whatever their names, pass unchanged; long texts are worked on whole. What null and
empty texts and ids get is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, neardup, packing, pii, quality
from loomline.llm.shared import Tables


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns as op4 does. Null and empty texts are scored as one empty line and stay or go together."""
    return quality.good(docs, quality.trained(spark, sf_dir))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays (five-word shingles, similarity 0.8). Rows that share an id stay or go together; rows without an id stay, as do null and empty texts, which are like nothing."""
    return neardup.without_copies(docs)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; null and empty texts have none and stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars, if there is one, follows. Null and empty texts stay as they are."""
    hidden = pii.hide(docs)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.length("text").cast("long"))
    return hidden.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; a null or empty text is one piece of the closing id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("benchmarks", no_benchmarks),
    ("personal_data", no_personal_data),
    ("packing", packed),
]

#: SQL has no CRF and no bin completion; tests/llm/test_pipeline.py holds every stage, and all in a row, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    tables = Tables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.put(docs)
    return docs
