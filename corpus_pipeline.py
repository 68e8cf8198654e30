"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mapwise.llm import decontamination, mixing, near_duplicates, quality, token_files
from mapwise.llm.queries import TOKENIZER
from mapwise.llm.storage import stored
from mapwise.plans.session import shared_dir


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (row), which is stored, so that Spark chooses the join by its size."""
    keyed = docs.withColumn("_row", near_duplicates.row_key())
    return keyed.join(gone.withColumnRenamed("row", "_gone"), F.col("_row") == F.col("_gone"), "left_anti").drop("_row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good; it learns from the labelled rows that are not held out."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, the one with the smallest id.

    Of rows with that id one is kept; a group of rows with null ids keeps one of them. Rows without words all stay.
    """
    found = stored(near_duplicates.grouped(docs, words=5, percent=80).filter("n_shingles > 0"), "pipeline-grouped")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    best = found.groupBy("component").agg(first.alias("best"))
    gone = stored(found.join(best, "component").filter("row != best").select("row").distinct(), "pipeline-duplicates")
    again = found.groupBy("row").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("row")
    again = stored(again.join(gone, "row", "left_anti"), "pipeline-repeated")
    # Of equal rows that stay, which are few if any, one is taken.
    keyed = docs.withColumn("_row", near_duplicates.row_key())
    one = keyed.join(again.withColumnRenamed("row", "_again"), F.col("_row") == F.col("_again"), "left_semi")
    return _without(docs, gone.union(again)).unionByName(one.dropDuplicates(["_row"]).drop("_row"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = docs.select(near_duplicates.row_key().alias("doc_id"), "text")
    found = decontamination.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, stored(found.select(F.col("doc_id").alias("row")).distinct(), "pipeline-contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and per document what is read back from them."""
    folder = shared_dir(spark, "pipeline-tokens")
    token_files.write_tokens(docs, folder, TOKENIZER)
    return token_files.read_tokens(spark, folder)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("tokens", tokenize),
]
#: The classifier's score is not an SQL expression; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
