"""JSON-lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mapwise.functions import answers
from mapwise.operators.requests import prompt_payload


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) lines below ``path``; blank lines are dropped, malformed ones are kept apart."""
    lines = spark.read.text(path).select(answers.strip(F.col("value")).alias("line")).filter(F.length("line") > 0)
    valid = F.try_parse_json("line").isNotNull()
    return lines.filter(valid), lines.filter(~valid)


def write_prompts(prompts: DataFrame, path: str, pairs_per_file: int = 100_000, compression: str = "gzip") -> None:
    """One JSON line per pair, text unescaped, in files of at most ``pairs_per_file`` lines.

    Every line holds the whole template, so the files are compressed unless ``compression`` is none; Spark and the batch
    service (``CompressionType``) read them as they are.

    The tasks that build the prompts write them as they are: no exchange, no fixed number of files, and no file per
    request. The pair id in each line says where its answer belongs.
    """
    lines = prompt_payload(prompts).select("value")
    lines.write.mode("overwrite").option("maxRecordsPerFile", pairs_per_file).option("compression", compression).text(path)
