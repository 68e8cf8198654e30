"""Continuous ingest of model answers into the suggestion table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mapwise.operators.requests import RESULT_COLUMNS, process_results
from mapwise.streaming import log

KEYS, ORDER = ["clo_id", "plo_id"], ["file_time", "file_path"]
SCHEMA = (
    "clo_id string, plo_id string, clo string, accreditation_standard string, is_mapped boolean, "
    "explanation string, map_labels array<string>, file_time timestamp, file_path string"
)


def _latest_per_pair(batch: DataFrame) -> DataFrame:
    """One answer per pair: the one in the newest file, by path where times are equal."""
    values = [c for c in RESULT_COLUMNS if c not in KEYS]
    newest = F.max(F.struct(*ORDER, F.struct(*values).alias("v"))).alias("last")
    return batch.groupBy(*KEYS).agg(newest).select(*KEYS, "last.v.*", *[f"last.{c}" for c in ORDER])


def stream_results(spark: SparkSession, source: str, target: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Parse new answer files below ``source`` and replace the suggestions of their pairs in ``target``.

    Parsing is stateless; a pair answered again replaces its former answer, so replays change nothing, and a file
    that is listed late replaces only what is older than itself. Every file is read once, whatever its age; Spark's
    list of the files seen grows by one line per file until they are moved away.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", log.MAX_FILE_AGE).text(source)
        .select(F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("file_time"),
                F.col("_metadata.file_path").alias("file_path"))
    )
    results, _ = process_results(lines)
    return log.start(results, target, "append", _latest_per_pair)


def suggestions(spark: SparkSession, target: str) -> DataFrame:
    """The suggestion table as of now."""
    return log.current(spark, target, SCHEMA, KEYS, ORDER).drop(*ORDER)


def take_snapshot(spark: SparkSession, target: str) -> int | None:
    """Fold the suggestions so far, which bounds what later reads open."""
    return log.take_snapshot(spark, target, SCHEMA, KEYS, ORDER)
