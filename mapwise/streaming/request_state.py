"""Current state per (course, program) from a stream of request events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mapwise.schemas import SCHEMAS
from mapwise.streaming import log

KEYS, ORDER = ["course_id", "program_id"], ["created_at", "request_id", "status"]
STATE = "course_id bigint, program_id bigint, request_id bigint, status string, created_at timestamp"


def request_state(events: DataFrame) -> DataFrame:
    """Latest event per key, batch or stream.

    A maximum by event time: duplicates and late events cannot change it, so neither de-duplication nor a
    watermark is needed and the state is one row per key.
    """
    latest = F.max(F.struct("created_at", "request_id", "status")).alias("s")
    return events.groupBy(*KEYS).agg(latest).select(*KEYS, "s.request_id", "s.status", "s.created_at")


def stream_request_state(spark: SparkSession, source: str, target: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Follow request event files below ``source``; each batch logs the keys whose state changed."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    events = (
        spark.readStream.schema(SCHEMAS["mapping_requests"]).option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", log.MAX_FILE_AGE).parquet(source)
    )
    return log.start(request_state(events), target, "update")


def current_state(spark: SparkSession, target: str) -> DataFrame:
    return log.current(spark, target, STATE, KEYS, ORDER)


def take_snapshot(spark: SparkSession, target: str) -> int | None:
    """Fold the states so far, which bounds what later reads open."""
    return log.take_snapshot(spark, target, STATE, KEYS, ORDER)
