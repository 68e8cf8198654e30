"""Session settings every job relies on, and the shared folder for written intermediates."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes of the tables' files for each partition that an exchange starts from.
BYTES_TO_START = 4 << 20

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join keys at run time, also where that costs an extra exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Merged partitions are measured compressed; rows of keys take up to 40 times that in a sort or an aggregate. The number
    # to start from is the least; ``start_from`` raises it by the bytes of the tables.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    _START: "200",
    # A task holds what it reads until it is exchanged.
    "spark.sql.files.maxPartitionBytes": "8m",
    # Files of short columns take a twentieth of their rows; a table is broadcast by the size of its rows.
    "spark.sql.sources.fileCompressionFactor": "20",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings. Broadcasts stay under Spark's own size threshold: no job hints one."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at ``path``, as their listing gives them; none is read."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def start_from(spark: SparkSession, n_bytes: int) -> None:
    """Let exchanges start from partitions enough for tables of ``n_bytes``; adaptive execution merges small ones only."""
    if math.ceil(n_bytes / BYTES_TO_START) > int(spark.conf.get(_START)):
        spark.conf.set(_START, str(math.ceil(n_bytes / BYTES_TO_START)))


_local_root: str | None = None


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting falls back to a temporary folder of its own.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="mapwise-")
        root = _local_root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder once, for several consumers; its partitioning is kept.

    Consumers find the rows again after an executor is lost without running the steps before. The step itself
    runs without adaptive re-planning, whose coalesced partitions consumers could not rely on.
    """
    conf = df.sparkSession.conf
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once and read again, for several consumers of a table whose plan is long.

    Unlike ``kept`` it is planned adaptively, so its tasks stay small however large the table is; no partitioning is kept.
    """
    path = shared_dir(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
