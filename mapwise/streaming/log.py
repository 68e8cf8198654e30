"""A keyed table kept as an append-only log of micro-batches.

Each batch overwrites its own folder, so a batch that is run again after a failure leaves the same state, and
nothing already stored is rewritten. Readers take the last row per key by the order columns of the rows themselves,
then by batch, so a batch that comes late cannot replace a newer row. A snapshot folds the log so far into one
folder; reads start from the newest finished snapshot and open only later batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

#: A file source forgets files older than this beside the newest one; answers may come late by any time.
MAX_FILE_AGE = "36500d"


def append(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink writing batch ``n`` to ``<path>/batches/batch_id=n``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch_id={batch_id}")

    return write


def start(stream: DataFrame, path: str, mode: str, prepare: Callable[[DataFrame], DataFrame] = lambda b: b) -> StreamingQuery:
    """Run the stream over what is there now; the same path goes on where the last run stopped."""
    sink = append(path)
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).foreachBatch(lambda batch, n: sink(prepare(batch), n)).start()
    )


def _finished(spark: SparkSession, folder: str) -> dict[int, str]:
    """Finished subfolders ``name=number`` of ``folder`` by number; none if the folder is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return {}
    paths = [s.getPath() for s in files.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()]
    done = [p for p in paths if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return {int(p.getName().split("=")[1]): p.toString() for p in done}


def _stored(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int | None]:
    """Rows of the newest snapshot and of the batches after it, and the number of the last batch in them."""
    snapshots, batches = _finished(spark, f"{path}/snapshots"), _finished(spark, f"{path}/batches")
    base = max(snapshots, default=None)
    later = [n for n in batches if base is None or n > base]
    full = f"{schema}, batch_id bigint"
    rows = spark.createDataFrame([], full)
    if base is not None:
        rows = spark.read.schema(full).parquet(snapshots[base])
    if later:
        new = spark.read.option("basePath", f"{path}/batches").schema(full).parquet(*[batches[n] for n in sorted(later)])
        rows = rows.unionByName(new) if base is not None else new
    return rows, max(later, default=base)


def _fold(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key: a maximum over structs, combined before the exchange."""
    values = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*order, "batch_id")).alias("_v")
    return rows.groupBy(*keys).agg(last).select(*keys, "_v.*")


def current(spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str]) -> DataFrame:
    """State of the table; empty before the first batch."""
    rows, _ = _stored(spark, path, schema)
    return _fold(rows, keys, order).drop("batch_id")


def take_snapshot(spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str]) -> int | None:
    """Fold the log into one folder; returns the number of the last batch in it, null if there is nothing yet."""
    rows, upto = _stored(spark, path, schema)
    if upto is not None and upto not in _finished(spark, f"{path}/snapshots"):
        _fold(rows, keys, order).write.mode("overwrite").parquet(f"{path}/snapshots/upto={upto}")
    return upto


def prune(spark: SparkSession, path: str) -> None:
    """Remove the batches and snapshots that the newest snapshot replaces; run it when no older read is under way."""
    snapshots, batches = _finished(spark, f"{path}/snapshots"), _finished(spark, f"{path}/batches")
    newest = max(snapshots, default=None)
    if newest is None:
        return
    old = [p for n, p in snapshots.items() if n < newest] + [p for n, p in batches.items() if n <= newest]
    for name in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
