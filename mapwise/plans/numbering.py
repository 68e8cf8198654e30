"""Consecutive numbers within a key, without sorting one key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def number_rows(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Add the 1-based position ``name`` of each row within ``keys`` by ``order``.

    ``bucket`` must not decrease along ``order``; nulls of keys, bucket and order come first and are values like
    others. Rows are sorted only within (keys, bucket); a running sum over the bucket counts, which is all that
    ever meets in one task per key, gives each bucket its offset. With empty ``keys`` the numbering is global.
    """
    # A struct equals another with nulls at the same places, so the join back keeps every row.
    tagged = df.withColumn("_key", F.struct(*keys, bucket.alias("_bucket")))
    counts = tagged.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    scope = [f"_key.{k}" for k in keys] or ["_all"]
    before = Window.partitionBy(*scope).orderBy("_key._bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_key").orderBy(*order)
    return (
        tagged.join(offsets, "_key")
        .withColumn(name, (F.col("_offset") + F.row_number().over(within)).cast("long"))
        .select(*df.columns, name)
    )
