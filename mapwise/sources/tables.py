"""Load the relational tables with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapwise.schemas import SCHEMAS


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """One DataFrame per domain table stored as ``<folder>/<name>`` in parquet, schema declared, not inferred."""
    return {
        name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
        for name in (names or list(SCHEMAS))
    }


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Store domain tables in the layout ``load_tables`` reads."""
    for name, df in tables.items():
        declared = SCHEMAS[name]
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in declared.fields]).write.mode(
            "overwrite"
        ).parquet(f"{folder}/{name}")
