"""Writing report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_reports(reports: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each report below ``<path>/<name>`` as parquet or csv with header."""
    for name, df in reports.items():
        writer = df.write.mode("overwrite")
        if form == "csv":
            writer.option("header", True).csv(f"{path}/{name}")
        else:
            writer.parquet(f"{path}/{name}")


def wide_sheet(report: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Wide view of one program or course; the column list is given, so nothing is scanned to find it."""
    from pyspark.sql import functions as F

    return report.groupBy(row).pivot(column, columns).agg(F.max(value))
