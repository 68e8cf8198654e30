"""Keep costly expressions from being repeated by the optimiser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    A later filter on a plain projected column is pushed below the projection with the expression copied into
    it; with parses and patterns nested in each other the copies outgrow generated code. Filters do not pass a
    generator's own output, so each expression here is evaluated once per row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
