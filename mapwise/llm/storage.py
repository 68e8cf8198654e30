"""Written intermediates of the operators, in the shared folder that the session names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mapwise.plans.session import shared_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read again.

    Later steps start from the files: a lost executor costs its own tasks, not the steps before.
    """
    folder = shared_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
