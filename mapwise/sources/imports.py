"""CSV imports: outcome lists and labelled pairs.

These files are written by hand and small; fields may hold quoted line breaks and doubled quotes, so each file is
read by one task, and many files by many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mapwise.plans.numbering import number_rows

_OUTCOME_SCHEMA = "outcome string, short_phrase string"
_QUOTED = {"header": True, "multiLine": True, "escape": '"'}


def import_outcomes(
    spark: SparkSession, path: str, owners: DataFrame, file_key: str = r"([^/]+)/[^/]+$", max_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rejects) of all two-column files below ``path``.

    The header row is skipped and rows without an outcome are dropped. ``owners`` maps ``file_key`` (what the
    pattern finds in the file path) to the course, or to program and category for one file per sheet; its columns
    come with each outcome. Outcomes of files without an owner are rejected with their file key.

    ``max_rows`` reads no more than that many rows of each file, the header and rows without an outcome counted (30 takes
    29 data rows); None reads all. A row holding line breaks is one row, wholly blank lines are none.
    """
    rows = spark.read.options(**_QUOTED).schema(_OUTCOME_SCHEMA).csv(path, enforceSchema=True).select(
        "*", F.col("_metadata.file_path").alias("_file"))
    if max_rows is not None:
        # A file is one task's, so its rows have rising numbers.
        in_file = Window.partitionBy("_file").orderBy("_at")
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(in_file))
        rows = rows.filter(F.col("_n") < max_rows)
    rows = (
        rows.filter(F.length(F.trim("outcome")) > 0)
        .select(F.regexp_extract(F.url_decode("_file"), file_key, 1).alias("file_key"), "outcome", "short_phrase")
    )
    owned = rows.join(owners, "file_key").select(
        *[c for c in owners.columns if c != "file_key"], "outcome", "short_phrase"
    )
    return owned, rows.join(owners, "file_key", "left_anti")


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs in latin-1 with a 1-based id in file order.

    The text columns are found by 'learning objective' and 'saf' in the header, whatever their full names.
    """
    raw = spark.read.options(**_QUOTED).option("encoding", "ISO-8859-1").csv(path)

    def holding(part: str) -> str:
        return next(c for c in raw.columns if part in c.lower())

    named = raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"),
    ).withColumnRenamed(holding("learning objective"), "clo").withColumnRenamed(holding("saf"), "accreditation_standard")
    # A file is one task's, so its rows have rising numbers.
    numbered = number_rows(named, [], [F.col("_at")], F.col("_file"), "id")
    return numbered.select(
        "id", "clo", "accreditation_standard", F.col("Score").cast("long").alias("score"),
        F.col("I").alias("i_label"), F.col("R").alias("r_label"), F.col("E").alias("e_label"),
    )
