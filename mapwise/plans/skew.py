"""Joins whose output fans out within a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_SALT = "_salt"


def fan_out_join(
    many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Equi-join in which one key may meet a large share of ``many`` and each of its rows many of ``few``.

    Adaptive skew handling looks at input bytes, so a key with little input and a huge output would stay
    in one task. Here the rows of ``many`` are spread over ``salts`` buckets by a hash of the whole row
    (stable when a task is re-run) and every row of ``few`` is offered once per bucket. Both sides are
    exchanged: sizes are estimated without the copies, so a broadcast would bring them all to the driver.
    ``how`` may be inner or left: both keep each row of ``many`` in exactly one bucket.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if salts is None:
        salts = int(many.sparkSession.conf.get("spark.mapwise.salts", "8"))
    left = many.withColumn(_SALT, F.pmod(F.xxhash64(*many.columns), F.lit(salts)).cast("int"))
    right = few.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*keys, _SALT], how).drop(_SALT)
