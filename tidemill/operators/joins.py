"""Joins whose plans need care."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if a bounded count finds no more rows than this.
MOST_BROADCAST_ROWS = 200_000


def small_enough(df: DataFrame, most_rows: int = MOST_BROADCAST_ROWS) -> bool:
    """Whether ``df`` has ``most_rows`` rows at most, reading no more than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """An equi-join whose hot keys are split: each row of ``left`` draws one of ``salts`` by its content, each of ``right`` is there for all.

    For inner, left, left_semi and left_anti joins: others would emit unmatched rows of ``right`` several times.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} can't be salted on its left side")
    one = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    every = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return one.join(every, [*on, "__salt"], how).drop("__salt")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``left`` and ``right`` with ``low <= point <= high``, as an equi-join on buckets of ``width`` instead of a nested loop.

    Each row of ``right`` is there once for each bucket it spans, so ``width`` should be about the usual span. Rows with a null bound or point match nothing.
    """
    bucket: Column = F.floor(F.col(point) / width)
    spans = F.when(F.col(low) <= F.col(high), F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    dealt = right.withColumn("__bucket", F.explode(spans))
    joined = left.withColumn("__bucket", bucket).join(dealt, "__bucket")
    return joined.where(F.col(point).between(F.col(low), F.col(high))).drop("__bucket")
