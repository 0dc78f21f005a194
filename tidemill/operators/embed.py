"""Embedding related rows along a foreign key: one join each, not a query for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_one(base: DataFrame, other: DataFrame, on: dict[str, str], columns: Sequence[str], name: str) -> DataFrame:
    """``base`` with ``name``: the row of ``other`` that it refers to as a JSON object, null without one.

    ``on`` maps columns of ``base`` to the key of ``other``, which must be unique there.
    """
    keyed = other.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on.values())], F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))
    condition = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(on)]
    return base.join(keyed, condition, "left").select(*base.columns, name)


def embed_many(base: DataFrame, other: DataFrame, on: dict[str, str], columns: Sequence[str], name: str, order: Sequence[str] = ()) -> DataFrame:
    """``base`` with ``name``: the rows of ``other`` that refer to it as a JSON array in the order of ``order``; ``[]`` without any.

    A group's array is one value: related rows must be few enough for a row of the result.
    """
    keys = list(on.values())
    rows = F.struct(*order, F.struct(*columns).alias("__row"))
    arrays = other.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.sort_array(F.collect_list(rows)).alias("__rows"))
    text = F.to_json(F.transform("__rows", lambda r: r["__row"]), {"ignoreNullFields": "false"})
    joined = base.join(arrays, [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(on)], "left")
    return joined.select(*base.columns, F.coalesce(text, F.lit("[]")).alias(name))
