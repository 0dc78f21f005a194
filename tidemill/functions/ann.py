"""Approximate nearest neighbours: an inverted file over k-means cells, whose recall is a matter of probes.

Exact search is the default everywhere; this is for tables where a scan of all vectors for each query is too much.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells, and those that a search probes: enough for a recall of 0.9 at 10 neighbours on vectors without clusters. See the README for figures.
CELLS, PROBES = 64, 40
#: Vectors that the cells are fitted on at most; all are indexed.
MOST_FITTED = 50_000
#: Queries that go through the cells together.
BLOCK = 1024


def _cells(x: np.ndarray, n: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        for k in range(len(centres)):
            if (own == k).any():
                centres[k] = x[own == k].mean(0)
    return centres


def fit_cells(df: DataFrame, column: str, metric: str, by: list[str], cells: int = CELLS, most_fitted: int = MOST_FITTED) -> np.ndarray:
    """Centres of the ``most_fitted`` rows with the smallest hash of ``by``; none for a table without vectors."""
    full = df.where(F.col(column).isNotNull())
    sample = full.orderBy(F.xxhash64(*by), *by).limit(most_fitted).select(column).toPandas()[column]
    x = np.array([list(v) for v in sample], float)
    if metric == "cosine" and len(x):
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    return _cells(x, cells) if len(x) else np.zeros((0, 0))


def cell_of(column: str, centres: np.ndarray, metric: str) -> Column:
    """The cell of a vector: that of the nearest centre."""
    unit = metric == "cosine"

    @F.arrow_udf("int")
    def cell(v):
        import pyarrow as pa

        flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(float)
        if unit:
            flat = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-30)
        return pa.array(np.argmax(flat @ centres.T - 0.5 * (centres**2).sum(1), axis=1).astype(np.int32))

    return cell(column)


def probed(centres: np.ndarray, metric: str, query: list[float], probes: int) -> list[int]:
    q, c = np.asarray(query, float), centres
    if not len(c):
        return []
    far = -(c @ q) if metric == "ip" else ((c - q) ** 2).sum(1) if metric == "l2" else 1 - (c @ q) / np.maximum(np.linalg.norm(c, axis=1) * np.linalg.norm(q), 1e-30)
    return [int(i) for i in np.argsort(far)[:probes]]


def search_cells(rows: DataFrame, column: str, centres: np.ndarray, metric: str, queries: list[tuple[Any, list[float]]], k: int, probes: int, ties: list[str]) -> DataFrame:
    """``rows`` without ``column`` and ``__cell`` but with (query, distance): for each of ``queries`` (id, vector) the ``k`` nearest of the rows in
    its ``probes`` nearest cells, by distance and ``ties``. A null ``__cell`` stands for rows that have none yet; every query meets those.

    A block of queries meets the rows on the cell: (query, cell) pairs are at most ``BLOCK * probes``, and each task keeps
    ``k`` rows of a query before they meet. Cells that no query of a block probes aren't read where rows were written by cell.
    """
    from tidemill.functions.vectors import distance

    spark, out = rows.sparkSession, None
    kept = [c for c in rows.columns if c not in (column, "__cell")]
    kind = "long" if not queries or isinstance(queries[0][0], int) else "string"
    for at in range(0, max(1, len(queries)), BLOCK):
        asked = [(i, [float(x) for x in v], c) for i, v in queries[at : at + BLOCK] for c in [-1, *probed(centres, metric, v, probes)]]
        met = spark.createDataFrame(asked, f"query {kind}, __q array<float>, __probe int")
        cells = sorted({c for _, _, c in asked})
        near = rows.where(F.col("__cell").isNull() | F.col("__cell").isin(cells)).withColumn("__at", F.coalesce("__cell", F.lit(-1)))
        found = near.join(F.broadcast(met), F.col("__at") == F.col("__probe")).withColumn("distance", F.expr(distance(metric, f"`{column}`", "__q")))
        nearest = Window.partitionBy("query").orderBy("distance", *ties)
        found = found.withColumn("__n", F.row_number().over(nearest)).where(F.col("__n") <= k).select("query", *kept, "distance")
        out = found if out is None else out.unionByName(found)
    return out


@dataclass
class VectorIndex:
    """Rows with their cell. ``centres`` is small: its size is a parameter."""

    rows: DataFrame
    key: str
    column: str
    centres: np.ndarray
    metric: str

    def search(self, query: list[float], k: int, probes: int = PROBES) -> DataFrame:
        """(key, distance) of the ``k`` nearest in the ``probes`` nearest cells; ties by key."""
        return self.search_all([(0, query)], k, probes).drop("query").orderBy("distance", self.key)

    def search_all(self, queries: list[tuple[Any, list[float]]], k: int, probes: int = PROBES) -> DataFrame:
        """(query, key, distance) for many queries (id, vector) at once."""
        rows = self.rows.select(self.key, self.column, "__cell")
        return search_cells(rows, self.column, self.centres, self.metric, queries, k, probes, [self.key])


def build_index(df: DataFrame, key: str, column: str, metric: str = "l2", cells: int = CELLS, most_fitted: int = MOST_FITTED) -> VectorIndex:
    """Index every row of ``df`` for as long as it is used; rows without a vector are left out. ``store/vector_index.py`` keeps one."""
    centres = fit_cells(df, column, metric, [key], cells, most_fitted)
    return VectorIndex(df.where(F.col(column).isNotNull()).withColumn("__cell", cell_of(column, centres, metric)), key, column, centres, metric)
