"""Registered queries: what each computes on Spark, and the SQL that gives the same rows.

Most are written in the dialect and run through a connection whose tables are the Parquet tables of a folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def names_in(text: str) -> list[str]:
    import re

    words = set(re.findall(r"\w+", text.lower()))
    return [t for t in TABLES if t in words]


def connect(spark: SparkSession, sf_dir: str, *names: str):
    from tidemill.store.connection import Database

    return Database(spark).attach_parquet(sf_dir, *names).connect()


def dialect(name: str, text: str, sql: str | None = "same", params: tuple = (), views: tuple[str, ...] = ()) -> None:
    """Register a query in the dialect; ``sql`` is the oracle, by default the text itself. ``views`` are queries named v1, v2 and so on."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = connect(spark, sf_dir, *names_in(" ".join((text, *views))))
        for i, v in enumerate(views, 1):
            c.db.attach(f"v{i}", c.sql(v))
        return c.sql(text, params)

    QUERIES[name] = Query(run, text if sql == "same" else sql)


def plan(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = Query(run, sql)


def _load() -> None:
    from tidemill.plans import extensions, functions, relational, statements, storage, vectors

    for module in (relational, functions, vectors, storage, statements, extensions):
        module.register()


_load()
