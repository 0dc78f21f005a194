"""Vector indexes that are kept beside a table's files.

``<root>/index/<id>/`` holds the centres, fitted once, and parts: Parquet by cell, each beside a list of the table files that it
covers. Table files never change, so a part stays right for ever: rows of files that a version doesn't hold are passed over, and files that
no part covers are scanned. So an index serves every version and branch, and a part that is missing costs time, not rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import ConflictError
from tidemill.functions.ann import CELLS, PROBES, cell_of, fit_cells, search_cells
from tidemill.store.files import Files

#: Parts beyond this are written as one.
MOST_PARTS = 16


def short(path: str) -> str:
    """Folder and name of a file: unique, however its path is spelled."""
    return "/".join(path.split("/")[-2:])


class KeptIndex:
    """The index ``entry`` (of a table's definition) in the database at ``root``."""

    def __init__(self, spark: SparkSession, files: Files, root: str, entry: dict[str, Any]):
        self.spark, self.files, self.entry = spark, files, entry
        self.folder, self.metric = f"{root}/index/{entry['id']}", entry["metric"]

    def centres(self) -> np.ndarray | None:
        path = f"{self.folder}/centres.json"
        return np.array(json.loads(self.files.read(path)), float) if self.files.exists(path) else None

    def parts(self) -> list[tuple[str, list[str]]]:
        """(folder, files that are its own), each file with the first part that covers it."""
        out, seen = [], set()
        for name in self.files.names(f"{self.folder}/lists"):
            if name.endswith(".json"):
                listed = [f for f in json.loads(self.files.read(f"{self.folder}/lists/{name}")) if f not in seen]
                seen.update(listed)
                out.append((f"{self.folder}/parts/{name[:-5]}", listed))
        return out

    @staticmethod
    def placed(rows: DataFrame, column: str, tie: str | None) -> DataFrame:
        """Rows of a table with their places, as the index holds them."""
        own = F.col(tie) if tie else F.lit(0)
        return rows.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), own.alias("tie"), F.regexp_extract("__file", "[^/]+/[^/]+$", 0).alias("file"), F.col("__row").alias("row"))

    def extend(self, rest: Callable[[list[str]], DataFrame], files: list[str]) -> None:
        """Index those of ``files`` that no part covers; ``rest`` gives their ``placed`` rows. The first files that hold a vector fit the centres."""
        covered = {f for _, listed in self.parts() for f in listed}
        files = [f for f in files if short(f) not in covered]
        if not files:
            return
        rows, centres = rest(files), self.centres()
        if centres is None:
            # Chosen by the vectors themselves: equal rows give equal cells, whatever their files are called.
            centres = fit_cells(rows, "v", self.metric, ["v"])
            if not len(centres):
                return
            self.files.make_folder(f"{self.folder}/lists")
            try:
                self.files.create(f"{self.folder}/centres.json", json.dumps(centres.tolist()))
            except ConflictError:
                centres = self.centres()
        self._publish(rows.withColumn("__cell", cell_of("v", centres, self.metric)), [short(f) for f in files])

    def compact(self, live: list[str]) -> None:
        """Where there are many parts, write them as one without rows of files that aren't ``live``. Their data stays as long as the index, for readers
        that began before; other versions and branches scan the files that were left out."""
        parts, alive = self.parts(), {short(f) for f in live}
        own = sorted(alive & {f for _, listed in parts for f in listed})
        if len(parts) > MOST_PARTS and own:
            self._publish(self._rows(parts, alive), own)
            for folder, _ in parts:
                self.files.delete(f"{self.folder}/lists/{folder.rsplit('/', 1)[1]}.json")

    def _publish(self, rows: DataFrame, files: list[str]) -> None:
        # A cell of many files goes to several tasks: about as many files of an index as of its table.
        name, salt = uuid.uuid4().hex, F.pmod(F.hash("file"), F.lit(len(files) // CELLS + 1))
        rows.repartition(F.col("__cell"), salt).write.partitionBy("__cell").parquet(f"{self.folder}/parts/{name}")
        self.files.create(f"{self.folder}/lists/{name}.json", json.dumps(files))

    def _rows(self, parts: list[tuple[str, list[str]]], alive: set[str]) -> DataFrame | None:
        out = None
        for folder, listed in parts:
            own = [f for f in listed if f in alive]
            if own and any(n.startswith("__cell=") for n in self.files.names(folder)):
                rows = self.spark.read.parquet(folder).where(F.col("file").isin(own)).select("v", "tie", "file", "row", "__cell")
                out = rows if out is None else out.unionByName(rows)
        return out

    def search(self, rest: Callable[[list[str]], DataFrame], live: list[str], queries: list[tuple[Any, list[float]]], k: int, probes: int = PROBES) -> DataFrame:
        """(query, tie, file, row, distance): the ``k`` nearest of each query (id, vector) among the rows of ``live`` files.

        ``rest(files)`` gives the ``placed`` rows of those that no part covers: each query meets all of these.
        """
        centres, parts = self.centres(), self.parts()
        alive, covered = {short(f) for f in live}, {f for _, listed in parts for f in listed}
        rows = self._rows(parts, alive)
        left = [f for f in live if short(f) not in covered]
        if left or rows is None:
            more = rest(left).withColumn("__cell", F.lit(None).cast("int"))
            rows = more if rows is None else rows.unionByName(more)
        return search_cells(rows, "v", centres if centres is not None else np.zeros((0, 0)), self.metric, queries, k, probes, ["tie", "file", "row"])
