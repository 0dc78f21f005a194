"""Snapshots of tables as Parquet or CSV: each in a folder of its own, published by a small file that names it."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Sequence

from tidemill.errors import MisuseError, StorageError
from tidemill.store.connection import Connection, Database
from tidemill.store.files import Files

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise MisuseError(f"unsafe identifier {name!r}")
    return name


_CURRENT = "_current"


def materialize(connection: Connection, table: str, folder: str, columns: Sequence[str] = (), format: str = "parquet", keep: int = 2) -> str:
    """Write ``table`` (some columns or all) as a new folder in ``<folder>/<table>.<format>`` and give its path, which ``snapshot`` then finds.

    Readers see the old snapshot or the new one, also if the writer dies: what is named is whole, and changes its name in one step. The last ``keep``
    folders stay for readers that are at it. CSV has a header, empty text for null, and quotes where needed. All rows are written by
    all executors: the path is a folder of part files.
    """
    if format not in ("parquet", "csv"):
        raise MisuseError("format is parquet or csv")
    wanted = ", ".join(f'"{_checked(c)}"' for c in columns) or "*"
    df = connection.sql(f'SELECT {wanted} FROM "{_checked(table)}"')
    files = Files(connection.spark)
    top = f"{folder.rstrip('/')}/{table}.{format}"
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    if format == "csv":
        df.write.csv(f"{top}/{name}", header=True, nullValue="", emptyValue="", quote='"', escape='"')
    else:
        df.write.parquet(f"{top}/{name}")
    files.replace(f"{top}/{_CURRENT}", name)
    for old in [n for n in files.names(top) if n[:20].isdigit() and n < name][: -(keep - 1) or None]:
        files.delete(f"{top}/{old}")
    return f"{top}/{name}"


def snapshot(connection: Connection, table: str, folder: str, format: str = "parquet") -> str:
    """The path of the last snapshot that was published."""
    files, top = Files(connection.spark), f"{folder.rstrip('/')}/{_checked(table)}.{format}"
    if not files.exists(f"{top}/{_CURRENT}"):
        raise StorageError(f"no snapshot of {table} in {folder}")
    return f"{top}/{files.read(f'{top}/{_CURRENT}')}"


class Materializer:
    """Publishes snapshots at once and then every ``seconds`` until ``stop``."""

    def __init__(self, connect: Callable[[], Connection] | Database, tables: Sequence[str], folder: str, seconds: float, format: str = "parquet"):
        self._connect = connect.connect if isinstance(connect, Database) else connect
        self.tables, self.folder, self.seconds, self.format = list(tables), folder, seconds, format
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None
        self.runs, self.last_error = 0, None

    def run_once(self) -> list[str]:
        connection = self._connect()
        out = [materialize(connection, t, self.folder, format=self.format) for t in self.tables]
        self.runs += 1
        return out

    def start(self) -> Materializer:
        if self._thread is not None:
            raise MisuseError("it runs already")

        def loop() -> None:
            while not self._stop.is_set():
                try:
                    self.run_once()
                except Exception as e:  # noqa: BLE001  the next round may do better
                    self.last_error = e
                self._stop.wait(self.seconds)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
            self._thread = None


__all__ = ["Materializer", "materialize", "snapshot"]
