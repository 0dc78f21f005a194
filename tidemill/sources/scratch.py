"""Folders for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from tidemill.errors import StorageError

_local: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a local master gets a temporary folder that goes with the process; on a cluster it's an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tidemill-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        top = _local[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
