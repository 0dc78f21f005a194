"""Sessions, and what every session needs on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(app: str = "tidemill", cores: int | str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI mode and adaptive execution; ``conf`` has further settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that functions given to Spark can be found there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidemill-")
    path = os.path.join(folder, "tidemill_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, dirs, files in os.walk(top):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
