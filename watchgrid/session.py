"""Session settings, and shipping this package to executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "watchgrid", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; master and sizes come from conf or spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp()) / "watchgrid"
    sc.addPyFile(shutil.make_archive(str(where), "zip", root.parent, root.name))
    _shipped.add(sc.applicationId)
