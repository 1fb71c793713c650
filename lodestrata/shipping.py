"""Sends this package to the Python workers of a session, once."""

from __future__ import annotations

import functools
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file, so that executors can import it whatever their search path."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    package = pathlib.Path(__file__).parent
    target = pathlib.Path(tempfile.mkdtemp()) / "lodestrata.zip"  # read by the driver's file server only
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._lodestrata_shipped = True


def shipped(query):
    """A query that ships the package first."""

    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
