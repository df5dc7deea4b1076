"""Making the package known to executors."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once an application, whatever their PYTHONPATH is.

    Where the session has Spark's default of 10000 rows an Arrow batch, it gets 2000: whole texts are large rows.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    if getattr(sc, "_spanlake_shipped", None):
        return
    folder = tempfile.mkdtemp(prefix="spanlake-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "spanlake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(d, name)
                    z.write(path, os.path.join("spanlake", os.path.relpath(path, ROOT)))
    sc.addPyFile(target)
    sc._spanlake_shipped = target


def shipped(f):
    """A function of (spark, ...) that ships the package first."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return run
