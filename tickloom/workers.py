"""The package on Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped = ""


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application. The driver serves the archive
    from its own folder as long as it runs, and deletes it then."""
    global _shipped
    if _shipped != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tickloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tickloom_package", "zip", root.parent, root.name))
        _shipped = spark.sparkContext.applicationId
