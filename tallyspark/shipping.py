"""Let executors import this package wherever they run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's code to this session's Python workers, once.

    Functions that run on executors are pickled by reference, so call this before using
    them from a script whose folder the executors don't share.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tallyspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp())  # the driver serves the file from here to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/tallyspark.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(f"{folder}/tallyspark.zip")
    sc._tallyspark_shipped = True
