"""Makes the package importable in the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Stateful streams also start a worker beside the driver, which gets no files: it finds the package by its path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_emberline_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    paths = [os.path.dirname(here), sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))]
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    target = os.path.join(tempfile.mkdtemp(prefix="emberline-zip-"), "emberline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._emberline_shipped = True
