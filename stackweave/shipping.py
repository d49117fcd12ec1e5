"""Sends the package to the executors, for clusters where it is not installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of this application's workers, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stackweave-"), "stackweave-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, folders, names in os.walk(package):
            folders[:] = sorted(f for f in folders if f != "__pycache__")
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.join("stackweave", os.path.relpath(os.path.join(top, name), package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
