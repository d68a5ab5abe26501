"""Operators that prepare text for language-model training; nothing else in the library imports them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as `--py-files` would.

    Also sets smaller Arrow batches where the session has Spark's default, so that workers stay small.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("64m", "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    with tempfile.NamedTemporaryFile(prefix=f"{name}-", suffix=".zip", delete=False) as file:
        target = file.name
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(top):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    archive.write(path, os.path.join(name, os.path.relpath(path, top)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
