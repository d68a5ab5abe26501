"""Session settings and the staging of tables on shared storage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A join on more keys than a side is partitioned by doesn't shuffle that side again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app: str = "tallyboard", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for staged tables, under the cluster's `spark.checkpoint.dir`.

    Only a session on one machine, as in tests, may do without that setting; it
    uses the machine's temporary folder. On a cluster its executors would each
    write to a disk of their own, so that is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/tallyboard/{context.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Remove all that this application staged; call it once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table to shared storage and read it back.

    For tables that are read more than once: a lost executor costs a re-read, not
    a recomputation, and the planner knows the true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as `--py-files` would.

    Only operators that run Python in tasks need it.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    # The driver hands it out for as long as it runs.
    with tempfile.NamedTemporaryFile(prefix="tallyboard-", suffix=".zip", delete=False) as file:
        target = file.name
    atexit.register(os.unlink, target)
    with zipfile.ZipFile(target, "w") as archive:
        for here, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(here, name)
                    archive.write(path, os.path.join(os.path.basename(top), os.path.relpath(path, top)))
    context.addPyFile(target)
    _sent.add(context.applicationId)
