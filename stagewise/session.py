"""Session settings the operators count on, and the one place that cuts lineage."""

from __future__ import annotations

import importlib
import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# AQE splits the skewed side of a lookup join by itself; forcing it keeps that true when a grouping on the same key
# follows the join. Duplicate JSON keys keep the last value instead of failing the parse. Streaming state lives in RocksDB,
# on disk, so that it may outgrow the memory of an executor.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options above on a session and return it."""
    for name, value in RECOMMENDED_CONF.items():
        spark.conf.set(name, value)
    return spark


_shipped: set[tuple[str, str]] = set()


def ship_packages(spark: SparkSession, *packages: str) -> None:
    """Send Python packages to the executors once per application, for the functions that run in Python there."""
    context = spark.sparkContext
    for package in packages:
        done = (str(context.applicationId), package)
        if done in _shipped:
            continue
        root = os.path.dirname(os.path.abspath(str(importlib.import_module(package).__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="stagewise-code-"), f"{package}.zip")
        with zipfile.ZipFile(archive, "w") as target:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        target.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
        _shipped.add(done)


def spread(source: DataFrame) -> DataFrame:
    """Rows of a table scan over at least as many partitions as there are cores.

    For scans of a few small files in front of expensive expressions. A scan with enough partitions is returned as it is,
    so large tables are not shuffled.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    return source if source.rdd.getNumPartitions() >= cores else source.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder serves a driver without executors (``local``, ``local[n]``); any other master
    needs the setting.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="stagewise-checkpoint-")
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return current


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once, so later branches see the same partitioning and values."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
