"""Sending this package to the executors, for clusters where it is not installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_lexloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    where = os.path.join(tempfile.mkdtemp(prefix="lexloom-"), "lexloom.zip")
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(where)
    sc._lexloom_shipped = True


def shipped(query):
    """`query`, which ships the package first."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
