"""Cutting lineage in a folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="lexloom-checkpoint-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write `df` to the cluster's checkpoint folder and go on from the files.

    The folder is the one in `spark.checkpoint.dir`. Only where that is unset, as in local tests,
    a folder of this machine is used. Lost executors cost a re-read, never a recomputation.
    """
    _folder(df)
    return df.checkpoint(eager)


def cut_table(df: DataFrame) -> DataFrame:
    """As `cut`, but as a compressed columnar table, so that later reads take only the columns they need."""
    where = f"{_folder(df)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
