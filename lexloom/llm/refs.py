"""References of records in the localization tables, and the union of text columns under them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.tables import table

KEYS = {
    "block": ("blocks", ("doc_id", "id")),
    "region": ("regions", ("doc_id", "image_id", "id")),
    "selection": ("selections", ("doc_id", "image_id")),
    "validation": ("validations", ("doc_id", "image_id")),
}


def ref_of(kind: str) -> Column:
    """`kind:key:key` as one string; a null key part counts as an empty one."""
    return F.concat_ws(":", F.lit(kind), *(F.coalesce(F.col(k), F.lit("")) for k in KEYS[kind][1]))


def texts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """(ref, text) of the named column of each kind, as in texts(spark, d, block="source_text"); null texts are left out."""
    parts = [
        table(spark, sf_dir, KEYS[kind][0]).where(F.col(c).isNotNull()).select(ref_of(kind).alias("ref"), F.col(c).alias("text"))
        for kind, c in columns.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
