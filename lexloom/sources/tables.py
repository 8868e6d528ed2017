"""Table folders: one parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "doc_meta", "blocks", "images", "regions", "selections", "validations", "jobs", "job_events", "eval_items", "toxic_labels",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read `name` of a table folder; columns and filters used later are pushed into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
