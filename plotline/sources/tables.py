"""Lazy access to the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


class Tables:
    """``Tables(spark, dir).lineitem`` -> DataFrame over ``dir/lineitem.parquet``.

    Reads are lazy and un-cached: each query prunes columns and pushes filters into
    its own scan, and the scan's own splits set its parallelism.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)
