"""Reading the driver's parquet tables with pruning-friendly projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """``spark.read.parquet`` of one table; ``cols`` narrows the ReadSchema.

    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df
