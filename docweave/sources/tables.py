"""Access to the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    """The table's rows; with columns given, only these (the scan then reads no others)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
