"""Stored results: predictions and reports as Parquet, a frozen list of features as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ("model",)) -> None:
    """A folder for each value of the ``by`` columns that ``df`` has, so that one model is read alone."""
    df.write.mode(mode).partitionBy(*(c for c in by if c in df.columns)).parquet(path)


def read_results(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("model").isin(models)) if models is not None else df


def write_features(spark: SparkSession, names: list[str], path: str, mode: str = "overwrite") -> None:
    """The chosen features in order, one JSON line each."""
    spark.createDataFrame(list(enumerate(names)), "place int, feature string").coalesce(1).write.mode(mode).json(path)


def read_features(spark: SparkSession, path: str) -> list[str]:
    return [r.feature for r in spark.read.schema("place int, feature string").json(path).orderBy("place").collect()]  # a name for each column
