"""Tables that a job writes on its way, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str = "bars") -> str:
    """A new folder that all executors see: under ``spark.checkpoint.dir``, or a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: cuts lineage, and survives lost executors. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch(spark, name)}/rows.parquet"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
