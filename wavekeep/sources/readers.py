"""Waves from files and tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ADD, DELETE, as_updates


def keyed(df: DataFrame, key: Column, value: Column, ordinal: Column | None = None, change: str = ADD) -> DataFrame:
    """Rows of a table as a wave: key and value are expressions over its columns."""
    rows = df.select(key.alias("key"), value.alias("value"), (F.lit(0) if ordinal is None else ordinal).cast("long").alias("ordinal"))
    return as_updates(rows, change)


def whole_file(spark: SparkSession, path: str) -> DataFrame:
    """Each row of a Parquet file as a value of one key, the file's name."""
    df = spark.read.parquet(path)
    return keyed(df, F.lit(path.rstrip("/").rpartition("/")[2]), F.struct("*"))


def deletes(keys: DataFrame, value_like: DataFrame) -> DataFrame:
    """One delete for each distinct ``key``, with values typed as in ``value_like``."""
    kind = value_like.schema["value"].dataType
    return as_updates(keys.select("key").distinct().withColumn("value", F.lit(None).cast(kind)), DELETE)
