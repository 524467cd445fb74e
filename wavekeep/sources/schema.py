"""Schemas of the datasets of a stage, and checks of a wave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADD, UPDATE, DELETE = "add", "update", "delete"
CHANGES = (ADD, UPDATE, DELETE)
ORD = "_ord"


class WaveError(ValueError):
    """A wave that breaks the rules of its input."""


def ddl(t: T.DataType | str) -> T.DataType:
    return T._parse_datatype_string(t) if isinstance(t, str) else t


def updates_schema(key: T.DataType | str, value: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField("type", T.StringType(), False), T.StructField("key", ddl(key)), T.StructField("value", ddl(value)), T.StructField("ordinal", T.LongType())])


def content_schema(target: T.DataType | str, source: T.DataType | str, value: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField("target_key", ddl(target)), T.StructField("source_key", ddl(source)), T.StructField("value", ddl(value)), T.StructField(ORD, T.LongType())])


def mappings_schema(source: T.DataType | str, target: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField("source_key", ddl(source)), T.StructField("target_key", ddl(target))])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def as_updates(df: DataFrame, change: str = ADD) -> DataFrame:
    """A wave from rows (key, value): adds ``type`` and ``ordinal`` where they are missing."""
    if "type" not in df.columns:
        df = df.withColumn("type", F.lit(change))
    if "value" not in df.columns:
        df = df.withColumn("value", F.lit(None))
    if "ordinal" not in df.columns:
        df = df.withColumn("ordinal", F.lit(0).cast("long"))
    return df.select("type", "key", "value", "ordinal")


def check_wave(updates: DataFrame, group) -> None:
    """Each key has one delete or any number of upserts; types are known. Raises WaveError."""
    odd = ~F.coalesce(F.col("type"), F.lit("")).isin(*CHANGES)
    # upserts alone, however many, need no look at their keys
    if not any(updates.agg(F.count_if(F.col("type") == DELETE), F.count_if(odd)).first()):
        return
    deletes = F.sum((F.col("type") == DELETE).cast("int"))
    bad = updates.groupBy(group.alias("_g")).agg(deletes.alias("d"), F.count("*").alias("n"), F.max(odd.cast("int")).alias("odd"))
    first = bad.where("(d > 0 and n > 1) or odd = 1").select(F.col("_g").cast("string").alias("k"), "d", "n", "odd").head()
    if first is not None:
        what = "an unknown change type" if first["odd"] else "several deletes" if first["d"] == first["n"] else "a delete and upserts"
        raise WaveError(f"key {first['k']} has {what} in one wave")


def _bare(t: T.DataType) -> T.DataType:
    """A type without the nullability of its parts and without collations."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _bare(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_bare(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(_bare(t.keyType), _bare(t.valueType))
    return T.StringType() if isinstance(t, T.StringType) else t


def check_shape(df: DataFrame, schema: T.StructType, stage: str) -> None:
    """Raises WaveError if a producer's columns are not of the stage's types."""
    for f in schema.fields:
        made = df.schema[f.name].dataType
        if _bare(made) != _bare(f.dataType):
            raise WaveError(f"{stage} makes {f.name} of type {made.simpleString()}, not {f.dataType.simpleString()}")
