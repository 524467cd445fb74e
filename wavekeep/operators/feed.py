"""Uses of a change feed outside the graph."""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.keys import KeySpec, match
from ..sources.schema import ADD, DELETE


def added_keys(feed: DataFrame) -> DataFrame:
    """Keys to insert into a table kept in step."""
    return feed.where(F.col("type") == ADD).select("key")


def deleted_keys(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("type") == DELETE).select("key")


def apply_feed(values: DataFrame, feed: DataFrame, spec: KeySpec = KeySpec()) -> DataFrame:
    """(key, value) of the next version from those of the last one and the feed between them."""
    touched = feed.select(spec.of("key").alias("_g")).distinct()
    kept = match(values.withColumn("_g", spec.of("key")), touched, "left_anti").select("key", "value")
    return kept.unionByName(feed.where(F.col("type") != DELETE).select("key", "value"))


def sync(feed: DataFrame, insert: Callable[[Iterable[Row]], None], delete: Callable[[Iterable[Row]], None]) -> None:
    """Keeps the keys of an outside table in step: calls ``delete``, then ``insert`` with the keys of each partition."""
    deleted_keys(feed).foreachPartition(delete)
    added_keys(feed).foreachPartition(insert)
