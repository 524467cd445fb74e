"""Several feeders of one stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KeySpec, match
from ..sources.schema import DELETE, ORD, UPDATE


def affected_keys(feeds: list[DataFrame], spec: KeySpec = KeySpec()) -> DataFrame:
    """Distinct keys that any feeder changes: columns key (one of those in the group) and _g."""
    keys = reduce(DataFrame.unionByName, [f.select("key") for f in feeds])
    if spec.plain:
        return keys.distinct().withColumn("_g", spec.of("key"))
    return keys.withColumn("_g", spec.of("key")).groupBy("_g").agg(F.min("key").alias("key"))


def upserts(content: DataFrame) -> DataFrame:
    return content.select(F.lit(UPDATE).alias("type"), F.col("target_key").alias("key"), "value", F.col(ORD).alias("ordinal"))


def of_affected(content: DataFrame, affected: DataFrame | None, spec: KeySpec) -> DataFrame:
    """Rows of affected keys; all rows if ``affected`` is None."""
    if affected is None:
        return content
    return match(content.withColumn("_g", spec.of("target_key")), affected.select("_g"), "left_semi").drop("_g")


def groups_of(content: DataFrame, spec: KeySpec) -> DataFrame:
    return content.select(spec.of("target_key").alias("_g")).distinct()


def with_deletes(ups: DataFrame, affected: DataFrame, alive: DataFrame) -> DataFrame:
    """Upserts, and a delete for each affected key whose group is not in ``alive``."""
    gone = match(affected, alive, "left_anti")
    kind = ups.schema["value"].dataType
    return ups.unionByName(gone.select(F.lit(DELETE).alias("type"), "key", F.lit(None).cast(kind).alias("value"), F.lit(0).cast("long").alias("ordinal")))


def merge_wave(contents: list[DataFrame], affected: DataFrame | None, spec: KeySpec = KeySpec()) -> DataFrame:
    """What ``merge_sources`` gives, from the contents of the new version alone: a feed has all rows of its keys, so
    has the content. affected: None if all keys of all feeders are new."""
    ups = reduce(DataFrame.unionByName, [upserts(of_affected(c, affected, spec)) for c in contents])
    if affected is None:
        return ups
    return with_deletes(ups, affected, reduce(DataFrame.unionByName, [groups_of(c, spec) for c in contents]))


def augmented(feed: DataFrame, content: DataFrame, affected: DataFrame, spec: KeySpec = KeySpec()) -> DataFrame:
    """A feeder's changes, and for affected keys that it doesn't change its content, as updates."""
    own = feed.select(spec.of("key").alias("_g")).distinct()
    silent = match(affected.select("_g"), own, "left_anti")
    rows = content.select(F.lit(UPDATE).alias("type"), F.col("target_key").alias("key"), "value", F.col(ORD).alias("ordinal")).withColumn("_g", spec.of("key"))
    return feed.select("type", "key", "value", "ordinal").unionByName(match(rows, silent, "left_semi").drop("_g"))


def merge_sources(feeders: list[tuple[DataFrame, DataFrame]], spec: KeySpec = KeySpec(), affected: DataFrame | None = None) -> DataFrame:
    """One wave from (feed, content of the new version) of each feeder: a key that any feeder still has is
    upserted with all its values, one that none has is deleted once. Contents may lack keys that no feed has."""
    if len(feeders) == 1:
        return feeders[0][0]
    affected = affected_keys([f for f, _ in feeders], spec) if affected is None else affected
    rows = reduce(DataFrame.unionByName, [augmented(f, c, affected, spec) for f, c in feeders]).withColumn("_g", spec.of("key"))
    alive = rows.where(F.col("type") != DELETE)
    dead = match(rows.where(F.col("type") == DELETE), alive.select("_g").distinct(), "left_anti")
    dead = dead.groupBy("_g").agg(F.min("key").alias("key"), F.first("value").alias("value"), F.first("ordinal").alias("ordinal")).withColumn("type", F.lit(DELETE))
    names = ["type", "key", "value", "ordinal"]
    return alive.select(*names).unionByName(dead.select(*names))
