"""Joins of sources with one key type and different value types, as waves of a stage.

Either side's changed keys are affected, and a join is run anew for these only, on both sides' whole
values in the new version. Keys join by their group, so a coarse key or a collation holds here as elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KeySpec, match
from ..sources.schema import UPDATE
from .merge import groups_of, merge_wave, of_affected, upserts, with_deletes


def equi_join(left: DataFrame, right: DataFrame, how: str = "inner", spec: KeySpec = KeySpec()) -> DataFrame:
    """(key, value) of (key, value) sides; value is struct<left, right>, and the key is the left one's where there is
    a left one. how: inner, left, right or full."""
    a = left.select(spec.of("key").alias("_a"), F.col("key").alias("_ka"), F.col("value").alias("left"), F.lit(True).alias("_x"))
    b = right.select(spec.of("key").alias("_b"), F.col("key").alias("_kb"), F.col("value").alias("right"))
    rows = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), {"full": "full_outer"}.get(how, how))
    return rows.select(F.when(F.col("_x"), F.col("_ka")).otherwise(F.col("_kb")).alias("key"), F.struct("left", "right").alias("value"))


def join_wave(contents: tuple[DataFrame, DataFrame], affected: DataFrame | None, how: str = "inner", spec: KeySpec = KeySpec()) -> DataFrame:
    """A wave of pairs for a stage that holds a join. A changed key without result is a delete. affected: None if all
    keys of both sides are new."""
    sides = [upserts(of_affected(c, affected, spec)).select("key", "value") for c in contents]
    ups = equi_join(*sides, how, spec).select(F.lit(UPDATE).alias("type"), "key", "value", F.lit(0).cast("long").alias("ordinal"))
    if affected is None:
        return ups
    # keys tell which groups have a result, so the join is run once
    left, right = [groups_of(c, spec) for c in contents]
    alive = {"inner": lambda: match(left, right, "left_semi"), "left": lambda: left, "right": lambda: right, "full": lambda: left.unionByName(right)}[how]()
    return with_deletes(ups, affected, alive)


def cogroup_wave(contents: tuple[DataFrame, DataFrame], affected: DataFrame | None, spec: KeySpec = KeySpec()) -> DataFrame:
    """A wave of both sides' rows for a co-group: value is struct<side, left, right>, side 0 for left and 1 for right."""
    kinds = [x.schema["value"].dataType for x in contents]
    cells = [F.struct(F.lit(0).alias("side"), F.col("value").alias("left"), F.lit(None).cast(kinds[1]).alias("right")), F.struct(F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("left"), F.col("value").alias("right"))]
    return merge_wave([c.withColumn("value", cell) for c, cell in zip(contents, cells, strict=True)], affected, spec)
