"""Fields of a value that stay with a target key from version to version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import KeySpec, match
from ..sources.schema import ORD, WaveError
from ..sources.store import Scratch


@dataclass(frozen=True)
class Preserve:
    """What a new value takes from an example: the first old row of the same target and source key, else the first
    old row of the target key.

    ``fields`` of a struct value are copied from the example; a key without one gets generated ones: ``dense``
    (numbers after the highest ever given), ``uuid`` (strings) or ``hash`` (64 bits of the key, so bigint fields). Or ``merge`` makes the value:
    ``merge(new, example)`` over columns, of which example is null for the first row of a new key; what it
    makes of that row is the example of the key's other rows.
    """

    fields: tuple[str, ...] = ()
    generate: str = "dense"
    merge: Callable[[Column, Column], Column] | None = None


def _numbered(keys: DataFrame, spec: KeySpec, after: int, scratch: Scratch) -> DataFrame:
    """Distinct new keys with dense numbers by key order: ranges are numbered on their own, then shifted."""
    ranged = scratch.put(keys.repartitionByRange(*spec.sort("target_key")).withColumn("_pid", F.spark_partition_id()).select("target_key", "_pid"))
    counts = ranged.groupBy("_pid").count()  # a row a partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_pid", before.alias("_shift"))
    number = F.row_number().over(Window.partitionBy("_pid").orderBy(*spec.sort("target_key")))
    return ranged.join(F.broadcast(shifts), "_pid").select("target_key", (number + F.col("_shift") + after).cast("long").alias("_id"))


def _checked(kind: T.StructType, how: Preserve) -> None:
    right = {"dense": T.IntegralType, "uuid": T.StringType, "hash": T.LongType}
    if how.generate not in right:
        raise ValueError(f"unknown generator {how.generate}")
    for f in kind.fields:
        if f.name in how.fields and not isinstance(f.dataType, right[how.generate]):
            raise WaveError(f"{how.generate} can't be kept in {f.name}, a {f.dataType.simpleString()}")


def preserve(produced: DataFrame, content: DataFrame, how: Preserve, target: KeySpec, source: KeySpec, after: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """``produced`` with preserved values, and the highest number given so far. ``content`` may lack keys that
    ``produced`` hasn't."""
    kind = produced.schema["value"].dataType
    if how.merge is None:
        _checked(kind, how)
    rows = produced.withColumn("_g", target.of("target_key")).withColumn("_s", source.of("source_key"))
    old = content.withColumn("_g", target.of("target_key")).withColumn("_s", source.of("source_key"))
    old = match(old, rows.select("_g"), "left_semi")
    firsts = old.groupBy("_g").agg(F.min_by("value", F.struct("source_key", ORD)).alias("_old"))
    same = old.groupBy(F.struct("_g", "_s").alias("_gs")).agg(F.min_by("value", ORD).alias("_same"))
    known = match(match(rows.withColumn("_gs", F.struct("_g", "_s")), same, "left", on="_gs"), firsts.withColumn("_known", F.lit(True)), "left")
    known = known.withColumn("_old", F.when(F.col("_same").isNotNull(), F.col("_same")).otherwise(F.col("_old")))
    new = match(rows, firsts.select("_g"), "left_anti")
    if how.merge is not None:
        first = new.groupBy("_g").agg(F.min_by(F.struct("target_key", "value"), F.struct("source_key", ORD)).alias("f"), F.min(F.struct("source_key", ORD)).alias("_at"))
        made = first.select(F.col("f.target_key").alias("target_key"), "_at", how.merge(F.col("f.value"), F.lit(None).cast(kind)).alias("_made"))
        made = scratch.put(made).withColumn("_g", target.of("target_key")).drop("target_key")
        out = match(known, made, "left")
        own = F.col("_at").isNotNull() & F.struct("source_key", ORD).eqNullSafe(F.col("_at"))
        value = F.when(F.col("_known"), how.merge(F.col("value"), F.col("_old"))).when(own, F.col("_made")).otherwise(how.merge(F.col("value"), F.col("_made")))
        return out.withColumn("value", value.cast(kind)).select(*produced.columns), after
    fresh = new.groupBy("_g").agg(F.min("target_key").alias("target_key"))
    if how.generate == "dense":
        fresh = scratch.put(_numbered(fresh, target, after, scratch))
        top = fresh.agg(F.max("_id")).first()[0]
        after = after if top is None else int(top)
    elif how.generate == "uuid":
        fresh = scratch.put(fresh.select("target_key", F.expr("uuid()").alias("_id")))
    else:
        fresh = fresh.select("target_key", F.xxhash64("_g").alias("_id"))
    out = match(known, fresh.select(target.of("target_key").alias("_g"), "_id"), "left")
    cells: list[Column] = []
    for f in kind.fields:
        if f.name in how.fields:
            cells.append(F.when(F.col("_known"), F.col("_old").getField(f.name)).otherwise(F.col("_id").cast(f.dataType)).alias(f.name))
        else:
            cells.append(F.col("value").getField(f.name).alias(f.name))
    return out.withColumn("value", F.struct(*cells)).select(*produced.columns), after
