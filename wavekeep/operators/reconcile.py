"""One stage, one wave: what the changed source keys had and have, the next version and the change feed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import KeySpec, match
from ..sources.schema import ADD, DELETE, ORD, UPDATE

CONTENT = ("target_key", "source_key", "value", ORD)
MAPPING = ("source_key", "target_key")


@dataclass
class StageState:
    content: DataFrame  # target_key, source_key, value, _ord
    key_mappings: DataFrame  # source_key, target_key: a row for each row of content


def changed_keys(updates: DataFrame, spec: KeySpec) -> DataFrame:
    """One key of each group that a wave changes."""
    if spec.plain:  # hashed; the first of strings or structs would be found by sorting all rows
        return updates.select("key").distinct()
    return updates.groupBy(spec.of("key").alias("_g")).agg(F.first("key").alias("key")).select("key")


def groups(keys: DataFrame, spec: KeySpec) -> DataFrame:
    return keys.select(spec.of("key").alias("_g"))


def next_content(content: DataFrame, changed: DataFrame, produced: DataFrame, spec: KeySpec) -> DataFrame:
    """The rows of unchanged source keys, and those produced."""
    kept = match(content.withColumn("_g", spec.of("source_key")), groups(changed, spec), "left_anti")
    return kept.select(*CONTENT).unionByName(produced.select(*CONTENT))


def next_mappings(mappings: DataFrame, changed: DataFrame, produced: DataFrame, spec: KeySpec) -> DataFrame:
    kept = match(mappings.withColumn("_g", spec.of("source_key")), groups(changed, spec), "left_anti")
    return kept.select(*MAPPING).unionByName(produced.select(*MAPPING))


def touched_keys(mappings: DataFrame, changed: DataFrame, produced: DataFrame, source: KeySpec, target: KeySpec) -> DataFrame:
    """(key, removed, made) for each target key that a changed source key had or has: one of its full keys (that of
    its first lost row), how many rows it loses and how many are new. Lineage alone tells, content isn't read."""
    lost = match(mappings.withColumn("_g", source.of("source_key")), groups(changed, source), "left_semi")
    rows = lost.select("target_key", "source_key", F.lit(1).alias("lost")).unionByName(produced.select("target_key", "source_key", F.lit(0).alias("lost")))
    counts = (F.sum("lost").alias("removed"), F.sum(1 - F.col("lost")).alias("made"))
    if target.plain:
        return rows.groupBy(F.col("target_key").alias("key")).agg(*counts)
    first = F.min_by("target_key", F.struct((1 - F.col("lost")).alias("late"), F.col("source_key")))
    return rows.groupBy(target.of("target_key").alias("_g")).agg(first.alias("key"), *counts).select("key", "removed", "made")


def with_past(touched: DataFrame, content: DataFrame, changed: DataFrame, source: KeySpec, target: KeySpec) -> DataFrame:
    """(key, known, alive, made, torn) of ``touched``: whether the key had rows in ``content``, whether it has any in the
    next one, how many of these are new, and whether lineage and content disagree about the rows that it loses."""
    rows = content.select(target.of("target_key").alias("_g"), source.of("source_key").alias("_s"))
    rows = match(rows, changed.select(source.of("key").alias("_s"), F.lit(1).alias("hit")), "left", on="_s")
    past = rows.groupBy("_g").agg(F.count("*").alias("had"), F.count("hit").alias("gone"))
    out = match(touched.withColumn("_g", target.of("key")), past, "left")
    gone = F.coalesce("gone", F.lit(0))
    alive = F.coalesce("had", F.lit(0)) - gone + F.col("made") > 0
    return out.select("key", F.col("had").isNotNull().alias("known"), alive.alias("alive"), "made", (gone != F.col("removed")).alias("torn"))


def unchanged(before: DataFrame, after: DataFrame, spec: KeySpec) -> DataFrame:
    """Groups whose rows are the same in both contents."""

    def bag(df: DataFrame) -> DataFrame:
        return df.groupBy(spec.of("target_key").alias("_g")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("target_key", "source_key", "value").cast("decimal(38,0)")).alias("h"))

    both = match(bag(after), bag(before).withColumnsRenamed({"n": "n0", "h": "h0"}), "inner")
    return both.where("n = n0 and h = h0").select("_g")


#: A new key of more rows is numbered apart, so that no task gets all of them.
HOT = 1 << 20


def hot_groups(rows: DataFrame, spec: KeySpec, part: int = 64) -> DataFrame:
    """Groups of about ``HOT`` rows and more, from a share of the rows: it matters only for how a feed is dealt out."""
    return rows.select(spec.of("target_key").alias("_g")).sample(1 / part, 1).groupBy("_g").count().where(F.col("count") >= HOT // part).select("_g")


def _led(rows: DataFrame, spec: KeySpec, hot: DataFrame | None) -> DataFrame:
    """The feed of new keys: of each group's rows the first by source key is an add."""
    rows = rows.withColumn("_g", spec.of("target_key"))
    cold = rows if hot is None else match(rows, hot, "left_anti")
    out = cold.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy("source_key", ORD))).withColumn("_lead", F.lit(True))
    if hot is not None:
        rows = match(rows, hot, "left_semi")
        first = rows.groupBy("_g").agg(F.min(F.struct("source_key", ORD)).alias("_first"))
        rows = match(rows, first, "left")
        # only rows that may be the first are numbered together; the others are spread
        lead = F.struct("source_key", ORD).eqNullSafe(F.col("_first"))
        spread = F.when(lead, F.lit(0)).otherwise(F.pmod(F.xxhash64("source_key", ORD), F.lit(64)) + 1)
        number = F.row_number().over(Window.partitionBy("_g", "_lead", "_spread").orderBy("source_key", ORD))
        out = out.unionByName(rows.withColumn("_lead", lead).withColumn("_spread", spread).withColumn("_n", number).drop("_spread", "_first"))
    return out.select(F.when(F.col("_lead") & (F.col("_n") == 1), ADD).otherwise(UPDATE).alias("type"), F.col("target_key").alias("key"), "value", F.col(ORD).alias("ordinal"))


def change_feed(touched: DataFrame | None, content: DataFrame | None, produced: DataFrame, spec: KeySpec, before: DataFrame | None = None, fresh: bool = True, hot: DataFrame | None = None) -> DataFrame:
    """For each touched target key: one delete if the new version has nothing of it, else all its rows. The first row
    of a key that was not known before is an add, all others are updates.

    touched: (key, known, alive); None if the stage was empty, so that all rows are new and ``produced``. content:
    the new one, which has the rows of known keys; all rows of other keys are ``produced``. before: the content before,
    to leave out the keys whose rows are as they were. fresh: whether there are keys that were not known. hot: groups
    of many new rows.
    """
    if touched is None:
        return _led(produced, spec, hot)
    touched = touched.withColumn("_g", spec.of("key"))
    stay = touched.where("known and alive").select("_g")
    if before is not None:
        stay = match(stay, unchanged(before, content, spec), "left_anti")
    after = match(content.withColumn("_g", spec.of("target_key")), stay, "left_semi")
    out = after.select(F.lit(UPDATE).alias("type"), F.col("target_key").alias("key"), "value", F.col(ORD).alias("ordinal"))
    if fresh:
        out = out.unionByName(_led(match(produced.withColumn("_g", spec.of("target_key")), touched.where("not known").select("_g"), "left_semi"), spec, hot))
    kind = content.schema["value"].dataType
    gone = touched.where("known and not alive")
    return out.unionByName(gone.select(F.lit(DELETE).alias("type"), "key", F.lit(None).cast(kind).alias("value"), F.lit(0).cast("long").alias("ordinal")))
