"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. A row descends it: at each level every child draws
``-ln(u) / weight`` with u a hash of (id, path of the child), and the least draw wins, so a child gets rows in
proportion to its weight and a changed weight moves rows only into or out of that child's subtree.
A shard beyond the first ``base``, with which a cluster began, opens a region of its own, so one more shard takes
rows into itself and moves none between the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name

Tree = dict[str, dict[str, dict[int, float]]]
ROWS_A_BUCKET, MOST_BUCKETS = 100_000, 1 << 16


def tree(shards: int, base: int | None = None, per_rack: int = 4, racks: int = 3) -> Tree:
    """Shards 0 to ``shards`` - 1; the first ``base`` (all, up to 24, if not said) in full racks and regions, each later
    one alone. Rows keep their places from one count to the next only under one base, so no count is below it."""
    base = min(shards, 24) if base is None else base
    if not 1 <= base <= shards:
        raise ValueError("a tree needs at least one shard, and no fewer than it began with")
    out: Tree = {}
    for s in range(base):
        rack = s // per_rack
        out.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    for s in range(base, shards):
        out[f"region-of-{s}"] = {f"rack-of-{s}": {s: 1.0}}
    return out


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _levels(node: Tree | dict, path: str = "") -> tuple[dict[str, list[tuple[str, float]]], int]:
    """The children of each inner node with their weights, by path, and the number of levels."""
    at, deep = {path: [(f"{path}/{k}", float(_weight(v))) for k, v in node.items() if _weight(v) > 0]}, 1
    for k, v in node.items():
        if isinstance(v, dict) and _weight(v) > 0:
            below, depth = _levels(v, f"{path}/{k}")
            at, deep = at | below, max(deep, depth + 1)
    if not at[path]:
        raise ValueError("a tree needs a child of positive weight")
    return at, deep


def assign(key: Column, of: Tree) -> Column:
    """The shard of each key: an int column. A null key is a key like any other."""
    children, depth = _levels(of)
    listed = F.create_map(*[x for path, kids in children.items() for x in (F.lit(path), F.array(*[F.struct(F.lit(k).alias("child"), F.lit(w).alias("weight")) for k, w in kids]))])
    key, at = F.coalesce(key.cast("string"), F.lit("null")), F.lit("")
    for _ in range(depth):
        at = F.array_min(F.transform(F.element_at(listed, at), lambda c: F.struct(_draw(key, c["child"], c["weight"]).alias("draw"), c["child"].alias("child"))))["child"]
    return F.substring_index(at, "/", -1).cast("int")


def _draw(key: Column, child: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, child), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", base: int | None = None) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to the id column.

    Only the id and the text are read; other columns, whatever their names, are ignored. A null text
    has size 8 and checksum 0; a null id is an id. Slots count from 0 in each shard without gaps:
    each shard is split by a hash of the id into buckets of about ``ROWS_A_BUCKET`` rows, counted, and numbered
    within its bucket from the rows before it, so no task gets a whole shard. Repeated rows take
    consecutive slots. An empty table gives an empty result. ``base``: see ``tree``.
    """
    key, text = F.col(id_col), F.col(text_col)
    base = min(shards, 24) if base is None else base
    buckets = min(MOST_BUCKETS, max(64, docs.count() // (shards * ROWS_A_BUCKET)))
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        assign(key, tree(shards, base)).alias("shard"),
        assign(key, tree(shards + 1, base)).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    ids = docs.select(key.alias("doc_id")).select(assign(F.col("doc_id"), tree(shards, base)).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = ids.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    # at most shards * buckets rows of three numbers
    rows = rows.join(F.broadcast(offsets), ["shard", "bucket"]) if shards * buckets <= 1 << 18 else rows.join(offsets, ["shard", "bucket"])
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + number - 1).alias("slot"), "grown_shard")


def with_shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one more column, shard (with underscores in front if that name is taken)."""
    return docs.withColumn(free_name(docs, "shard"), assign(F.col(id_col), tree(shards)))
