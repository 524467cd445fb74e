"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import Scratch

__all__ = ["Scratch"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of text that a Python worker handles at once, unless one text alone has more.
PIECE = 1 << 22


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut by the size of the strings in column ``text``, whatever batches the session makes."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(ends) or ends[-1] <= most:
            yield b
            continue
        at = 0
        while at < len(ends):
            had = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, had + most, "right")))
            yield b.slice(at, upto - at)
            at = upto


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: The MOST_HOT keys with the most rows, if more than HOT, are dealt over at most MOST_PARTS tasks.
HOT = 256
MOST_HOT, MOST_PARTS = 4096, 1024


def salted_join(rows: DataFrame, key: str, by: str, unique: DataFrame, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``unique`` (one row a key) on ``key``; a hot key's rows are dealt over several tasks by a
    hash of ``by``. The list of hot keys is bounded, so it can be broadcast. Keys are counted in ``counted``,
    by default ``rows``, which is then read twice."""
    counts = (rows if counted is None else counted).groupBy(key).count()
    hot = [(r[0], min(MOST_PARTS, -(-r[1] // HOT))) for r in counts.where(F.col("count") > HOT).orderBy(F.desc("count")).limit(MOST_HOT).collect()]
    if not hot:
        return rows.join(unique, key, how)
    kind = rows.schema[key].dataType.simpleString()
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} {kind}, _parts bigint"))
    left = rows.join(parts, key, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")))).drop("_parts")
    right = unique.join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


#: Elements oftenest in a sample of sets, which come last in the order of a set: at most 16 MB.
MOST_OFTEN = 1 << 20
#: Rows of an element that meet in one block.
BLOCK = 1024
_EDGE = 1e-6  # a bound on a size is missed by no rounding


def sample(rows: DataFrame, by: str, n: int, least: int, share: float) -> DataFrame:
    """About ``least`` of ``n`` rows, but never less than this share of them, by a hash of column ``by``. As the share has a
    floor, an element that a sample shows less than three times is in a bounded number of rows on the whole, however
    large the table."""
    part = max(least / max(1, n), share)
    return rows.where(F.shiftrightunsigned(F.xxhash64(by), 1) <= min(int(part * (1 << 63)), (1 << 63) - 1))


def often(texts: DataFrame, elements: Callable[[object], np.ndarray]) -> np.ndarray:
    """The elements that occur oftenest in a sample of texts (one column), at least three times, and their counts: two
    rows of longs, by element. Only the cost of ``alike`` depends on them."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            found = [np.unique(elements(x)) for x in dict.fromkeys(b.column(0).to_pylist())]
            element, count = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(element), pa.array(count)], names=["element", "n"])

    scratch = Scratch(texts.sparkSession)
    found = texts.mapInArrow(every, "element bigint, n bigint")
    found = scratch.put(found.groupBy("element").agg(F.sum("n").alias("count")).where("count > 2"))
    least, held = 1 << 62, 0
    for r in found.groupBy("count").agg(F.count("*").alias("rows")).orderBy(F.desc("count")).collect():
        held += r["rows"]
        if held > MOST_OFTEN:
            break
        least = r["count"]
    top = found.where(F.col("count") >= least).toArrow()
    element, count = (top.column(x).to_numpy().astype(np.int64) for x in ("element", "count"))
    scratch.drop()
    order = np.argsort(element)
    return np.stack([element[order], count[order]])


def leading(elements: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first of a set's distinct longs in one order for all sets, the rare ones first: as many as it takes that
    two sets of at least this Jaccard similarity share one of them. And how many of them are in ``common``."""
    rank = np.zeros(len(elements), np.int64)
    if common.shape[1]:
        at = np.minimum(np.searchsorted(common[0], elements), common.shape[1] - 1)
        rank = np.where(common[0][at] == elements, common[1][at], 0)
    keep = len(elements) - int(np.ceil(similarity * len(elements) - _EDGE)) + 1
    order = np.lexsort((elements, rank))[:keep]
    return elements[order], int((rank[order] > 0).sum())


def alike(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different roots: all whose sets have at least this Jaccard similarity, and
    some others. sets: node, root, n (the size of the set), lead (its ``leading`` elements) and common (how many of
    these, the last ones, are in the list of ``often``).

    Of two such sets the longer has one of its leading elements among the first of the shorter, at places that
    leave enough for what they must share. Elements of the list are counted by partial aggregation and their
    counts broadcast (a bounded list); the others, which are rare, meet in one shuffle. Rows of an element meet in
    blocks of ``BLOCK`` by ``BLOCK``, so that no task gets all rows of a frequent one; nodes of one root are linked already.
    """
    t, inner = similarity, Scratch(scratch.spark)
    rows = sets.select("node", "root", "n", F.posexplode("lead").alias("i", "element"), (F.size("lead") - F.col("common")).alias("rare"))
    every = Window.partitionBy("element")
    seldom = rows.where("i < rare").drop("rare").withColumn("rows", F.count("*").over(every)).withColumn("mixed", F.min("root").over(every) < F.max("root").over(every))
    frequent = rows.where("i >= rare").drop("rare")
    counts = frequent.groupBy("element").agg(F.count("*").alias("rows"), (F.min("root") < F.max("root")).alias("mixed")).where("mixed")
    rows = seldom.where("mixed").unionByName(frequent.join(F.broadcast(counts), "element"))  # at most MOST_OFTEN rows
    rows = rows.withColumn("blocks", F.expr(f"(rows + {BLOCK - 1}) div {BLOCK}"))
    rows = inner.put(rows.select("node", "root", "n", "i", "element", "blocks", F.expr("pmod(xxhash64(element, node), blocks)").alias("block")))
    each = F.explode(F.expr("sequence(0L, blocks - 1)"))
    x = rows.select("element", F.col("block").alias("s"), each.alias("t"), F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("i").alias("ix"))
    y = rows.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - _EDGE))
    y = y.select("element", each.alias("s"), F.col("block").alias("t"), F.col("node").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("i").alias("iy"))
    enough = f"* {1 + t} >= {t} * (nx + ny) - {_EDGE}"
    pairs = x.join(y, ["element", "s", "t"]).where(f"rx <> ry and (nx > ny or nx = ny and x > y) and ny >= {t} * nx - {_EDGE} and least(nx - ix, ny - iy) {enough}")
    # all shared up to the last shared place are counted
    pairs = pairs.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("c"), F.max("ix").alias("ix"), F.max("iy").alias("iy"))
    pairs = pairs.where(f"(c + least(nx - ix, ny - iy) - 1) {enough}")
    out = scratch.put(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    inner.drop()
    return out


#: Elements of the sets that meet in one block of verification, unless one set alone has more.
BLOCK_ELEMENTS = 1 << 15
_SALTS = 64


def verified(pairs: DataFrame, sizes: DataFrame, sets: Callable[[DataFrame], DataFrame], elements: Callable[[bytes], np.ndarray], similarity: float, scratch: Scratch) -> DataFrame:
    """Of the written pairs (a, b) of nodes those whose sets have at least this Jaccard similarity, each compared exactly.

    sizes: (node, n) of all nodes. sets: gives (node, held) of the nodes in a column id, of which ``elements`` makes the
    sorted distinct longs of a set. A set is not sent along with each of its pairs: nodes are dealt into blocks of nodes that meet
    each other (those with the same least partner, split by size), and a set is sent once to each pair of blocks in
    which its node has a pair. There the sets of a block are held while its pairs are read.
    """
    if pairs.isEmpty():
        return pairs
    inner = Scratch(scratch.spark)
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), "a"), F.struct(F.col("b").alias("node"), "a"))).alias("e")
    lab = pairs.select(both).groupBy("e.node").agg(F.min("e.a").alias("label")).join(sizes, "node")
    lab = inner.put(lab.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")))
    large = lab.groupBy("label").agg(F.sum("n").alias("total")).where(f"total > {BLOCK_ELEMENTS}").select("label", F.expr(f"(total + {BLOCK_ELEMENTS - 1}) div {BLOCK_ELEMENTS}").alias("parts"))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    part = F.coalesce(F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")), F.lit(0))
    blocks = inner.put(lab.join(large, ["label", "salt"], "left").select("node", F.xxhash64("label", part).alias("block")))
    met = salted_join(pairs, "a", "b", blocks.select(F.col("node").alias("a"), F.col("block").alias("p")))
    met = salted_join(met, "b", "a", blocks.select(F.col("node").alias("b"), F.col("block").alias("q")), counted=pairs)
    met = inner.put(met.select("a", "b", F.xxhash64(F.least("p", "q"), F.greatest("p", "q")).alias("at")))
    member = met.select("at", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = member.join(sets(blocks.select(F.col("node").alias("id"))), "node").select("at", F.lit(None).cast("bigint").alias("a"), F.col("node").alias("b"), "held")
    rows = rows.unionByName(met.select("at", "a", "b", F.lit(None).cast("binary").alias("held")))
    rows = rows.repartition("at").sortWithinPartitions("at", F.col("a").asc_nulls_first(), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, here = None, {}
        for batch in batches:
            left, right = [], []
            for at, a, b, held in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if at != now:
                    now, here = at, {}
                if a is None:
                    here[b] = elements(held)
                    continue
                x, y = here.get(a), here.get(b)
                if x is None or y is None:
                    raise ValueError("a node without a set")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) - _EDGE:
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= similarity * (len(x) + len(y) - shared) - _EDGE:
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    out = scratch.put(rows.mapInArrow(run, "a bigint, b bigint"))
    inner.drop()
    return out


#: Bits of a filter of ids: 32 MB at most.
MOST_BITS = 1 << 28
_SHIFTS = (7, 14, 21)


def short(digest: bytes) -> int:
    """64 bits of a digest as a long: the name of a text or line in joins."""
    return int.from_bytes(digest[:8], "big", signed=True)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the distinct 64-bit ids in column id: it keeps what is no candidate off the network.
    Its bits are a power of two, at most ``MOST_BITS``; with more ids than that suits, it passes more rows than
    needed but never fewer. Built by or-ing words, of which a bounded number comes to the driver."""
    n, bits = ids.count(), 1 << 10
    while bits < 16 * n and bits < MOST_BITS:
        bits *= 2
    spots = F.explode(F.array(*[F.col("id").bitwiseXOR(F.shiftright("id", s)).bitwiseAND(F.lit(bits - 1)) for s in _SHIFTS]))
    words = ids.select(spots.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["m"]
    return out


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    keep, last = np.ones(len(ids), bool), len(words) * 64 - 1
    for s in _SHIFTS:
        p = (ids ^ (ids >> s)) & last
        keep &= (words[p >> 6] >> (p & 63) & 1).astype(bool)
    return keep


def components(edges: DataFrame, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """Distributed union-find over edges (a, b) of longs: one row (node, root) for each node that has an edge,
    where root is the least node of its component.

    Alternates large-star and small-star steps (minimum by partial aggregation, then a join that deals a hot
    centre's edges over several tasks) and writes the edges after each, until a round changes nothing. The
    rounds needed grow with the logarithm of the longest path; more than ``rounds`` raise an error.
    """
    edges = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = salted_join(both.where("b > a"), "a", "b", low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        star = scratch.put(star)
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        star = salted_join(star, "a", "b", low).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = scratch.put(star.select("e.a", "e.b").where("a <> b").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components are not settled after {rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


def joined_roots(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) after ``links`` (a, b) have joined some of the components ``roots``. Only their roots take part."""
    if links.isEmpty():
        return roots
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    above = scratch.put(components(between, scratch)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    alone = above.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti")
    every = scratch.put(roots.unionByName(alone))
    return scratch.put(salted_join(every, "root", "node", above, "left").select("node", F.coalesce("top", "root").alias("root")))
