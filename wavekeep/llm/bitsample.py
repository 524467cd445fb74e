"""Near-duplicate documents by random bit-sampling of SimHash fingerprints.

Each distinct text gets two fingerprints of signed votes: a coarse one over its words, from which each of
several tables samples coordinates, and a fine one over its sets of five words. Texts that agree on a
table's first sampled coordinates share a bucket; a bucket of more than ``CAP`` texts is split by additional
ones until each part has at most ``CAP``, and what agrees on all of them meets its first text only. Candidates whose fine fingerprints are near are
verified on their texts, and verified links are joined by distributed union-find.

The tables find links cheaply, but not all. So texts that are not linked by then meet again if they share one of
their rarest runs of words that any two texts similar enough must share, and are verified alike: the
classes are exactly those of comparing all pairs, whatever the number of bits, tables or rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, alike, components, free_name, id_filter, joined_roots, leading, often, passes, pieces, salted_join, sample, short, verified

WORDS = 5
SIMILARITY = 0.8
SLACK = 0.15  # candidates of the tables whose estimate is this much too low are left to the exact pass
TABLES = 20
SAMPLED = 40
COARSE, FINE, FEATURES = 256, 512, 4096
CAP = 8
RUN = 1 << 19  # rows of a table that are cut into buckets at once
SAMPLE, SHARE = 20_000, 1 / 16  # texts of which the frequent runs of words are learned, and their least part of all

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _signs(columns: int, seed: int) -> np.ndarray:
    return np.where(np.random.default_rng(seed).random((FEATURES, columns)) < 0.5, -1, 1).astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words and of the distinct runs of ``WORDS`` words. ASCII case and
    the kind of white space don't count. A shorter text has one run, all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.fromiter(map(len, words), np.uint64, len(words)) * _MIX)
    if len(words) < WORDS:
        runs = h.copy()
        for i in range(1, len(h)):
            runs[0] = _mixed(runs[:1] * _MIX + h[i])[0]
        return np.unique(h), runs[:1]
    runs = h[: len(h) - WORDS + 1].copy()
    for i in range(1, WORDS):
        runs = runs * _MIX + h[i : len(h) - WORDS + 1 + i]
    return np.unique(h), np.unique(_mixed(runs))


def _counts(hashes: np.ndarray) -> np.ndarray:
    """Hashes as signed counts of ``FEATURES`` features."""
    at, sign = (hashes % np.uint64(FEATURES)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0)
    return np.bincount(at, weights=sign, minlength=FEATURES).astype(np.float32)


def sampled(seed: int = 7) -> np.ndarray:
    """The coordinates of each table, in the order in which they are used."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(COARSE)[:SAMPLED] for _ in range(TABLES)])


def _md5(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()


def frequent_runs(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """The runs of words that are frequent in a sample of ``n`` texts, for ``leading``."""
    some = sample(docs.select(F.col(text_col).alias("text")), "text", n, SAMPLE, SHARE)
    return often(some, lambda x: features(x)[1].view(np.int64))


def sketch(docs: DataFrame, text_col: str, common: np.ndarray) -> DataFrame:
    """(node, runs, tables, fine, lead, common) a row with words: node is the first 64 bits of the text's digest, runs how
    many distinct runs it has, tables a long of sampled coordinates for each table, fine eight
    longs, lead its leading runs, common how many of these are in ``common``."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # MOST_OFTEN rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse_signs, fine_signs, at = _signs(COARSE, 1), _signs(FINE, 2), sampled()
        weights = 1 << np.arange(SAMPLED - 1, -1, -1, dtype=np.int64)
        for b in pieces(batches, 0):
            texts = {short(_md5(x)): x for x in b.column(0).to_pylist()}  # copies in a piece are sketched once
            names = list(texts)
            for lo in range(0, len(names), 200):
                part = names[lo : lo + 200]
                found = [features(texts[x]) for x in part]
                # whole numbers below 2^24: the sums are exact, so equal texts have equal prints
                coarse = np.stack([_counts(w) for w, _ in found]) @ coarse_signs > 0
                fine = np.stack([_counts(r) for _, r in found]) @ fine_signs > 0
                tables = coarse[:, at] @ weights
                leads = [leading(r.view(np.int64), shared.value, SIMILARITY) for _, r in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.int64()),
                        pa.array([len(r) for _, r in found], pa.int64()),
                        pa.array(list(tables), pa.list_(pa.int64())),
                        pa.array(list(np.packbits(fine, axis=1).view(np.int64)), pa.list_(pa.int64())),
                        pa.array([x for x, _ in leads], pa.list_(pa.int64())),
                        pa.array([c for _, c in leads], pa.int32()),
                    ],
                    names=["node", "runs", "tables", "fine", "lead", "common"],
                )

    return docs.select(text_col).mapInArrow(run, "node bigint, runs bigint, tables array<bigint>, fine array<bigint>, lead array<bigint>, common int").where("runs > 0")


def estimate(a: str, b: str) -> Column:
    """The similarity that the fine prints of two sketches stand for: their distance gives the cosine of the
    sets of runs, and this with their sizes gives the part they share."""
    differ = sum((F.bit_count(F.col(f"{a}_fine")[i].bitwiseXOR(F.col(f"{b}_fine")[i])) for i in range(FINE // 64)), F.lit(0))
    n, m = F.col(f"{a}_runs").cast("double"), F.col(f"{b}_runs").cast("double")
    shared = F.cos(differ * F.lit(float(np.pi) / FINE)) * F.sqrt(n * m)
    return shared / (n + m - shared)


def _texts_of(docs: DataFrame, text_col: str, ids: DataFrame) -> DataFrame:
    """(node, held) of the texts whose nodes are in column id, and of a few others: the compressed text."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            texts = {short(_md5(x)): x for x in b.column(0).to_pylist()}
            nodes = np.array(list(texts), np.int64)
            some = [int(x) for x in nodes[passes(shared.value, nodes)]]
            held = [zlib.compress((texts[x] or "").encode("utf-8", "surrogatepass"), 1) for x in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held, pa.binary())], names=["node", "held"])

    return docs.select(text_col).mapInArrow(run, "node bigint, held binary").groupBy("node").agg(F.first("held").alias("held"))


def _runs(held: bytes) -> np.ndarray:
    return np.sort(features(zlib.decompress(held).decode("utf-8", "surrogatepass"))[1].view(np.int64))


def bits_used(texts: int) -> int:
    """How many sampled bits a bucket has before it is split: random buckets then have a text or two at any size.
    What fewer or more bits find is a matter of cost only, as the exact pass finds the rest."""
    return min(SAMPLED, max(8, int(np.ceil(np.log2(max(2, texts)))) + 1))


def split(spots: np.ndarray, used: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (i, j), i < j, of sorted ``spots`` (a table's number above ``SAMPLED`` bits): all pairs of each
    bucket of ``used`` bits that has at most ``cap`` rows; a larger one is split by one more bit, and so on; rows
    that agree on all bits and are more than ``cap`` meet the first of them."""
    n = len(spots)
    group, open_, first = np.full(n, -1), np.ones(n, bool), np.zeros(n, np.int64)
    for bits in range(used, SAMPLED + 1):
        prefix = spots >> (SAMPLED - bits)
        starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])[:n])
        sizes = np.diff(np.append(starts, n))
        first = np.repeat(starts, sizes)
        small = open_ & (np.repeat(sizes, sizes) <= cap)
        group[small] = first[small] + n * bits
        open_ &= ~small
        if not open_.any():
            break
    left, right = [], []
    for k in range(1, min(cap, n)):
        i = np.flatnonzero((group[k:] == group[:-k]) & (group[k:] >= 0))
        left.append(i)
        right.append(i + k)
    rest = np.flatnonzero(open_)
    rest = rest[first[rest] != rest]
    left.append(first[rest])
    right.append(rest)
    return np.concatenate(left), np.concatenate(right)


def _sampled_pairs(texts: DataFrame, n: int) -> DataFrame:
    """Candidate pairs (a, b), a < b, of nodes: the rows of all tables, sorted over the cluster, are cut into
    buckets run by run; a bucket at the edge of a run is cut by it."""
    used, cap = bits_used(n), CAP
    rows = texts.select("node", F.posexplode("tables").alias("table", "bits")).select("node", (F.shiftleft(F.col("table").cast("long"), SAMPLED) + F.col("bits")).alias("spot"))
    rows = rows.repartitionByRange("spot", "node").sortWithinPartitions("spot", "node").select("node", "spot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut() -> pa.RecordBatch:
            nodes, spots = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            i, j = split(spots, used, cap)
            a, b = nodes[i], nodes[j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= RUN:
                yield cut()
                held = []
        if held:
            yield cut()

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _links(docs: DataFrame, texts: DataFrame, n: int, text_col: str, scratch: Scratch) -> DataFrame:
    """(node, root): the components of all links between texts, written. Of texts (one a node) those
    with words have links."""
    sizes = texts.select("node", F.col("runs").alias("n"))

    def sets(ids: DataFrame) -> DataFrame:
        return _texts_of(docs, text_col, ids)

    pairs = _sampled_pairs(texts, n)
    for x in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(x), F.col("runs").alias(f"{x}_runs"), F.col("fine").alias(f"{x}_fine")), x)
    pairs = scratch.put(pairs.where(estimate("a", "b") >= SIMILARITY - SLACK).select("a", "b"))
    roots = scratch.put(components(verified(pairs, sizes, sets, _runs, SIMILARITY, scratch), scratch))
    rows = texts.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("runs").alias("n"), "lead", "common")
    rest = verified(alike(rows, SIMILARITY, scratch), sizes, sets, _runs, SIMILARITY, scratch)
    return joined_roots(roots, rest, scratch)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, class_id (the least id of its class), kept, class_size and text_md5.

    A class holds equal texts and texts linked by a similarity of at least 0.8 (Jaccard, runs of five
    words), directly or through others. One row of each class is kept: the one with the least (id,
    digest), null ids last; if rows repeat it, all of these are marked. A null text is empty, and
    texts without words are a class if equal. Texts are told apart by 64 bits of their digest. Other columns are ignored.
    """
    scratch, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)  # what the result reads stays
    common = frequent_runs(docs, text_col, docs.count())
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"))
    rows = kept.put(rows.withColumn("node", F.conv(F.substring("key", 1, 16), 16, -10).cast("long")))
    columns = ("runs", "tables", "fine", "lead", "common")
    texts = scratch.put(sketch(docs, text_col, common).groupBy("node").agg(*[F.first(c).alias(c) for c in columns]))
    roots = kept.put(_links(docs, texts, texts.count(), text_col, scratch))
    scratch.drop()
    heads = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key")).alias("least"), F.count("*").alias("rows"))
    heads = kept.put(heads.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "rows"))
    tops = heads.groupBy("root").agg(F.min("least").alias("head"), F.sum("rows").alias("class_size"))
    heads = kept.put(salted_join(heads.select("node", "root"), "root", "node", tops).select("node", "head", "class_size"))
    rows = salted_join(rows, "node", "id", heads)
    is_kept = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))
    return rows.select(F.col("id").alias("doc_id"), F.col("head.id").alias("class_id"), is_kept.alias("kept"), "class_size", F.col("key").alias("text_md5"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``classes`` keeps; of rows equal in id and text the one with the least hash of all
    its columns. A null text counts as empty, so of null and empty texts one row stays."""
    i, m, r = (free_name(docs, x) for x in ("near_id", "near_md5", "near_row"))
    kept = classes(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(i), F.col("text_md5").alias(m)).distinct()
    rows = docs.withColumn(r, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = rows.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.col(r) == F.col(m)))
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = rows.groupBy(i, m).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias(r))
    return one.select(f"{r}.*")
