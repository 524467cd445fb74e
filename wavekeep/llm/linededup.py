"""Line dedup: equal and nearly equal lines leave one line of each group in the whole corpus.

Equal lines are found by digest. For nearly equal ones each line gets a one-permutation MinHash
signature of its character shingles (windows of ``SHINGLE`` UTF-8 bytes), cut into bands; lines that
agree on a band are candidates, verified by the exact Jaccard similarity of their shingles, and joined by
distributed union-find. Of a large bucket a line first meets a few others only; its lines that are not
linked by then meet again if they share one of their rarest shingles, which leaves out no similar pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import MOST_HOT, Scratch, alike, components, free_name, id_filter, joined_roots, leading, often, passes, pieces, salted_join, sample, verified

SHINGLE = 8
LEAST_SHINGLES = 4  # below, two different lines can't reach the similarity
SIMILARITY = 0.8
BANDS, ROWS = 8, 4
BINS = BANDS * ROWS
CHUNK = 1 << 15  # bytes of lines handled at once: arrays of eight bytes for each stay in the cache
#: Lines whose sketches a task remembers having sent.
REMEMBERED = 1 << 20
NEAR = 7  # rows of a band bucket before a line that it meets; a bucket of up to one more has all its pairs
FLUSH = 1 << 16  # lines of which a task deals the rows of all bands out at once
PART = 1 << 18  # rows of buckets that are sorted at once, on average
SAMPLED = 64  # of as many lines one tells which buckets are hot
SPLIT = 1 << 13  # rows of a hot bucket that stay together
BLANK = " \t\r\x0b\x0c"
SAMPLE, SHARE = 20_000, 1 / 4  # lines of which the frequent shingles are learned, and their least part of all
_MIX = np.uint64(0x9E3779B97F4A7C15)


def name(line: bytes) -> int:
    """A line's name in joins: the hash that Spark's xxhash64 gives."""
    h = xxhash.xxh64_intdigest(line, 42)
    return h - (1 << 64) if h >> 63 else h


def windows(data: np.ndarray) -> np.ndarray:
    """The shingle that starts at each byte but the last seven, as a number."""
    n = max(0, len(data) - SHINGLE + 1)
    return np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64) if n else np.zeros(0, np.uint64)


def _crossing(sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of the first ``n`` windows of joined lines reach beyond their line's end."""
    ends = np.cumsum(sizes)
    at = (ends[:, None] - np.arange(1, SHINGLE))[np.arange(1, SHINGLE) <= sizes[:, None]]
    return at[at < n]


def bands(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS) band keys of lines of at least ``SHINGLE`` bytes."""
    data = np.frombuffer(b"".join(lines), np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h = windows(data)
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    none = np.uint32(0xFFFFFFFF)
    least = (h & np.uint64(0xFFFFFFFE)).astype(np.uint32)
    least[_crossing(sizes, len(h))] = none
    sig = np.full(len(lines) * BINS, none, np.uint32)
    h >>= np.uint64(59)
    np.minimum.at(sig, np.repeat(np.arange(0, len(sig), BINS), sizes)[: len(h)] + h.view(np.int64), least)
    sig = sig.reshape(-1, BINS)
    rows = np.flatnonzero((sig == none).any(1))
    part = np.tile(sig[rows], 2)  # an empty bin takes what the next one that is not empty has
    after = np.where(part == none, 2 * BINS - 1, np.arange(2 * BINS))
    after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    sig[rows] = np.take_along_axis(part, after, 1)
    out = np.zeros((len(lines), BANDS), np.uint64)
    for i in range(ROWS):
        out = (out + sig.reshape(-1, BANDS, ROWS)[:, :, i]) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _marked(lines: list[bytes]) -> np.ndarray:
    """The distinct shingles of each line, sorted: 52 mixed bits of a shingle below 12 of its line's place. A
    line shorter than a shingle has none."""
    data = np.frombuffer(b"".join(lines), np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h = windows(data) * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h >>= np.uint64(12)
    h |= np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(52), sizes)[: len(h)]
    marked = np.sort(np.delete(h, _crossing(sizes, len(h))))
    return marked[np.concatenate([[True], marked[1:] != marked[:-1]])] if len(marked) else marked


def jaccard(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """The similarity of the shingle sets of each x and y, at most 4096 at once; where one has none, whether they are equal."""
    if len(xs) > 1 << 12:
        raise ValueError("too many pairs at once")
    x, y = _marked(xs), _marked(ys)
    both = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs are merged
    shared = both[:-1][both[1:] == both[:-1]]
    n, m, k = (np.bincount((v >> np.uint64(52)).astype(np.int64), minlength=len(xs)) for v in (x, y, shared))
    equal = np.fromiter((a == b for a, b in zip(xs, ys, strict=True)), bool, len(xs))
    return np.where((n > 0) & (m > 0), k / np.maximum(n + m - k, 1), equal)


def _distinct_lines(texts: list) -> dict[bytes, None]:
    out: dict[bytes, None] = {}
    for x in texts:
        if x:
            out.update(dict.fromkeys(x.encode("utf-8", "surrogatepass").split(b"\n")))
    return out


def _sketches(docs: DataFrame, text_col: str) -> DataFrame:
    """(n, lines, buckets, some) of blocks of n lines of at least LEAST_SHINGLES shingles: their ``name`` and, for each of their
    bands, an even number, as little-endian longs; some: these numbers of one in ``SAMPLED`` lines. A task sends a line
    once as a rule, so the same line comes from each task at most a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in pieces(batches, 0):
            found = {name(x): x for x in _distinct_lines(b.column(0).to_pylist()) if len(x) >= SHINGLE + LEAST_SHINGLES - 1}
            names = [k for k in found if k not in sent]
            lines, at, keys = [found[k] for k in names], 0, []
            sent.update(names)
            if len(sent) > REMEMBERED:
                sent.clear()
            while at < len(lines):
                end, size = at + 1, len(lines[at])
                while end < len(lines) and size + len(lines[end]) <= CHUNK:
                    size, end = size + len(lines[end]), end + 1
                keys.append(bands(lines[at:end]))
                at = end
            if not lines:
                continue
            buckets, ids = bucketed(np.concatenate(keys)), np.array(names, np.int64)
            some = pa.array([buckets[ids % SAMPLED == 0].ravel()], pa.list_(pa.int64()))
            blobs = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (ids, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), *blobs, some], names=["n", "lines", "buckets", "some"])

    return docs.select(text_col).mapInArrow(run, "n bigint, lines binary, buckets binary, some array<bigint>")


def bucketed(keys: np.ndarray) -> np.ndarray:
    """(lines, BANDS) buckets of band keys: even numbers, other ones in each band."""
    mixed = (keys.view(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(0xFFFFFFFFFFFFFFFE)).view(np.int64)


def split_hot(buckets: np.ndarray, lines: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """``buckets``, but odd numbers for those in ``hot`` (two rows: buckets in order, and into how many each is split): a line is
    in the same part of a hot bucket whatever task has it."""
    if not hot.shape[1]:
        return buckets
    at = np.minimum(np.searchsorted(hot[0], buckets), hot.shape[1] - 1)
    rows = np.flatnonzero(hot[0][at] == buckets)
    key, h = buckets[rows].view(np.uint64), (lines[rows] ^ buckets[rows]).view(np.uint64) * _MIX
    h ^= h >> np.uint64(32)
    part = (h * _MIX >> np.uint64(32)) % hot[1][at[rows]].astype(np.uint64)
    h = (key + (part + np.uint64(1)) * _MIX) * np.uint64(0xD6E8FEB86659FD93)
    out = buckets.copy()
    out[rows] = ((h ^ (h >> np.uint64(32))) | np.uint64(1)).view(np.int64)
    return out


def near_rows(buckets: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lines of sorted ``buckets``: each row with the ``NEAR`` before it and with the first of its bucket. Of
    buckets with more rows than that covers, and of those at the edges of the arrays, each line is also paired with itself:
    it may have partners that it did not meet. Repeated rows follow each other and count once."""
    new = np.concatenate([[True], (buckets[1:] != buckets[:-1]) | (lines[1:] != lines[:-1])])[: len(buckets)]
    buckets, lines = buckets[new], lines[new]
    n = len(buckets)
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])[:n])
    sizes = np.diff(np.append(starts, n))
    large = sizes > NEAR + 1
    large[[0, -1]] = True
    left, right = [], []
    for k in range(1, min(NEAR + 1, n)):
        i = np.flatnonzero(buckets[k:] == buckets[:-k])
        left.append(lines[i])
        right.append(lines[i + k])
    far = np.arange(n) - np.repeat(starts, sizes) > NEAR
    left.append(lines[np.repeat(starts, sizes)[far]])
    right.append(lines[far])
    marked = lines[np.repeat(large, sizes)]
    return np.concatenate([*left, marked]), np.concatenate([*right, marked])


def _banded(sketches: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a <= b, of lines. The rows (bucket, line) of all bands are dealt into parts by their bucket; they
    travel in blocks, a part's rows from ``FLUSH`` lines in one, and are sorted where they arrive. Buckets that a sample of the
    lines shows to be hot (a bounded list) are split by line, and each of their lines is paired with itself too."""
    parts = max(1, -(-BANDS * (sketches.agg(F.sum("n")).first()[0] or 0) // PART))
    often = sketches.select(F.explode("some").alias("bucket")).groupBy("bucket").count().where(F.col("count") > SPLIT // SAMPLED)
    hot = sorted((r[0], -(-r[1] * SAMPLED // SPLIT)) for r in often.orderBy(F.desc("count")).limit(MOST_HOT).collect())
    hot = np.array(hot, np.int64).reshape(-1, 2).T

    def dealt(lines: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
        lines = np.repeat(lines, BANDS)
        buckets = split_hot(buckets, lines, hot)
        part = ((buckets.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        part, lines, buckets = part[order], lines[order], buckets[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(starts[1:], len(part))
        blobs = [pa.array([x[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for x in (buckets, lines)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int64)), *blobs], names=["part", "buckets", "lines"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for n, lines, buckets in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                held.append((np.frombuffer(lines, "<i8", n), np.frombuffer(buckets, "<i8", n * BANDS)))
                if sum(len(x) for x, _ in held) >= FLUSH:
                    yield dealt(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield dealt(*map(np.concatenate, zip(*held, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []

        def cut() -> pa.RecordBatch:
            buckets, lines = (np.frombuffer(b"".join(x), np.int64) for x in zip(*held, strict=True))
            split = lines[buckets & 1 == 1]
            order = np.argsort(buckets)
            same = np.concatenate([[False], np.diff(buckets[order]) == 0, [False]])
            order = order[same[1:] | same[:-1]]  # a line alone in its bucket meets none
            buckets, lines = buckets[order], lines[order]
            order = np.lexsort((lines, buckets))
            a, b = near_rows(buckets[order], lines[order]) if len(order) else (lines, lines)
            pairs = np.sort(np.stack([np.concatenate([a, split]), np.concatenate([b, split])]), axis=0)
            pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
            pairs = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(0)])[: pairs.shape[1]]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        now = None
        for x in batches:
            for part, *rows in zip(*[x.column(i).to_pylist() for i in range(3)], strict=True):
                if part != now and held:
                    yield cut()
                    held.clear()
                now = part
                held.append(rows)
        if held:
            yield cut()

    rows = sketches.select("n", "lines", "buckets").mapInArrow(deal, "part bigint, buckets binary, lines binary")
    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "a bigint, b bigint").distinct()


def _texts_of(docs: DataFrame, text_col: str, ids: DataFrame) -> DataFrame:
    """(line, text) of the candidate lines, and a few others."""
    words = id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in pieces(batches, 0):
            lines = list(_distinct_lines(b.column(0).to_pylist()))
            key = np.array([name(x) for x in lines], np.int64)
            some = np.flatnonzero(passes(held, key))
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array([lines[i] for i in some], pa.binary())], names=["line", "text"])

    return docs.select(text_col).mapInArrow(run, "line bigint, text binary").groupBy("line").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, x, y) whose texts x and y are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            xs, ys, at, near = b.column(2).to_pylist(), b.column(3).to_pylist(), 0, [np.zeros(0, bool)]
            while at < len(xs):
                end, size = at + 1, len(xs[at])
                while end < len(xs) and end - at < 1 << 12 and size + len(xs[end]) <= CHUNK:
                    size, end = size + len(xs[end]), end + 1
                near.append(jaccard(xs[at:end], ys[at:end]) >= SIMILARITY)
                at = end
            keep = pa.array(np.concatenate(near))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _leads(texts: DataFrame, n: int) -> DataFrame:
    """(node, n, lead, common) of lines (line, text): their shingles for ``alike``. n: how many lines there are."""
    shared = texts.sparkSession.sparkContext.broadcast(often(sample(texts, "line", n, SAMPLE, SHARE).select("text"), _shingles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingles(x) for x in b.column(1).to_pylist()]
            leads = [leading(x, shared.value, SIMILARITY) for x in sets]
            columns = [pa.array(list(map(len, sets)), pa.int64()), pa.array([x for x, _ in leads], pa.list_(pa.int64())), pa.array([c for _, c in leads], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["node", "n", "lead", "common"])

    return texts.select("line", "text").mapInArrow(run, "node bigint, n bigint, lead array<bigint>, common int")


def _shingles(line: bytes) -> np.ndarray:
    """What ``_marked`` gives for this line alone."""
    h = windows(np.frombuffer(line, np.uint8)) * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h >>= np.uint64(12)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])].view(np.int64) if len(h) else h.view(np.int64)


def roots(docs: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """(node, root) of all lines that have a similar one, both as ``name``."""
    pairs = scratch.put(_banded(scratch.put(_sketches(docs, text_col))))
    texts = scratch.put(_texts_of(docs, text_col, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    joined = salted_join(pairs.where("a <> b"), "a", "b", texts.select(F.col("line").alias("a"), F.col("text").alias("x")))
    joined = joined.join(texts.select(F.col("line").alias("b"), F.col("text").alias("y")), "b")
    out = scratch.put(components(_verified(joined), scratch))
    large = pairs.where("a = b").select(F.col("a").alias("line"))
    n = large.count()
    if not n:
        return out
    some = scratch.put(texts.join(large, "line", "left_semi"))
    sets = scratch.put(_leads(some, n))
    rows = sets.join(out, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "lead", "common")
    held = some.select(F.col("line").alias("node"), F.col("text").alias("held"))
    rest = verified(alike(rows, SIMILARITY, scratch), sets.select("node", "n"), lambda ids: held.join(ids, held["node"] == ids["id"], "left_semi"), _shingles, SIMILARITY, scratch)
    return joined_roots(out, rest, scratch)


def _line_rows(docs: DataFrame, id_col: str, text_col: str, links: DataFrame) -> DataFrame:
    """(d, m, at, node, k, near): a document (id and hash of its text), the place of a line that is not blank, the first of its like
    there, its name, another hash of it, and whether it may be in ``links``."""
    rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("m"), F.col(text_col).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(links.select(F.col("node").alias("id"))))
    blank = BLANK.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in pieces(batches, 2):
            of, at, node, k = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                first: dict[bytes, int] = {}
                for place, line in enumerate(text.split(b"\n") if text else ()):
                    first.setdefault(line, place)
                for line, place in first.items():
                    if line.strip(blank):
                        of.append(i)
                        at.append(place)
                        node.append(xxhash.xxh64_intdigest(line, 42))
                        k.append(xxhash.xxh3_64_intdigest(line))
            docs_of, nodes = pa.array(of, pa.int64()), np.array(node, np.uint64).view(np.int64)
            hashed = [pa.array(nodes), pa.array(np.array(k, np.uint64).view(np.int64)), pa.array(passes(held, nodes))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(docs_of), b.column(1).take(docs_of), pa.array(at, pa.int32()), *hashed], names=["d", "m", "at", "node", "k", "near"])

    zero = F.lit(0).cast("bigint")
    return rows.mapInArrow(run, rows.select("d", "m", F.lit(0).alias("at"), zero.alias("node"), zero.alias("k"), F.lit(False).alias("near")).schema)


def kept_lines(docs: DataFrame, id_col: str, text_col: str, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, m, at): for each document (id and hash of its text) the places of the lines that it keeps. links: ``roots``."""
    rows = _line_rows(docs, id_col, text_col, links)
    # two hashes tell lines apart; the first is their name
    firsts = scratch.put(rows.groupBy("node", "k").agg(F.min(F.struct(F.col("d").isNull().alias("n"), "d", "m", "at")).alias("first"), F.max("near").alias("near")))
    linked = firsts.where("near").join(links, "node", "left").select(F.coalesce("root", "node").alias("node"), F.when(F.col("root").isNull(), F.col("k")).alias("k"), "first")
    linked = linked.groupBy("node", "k").agg(F.min("first").alias("first"))
    firsts = firsts.where("not near").select("first").unionByName(linked.select("first"))
    return firsts.groupBy("first.d", "first.m").agg(F.collect_list("first.at").alias("at"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the text reduced to the lines it keeps, and two more columns: its lines and those dropped.

    Of equal lines, and of lines linked by a Jaccard similarity of at least 0.8 directly or through
    others, the one in the least (id, hash of text, place) stays, null ids last. Empty lines and lines of spaces,
    tabs and other ASCII white space stay as they are. A null text stays null, with no lines. Of rows equal in id
    and text one (that with the least hash of all its columns) keeps the lines. Other columns are kept; new ones
    get underscores in front if their names are taken.
    """
    scratch = Scratch(docs.sparkSession)
    kept = kept_lines(docs, id_col, text_col, roots(docs, text_col, scratch), scratch)
    key, row, first, at = (free_name(docs, x) for x in ("line_key", "line_row", "line_first", "line_at"))
    lines, dropped = (free_name(docs, x) for x in counts)

    def keyed(i: str, h: str) -> Column:
        return F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("null")), F.col(h).cast("string"))

    kept = kept.select(keyed("d", "m").alias(key), F.col("at").alias(at))
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.withColumn(row, F.xxhash64(text_col)).withColumn(key, keyed(id_col, row)).withColumn(row, F.xxhash64(*hashed))
    rows = rows.join(kept, key, "left").withColumn(first, F.row_number().over(Window.partitionBy(key).orderBy(row)) == 1)
    rows = rows.select(*docs.columns, at, first)
    where = docs.columns.index(text_col)
    out = docs.limit(0).withColumn(lines, F.lit(0).cast("long")).withColumn(dropped, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, where):
            texts, n_lines, n_dropped = [], [], []
            for text, places, mine in zip(b.column(where), b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                text, places = text.as_py(), set(places.as_py() or ()) if mine.as_py() else set()
                if text is None:
                    texts.append(None)
                    n_lines.append(0)
                    n_dropped.append(0)
                    continue
                had = text.split("\n")
                has = [x for i, x in enumerate(had) if i in places or not x.strip(BLANK)]
                texts.append("\n".join(has))
                n_lines.append(len(had))
                n_dropped.append(len(had) - len(has))
            columns = [pa.array(texts, pa.string()) if i == where else b.column(i) for i in range(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[f.name for f in out.fields])

    return rows.mapInArrow(run, out)
