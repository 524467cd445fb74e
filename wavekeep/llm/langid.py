"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes holds how often each byte followed each context
of up to ``ORDER`` bytes. A byte that was not seen after a context costs an escape (its probability is the number
of distinct bytes seen there over that number plus all occurrences) and is coded under the next shorter
context, down to a uniform one. Statistics are frozen after training, so the exact code length of each
(context, byte) is a constant. The trees are held as tables by depth, of the contexts and of the (context, byte)
that any language has seen, with a column a language; what none has seen is the escape of its context and
the length under the shorter one. A text's code length is the sum over its bytes, ASCII capitals as small letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, pieces

ORDER = 3
#: Bounds of the training sample: so many distinct labelled texts a language, of each so many characters, and so many
#: languages, those with the most rows.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 30_000
MOST_LANGS = 1024
UND = "und"
#: Numbers (bytes of text times languages) that are looked up at once.
CHUNK = 1 << 21
_START = b" " * ORDER
_LOWER = bytes(range(256)).lower()
_LATIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is in the text."""
    return not _LATIN.isdisjoint(text[:64]) or any(map(str.isalpha, text))


class Table:
    """Rows of numbers by a key below 2^32: open addressing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        size = 16
        while size < 2 * len(keys):
            size *= 2
        self.rows = np.vstack([rows, np.zeros((1, rows.shape[1]), np.float32)])
        self.shift, self.last = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys, self.at = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        todo, step = np.arange(len(keys)), 0
        keys = keys.astype(np.uint64)
        while len(todo):
            spot = (self._spot(keys[todo]) + step) & self.last
            free = np.flatnonzero(self.at[spot] < 0)
            _, first = np.unique(spot[free], return_index=True)
            put = free[first]
            self.keys[spot[put]], self.at[spot[put]] = keys[todo[put]], todo[put]
            todo, step = np.delete(todo, put), step + 1

    @classmethod
    def of(cls, state: dict) -> Table:
        out = cls.__new__(cls)
        out.__dict__ = state
        return out

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 (a row of zeros) for a key that isn't there."""
        keys = keys.astype(np.uint64)
        spot = self._spot(keys)
        at = self.at[spot]
        todo = np.flatnonzero((at >= 0) & (self.keys[spot] != keys))
        while len(todo):
            spot[todo] = (spot[todo] + 1) & self.last
            at[todo] = self.at[spot[todo]]
            todo = todo[(at[todo] >= 0) & (self.keys[spot[todo]] != keys[todo])]
        return at


@dataclass
class Model:
    """grams[o]: bits of a byte after a context of o bytes, by these o + 1 bytes; escapes[o]: bits of the
    escape from a context. ``bytewise`` has those of a byte without context."""

    langs: list[str]
    bytewise: np.ndarray
    grams: dict[int, Table]
    escapes: dict[int, Table]

    def plain(self) -> tuple:
        """The model without classes of this package, as it travels to workers that may lack it."""
        return self.langs, self.bytewise, *[{o: vars(t) for o, t in x.items()} for x in (self.grams, self.escapes)]

    @classmethod
    def of(cls, langs: list[str], bytewise: np.ndarray, grams: dict, escapes: dict) -> Model:
        return cls(langs, bytewise, *[{o: Table.of(t) for o, t in x.items()} for x in (grams, escapes)])

    def bits(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """(bytes, languages): of each byte, given as itself after ``order`` bytes before it."""
        if not order:
            return self.bytewise[grams]
        table = self.grams[order]
        at = table.find(grams)
        out = table.rows[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            escape = self.escapes[order]
            out[new] = escape.rows[escape.find(grams[new] >> 8)] + self.bits(grams[new] & ((1 << 8 * order) - 1), order - 1)
        return out


def _grams(data: np.ndarray) -> np.ndarray:
    """Each byte but the first ORDER after the ORDER bytes before it, as one number."""
    out = np.zeros(len(data) - ORDER, np.int64)
    for i in range(ORDER + 1):
        out = out << 8 | data[i : len(data) - ORDER + i]
    return out


class _Tree:
    """One language's counts as sorted arrays by order."""

    def __init__(self, texts: list[str]):
        parts = [np.frombuffer(_START + x.encode("utf-8", "replace").translate(_LOWER), np.uint8) for x in texts]
        every = np.concatenate([_grams(x) for x in parts] or [np.zeros(0, np.int64)])
        self.grams, self.seen, self.contexts, self.escape = {}, {}, {}, {}
        for o in range(ORDER + 1):
            grams, counts = np.unique(every & ((1 << 8 * (o + 1)) - 1), return_counts=True)
            contexts, of, distinct = np.unique(grams >> 8, return_inverse=True, return_counts=True)
            whole = np.bincount(of, weights=counts, minlength=len(contexts)) + distinct
            self.grams[o], self.seen[o] = grams, -np.log2(counts / whole[of])
            self.contexts[o], self.escape[o] = contexts, -np.log2(distinct / whole)

    @staticmethod
    def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))

    def escapes(self, contexts: np.ndarray, order: int) -> np.ndarray:
        at, has = self._at(self.contexts[order], contexts)
        out = np.zeros(len(contexts))
        out[has] = self.escape[order][at[has]]
        return out

    def bits(self, grams: np.ndarray, order: int) -> np.ndarray:
        if order < 0:
            return np.full(len(grams), 8.0)
        at, has = self._at(self.grams[order], grams)
        out = np.zeros(len(grams))
        out[has] = self.seen[order][at[has]]
        new = grams[~has]
        if len(new):
            out[~has] = self.escapes(new >> 8, order) + self.bits(new & ((1 << 8 * order) - 1), order - 1)
        return out


def train(texts: dict[str, list[str]]) -> Model:
    """A model from texts by language; languages in sorted order."""
    langs = sorted(texts)
    trees = [_Tree(texts[k]) for k in langs]
    column = lambda rows, n: np.stack(rows, 1).astype(np.float32) if rows else np.zeros((n, 0), np.float32)
    grams, escapes = {}, {}
    for o in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([t.grams[o] for t in trees] or [np.zeros(0, np.int64)]))
        grams[o] = Table(keys, column([t.bits(keys, o) for t in trees], len(keys)))
        keys = np.unique(np.concatenate([t.contexts[o] for t in trees] or [np.zeros(0, np.int64)]))
        escapes[o] = Table(keys, column([t.escapes(keys, o) for t in trees], len(keys)))
    return Model(langs, column([t.bits(np.arange(256), 0) for t in trees], 256), grams, escapes)


def code_lengths(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of each text under each language. data: bytes of all texts, side by side; a text begins after
    spaces. Works through chunks, so memory is bounded."""
    out = np.zeros((len(starts), len(model.langs)))
    if not len(starts) or not model.langs:
        return out
    base = int(starts[0])
    data = np.frombuffer(_LOWER, np.uint8)[data[base : int(ends[-1])]]
    sizes, step = (ends - starts).astype(np.int64), max(1, CHUNK // len(model.langs))
    of = np.repeat(np.arange(len(starts)), sizes)
    since = np.arange(len(data)) - np.repeat(starts - base, sizes)  # bytes of its text before each byte
    for lo in range(0, len(data), step):
        hi = min(lo + step, len(data))
        grams = np.zeros(hi - lo, np.int64)
        for back in range(ORDER, -1, -1):
            before = data[np.maximum(np.arange(lo, hi) - back, 0)]
            grams = grams << 8 | np.where(since[lo:hi] >= back, before, 32)
        bits = model.bits(grams)
        first = np.flatnonzero(np.concatenate([[True], of[lo + 1 : hi] != of[lo : hi - 1]]))
        np.add.at(out, of[lo:hi][first], np.add.reduceat(bits, first, axis=0, dtype=np.float64))
    return out


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trains on rows with a language that are not held out.

    Per language the sample is the distinct texts with the least hash, at most ``SAMPLE_DOCS``, of each the first
    ``SAMPLE_CHARS`` characters. Distinct texts are counted by language first (approximately), so that only about
    that many come to the driver from any input; of more than ``MOST_LANGS`` languages those with the most are learned."""
    share = F.shiftrightunsigned(F.xxhash64(text_col), 11).cast("double") / F.lit(float(1 << 53))
    usable = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & (F.length(text_col) >= 1)).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), share.alias("h"))
    found = usable.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "l").limit(MOST_LANGS)
    counts = {r["l"]: r["n"] for r in found.collect()}  # a row a language
    if not counts:
        return train({})
    part = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.4 * SAMPLE_DOCS / n + 40 / n)))]), F.col("l"))
    rows = usable.where(F.col("h") < part).dropDuplicates(["l", "h"]).select("l", "h", F.substring("t", 1, SAMPLE_CHARS).alias("t"))
    texts: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r["l"], r["h"])):
        if len(texts[r["l"]]) < SAMPLE_DOCS:
            texts[r["l"]].append(r["t"])
    return train({k: v for k, v in texts.items() if v})


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1: the weight of the language when
    each gets 2 ^ -(bits above the best, at most 64 bytes' worth of the mean).

    A null text, one without a letter (Unicode category L) and, with no language learned, any text is ``und`` with score 0.
    Whole texts are read, in chunks; other columns and repeated rows are kept as they are; new columns get
    underscores in front if their names are taken."""
    pred, score = free_name(docs, out[0]), free_name(docs, out[1])
    model_of = docs.sparkSession.sparkContext.broadcast(model.plain())  # bounded by the sample
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(*model_of.value)
        for b in pieces(batches, at):
            text = b.column(at).cast(pa.large_string())
            known = np.array([bool(m.langs) and x is not None and has_letter(x) for x in text.to_pylist()], bool)
            langs, scores = np.full(len(text), UND, object), np.zeros(len(text))
            if known.any():
                some = text.filter(pa.array(known))
                ends = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
                bits = code_lengths(m, np.frombuffer(some.buffers()[2], np.uint8), ends[:-1], ends[1:])
                size = np.maximum(ends[1:] - ends[:-1], 1)[:, None]
                above = (bits - bits.min(1, keepdims=True)) / size * np.minimum(size, 64)
                weight = np.exp2(-above)
                langs[known] = np.array(m.langs, object)[bits.argmin(1)]
                scores[known] = 1 / weight.sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*b.schema.names, pred, score])

    return docs.mapInArrow(run, docs.limit(0).withColumn(pred, F.lit(UND)).withColumn(score, F.lit(0.0)).schema)
