"""License scans by ordered signature rules.

A text becomes lower-case words. Hand-written patterns (``license_rules``), each gated by its longest literal,
propose detections; one that lies within another's words is suppressed if the other has a higher
priority, or the same and is longer, or as long and of an earlier rule. Base phrases are found in any
case and never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import pieces
from .license_rules import RULES

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def literals(parsed: _parser.SubPattern) -> list[str]:
    """Strings that each match of a parsed pattern holds."""
    out = [""]
    for op, arg in parsed:
        if op is _parser.LITERAL:
            out[-1] += chr(arg)
            continue
        if op is _parser.SUBPATTERN:
            out += literals(arg[3])
        elif op is _parser.MAX_REPEAT and arg[0]:
            out += literals(arg[2])
        out.append("")
    return out


_PATTERNS = [(label, priority, max(literals(_parser.parse(p)), key=len), re.compile(rf"(?<= )(?:{p})(?= )")) for label, priority, patterns in RULES for p in patterns]
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,start:int,end:int,priority:int>>"


def words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z: runs of digits, letters a-z and all characters from U+0080 on."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_WORD).split()


def _places(line: str, phrase: str) -> list[int]:
    out, at = [], line.find(f" {phrase} ")
    while at >= 0:
        out.append(at)
        at = line.find(f" {phrase} ", at + 1)
    return out


def scan(text: str | None) -> tuple:
    """(words, base places as (word, label), detections as (label, first word, end word, priority)) of a text."""
    found = words(text)
    line = f" {b' '.join(found).decode('utf-8', 'surrogatepass')} "
    base = sorted((line.count(" ", 0, at + 1) - 1, label) for phrase, label in BASE.items() for at in _places(line, phrase))
    hits: set[tuple] = set()
    keyed: dict[str, bool] = {}
    for i, (label, priority, literal, pattern) in enumerate(_PATTERNS):
        if literal not in keyed:
            keyed[literal] = literal in line
        if keyed[literal]:
            for m in pattern.finditer(line):
                start = line.count(" ", 0, m.start()) - 1
                hits.add((start, start + 1 + m.group().count(" "), priority, i, label))
    return len(found), base, _outermost(hits)


def _outermost(hits: set[tuple]) -> list[tuple]:
    """Without the detections that lie within one that outranks them. In order of rank, each asks for the
    largest end among those kept that start no later: a tree of prefix maxima over starts."""
    kept: list[tuple] = []
    starts = {s: i + 1 for i, s in enumerate(sorted({h[0] for h in hits}))}
    best = [0] * (len(starts) + 1)
    for start, end, priority, rule, label in sorted(hits, key=lambda h: (-h[2], h[0] - h[1], h[3], h[0])):
        i, reach = starts[start], 0
        while i:
            reach, i = max(reach, best[i]), i & (i - 1)
        if reach < end:
            kept.append((label, start, end, priority))
            i = starts[start]
            while i < len(best):
                best[i] = max(best[i], end)
                i += i & -i
    return sorted(kept)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    A null text is empty: no words, no labels, score 0. Nulls in the id are kept, other columns ignored,
    repeated rows scanned as often as they occur; whole texts are read. The score is 1 with a base
    place, else the best priority over 100."""
    fields = [x.split()[0] for x in SCHEMA.split(", ")]
    cell = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32())]))
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), cell]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, base, hits = scan(text.as_py())
                labels = {x for _, x in base}
                score = 1.0 if base else max((h[3] / 100 for h in hits), default=0.0)
                at = [w for w, _ in base]
                rows.append((doc, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {h[0] for h in hits})), score, [dict(zip(("label", "start", "end", "priority"), h, strict=True)) for h in hits]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types, strict=True)], names=fields)

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
