"""Hierarchical multi-length packing of documents into token sequences.

A document's ids are cut into full windows of the largest length, each a sequence of its own; the rest
is routed to the least of several context-size tiers that holds it. Each tier is packed on its own
(best fit over the windows that are open, a bounded number); a window that nothing fits is filled up
to its length with the front of a piece from the longest shorter tier that has one waiting. Windows
have power-of-two lengths, so a full one needs no padding; what is open when a partition ends is cut
at powers of two where that pads less. Sequences are dealt to step groups that hold like numbers of
tokens.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import pieces

END = 0
TIERS = (1024, 512, 256, 128)
OPEN = 64
GROUP_TOKENS = 1 << 16
GROUPS = 4  # step groups that are filled side by side
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint, step_group bigint"


def _bytes_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character; this maps them back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_plain(said: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE whose merges are its ids in order: tiktoken can run these."""
    model, before = said["model"], said.get("pre_tokenizer") or {}
    same = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or said.get("normalizer") or any(before.get(k) != v for k, v in same.items()) or any(model.get(k) for k in odd):
        return False
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [model["vocab"].get(m, -1) for m in joined]
    singles = {model["vocab"].get(c, -1) for c in _bytes_of()}
    return -1 not in singles and all(a < b for a, b in zip([max(singles), *ids], ids)) and len(model["vocab"]) <= 256 + len(ids) + len(said["added_tokens"])


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text under a tokenizer file, as the tokenizers library gives them without special tokens. If
    the file is a plain byte-level BPE the faster tiktoken runs it; a text in which the name of an added
    token occurs, and any text under another kind of file, goes to tokenizers itself."""
    import tiktoken

    made = vars(tiktoken).setdefault("_byte_level_encoders", {})  # for the next task of this worker
    if path in made:
        return made[path]
    with open(path) as f:
        said = json.load(f)
    if not is_plain(said):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        made[path] = lambda text: whole.encode(text, add_special_tokens=False).ids
        return made[path]
    back = _bytes_of()
    added = [x["content"] for x in said["added_tokens"]]
    ranks = {bytes(back[c] for c in k): v for k, v in said["model"]["vocab"].items() if k not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def slow(text: str) -> list[int]:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        if any(x in text for x in added):
            return slow(text)
        return fast.encode_ordinary(text)

    made[path] = encode
    return encode


class Packer:
    """Packs the rests of one partition. Keeps at most ``OPEN`` open windows a tier and ``OPEN`` waiting
    pieces a tier; emits rows (piece..., sequence, offset) once a window is closed."""

    def __init__(self, tiers: tuple[int, ...], first_sequence: int):
        self.tiers = sorted(tiers, reverse=True)
        self.open: dict[int, list[list]] = {t: [] for t in self.tiers}  # [room, pieces]
        self.waiting: dict[int, list[tuple]] = {t: [] for t in self.tiers}  # pieces, longest last
        self.next = first_sequence
        self.groups = {first_sequence + i: 0 for i in range(GROUPS)}  # tokens of the open step groups

    def close(self, pieces: list[tuple], length: int) -> list[tuple]:
        group = min(self.groups, key=lambda g: (self.groups[g], g))
        if self.groups[group] + length > GROUP_TOKENS:  # the others have no more room either, or less than a sequence
            group = max(self.groups) + 1
            self.groups = {group + i: 0 for i in range(GROUPS)}
        self.groups[group] += length
        out, at = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, length, group))
            at += len(ids)
        self.next += 1
        return out

    def add(self, doc, ids: array, total: int) -> Iterator[tuple]:
        top, at = self.tiers[0], 0
        while len(ids) - at >= top:
            yield from self.close([(doc, at, ids[at : at + top], total)], top)
            at += top
        if at < len(ids):
            rest = (doc, at, ids[at:], total)
            tier = min(t for t in self.tiers if t >= len(rest[2]))
            self.waiting[tier].append(rest)
            if len(self.waiting[tier]) >= OPEN:
                yield from self.pack(tier)

    def pack(self, tier: int) -> Iterator[tuple]:
        """Best fit, longest first, of what waits in a tier; then the fullest windows are filled and closed."""
        opened = self.open[tier]
        for piece in sorted(self.waiting[tier], key=lambda p: -len(p[2])):
            fits = [w for w in opened if w[0] >= len(piece[2])]
            window = min(fits, key=lambda w: w[0]) if fits else None
            if window is None:
                opened.append(window := [tier, []])
            window[0] -= len(piece[2])
            window[1].append(piece)
        self.waiting[tier] = []
        opened.sort(key=lambda w: w[0])
        while opened and (not opened[0][0] or len(opened) > OPEN // 8):
            room, pieces = opened.pop(0)
            self.fill(room, pieces, tier)
            left = tier - sum(len(p[2]) for p in pieces)
            if left:  # nothing shorter waits: the last window gives its front
                self.borrow(left, pieces, opened)
            yield from self.close(pieces, tier)

    def fill(self, room: int, pieces: list[tuple], tier: int) -> None:
        for t in self.tiers:
            while room and t < tier and self.waiting[t]:
                room -= self.take(self.waiting[t], room, pieces)

    @staticmethod
    def take(source: list[tuple], room: int, pieces: list[tuple]) -> int:
        doc, start, ids, total = source.pop()
        pieces.append((doc, start, ids[:room], total))
        if len(ids) > room:
            source.append((doc, start + room, ids[room:], total))
            return room
        return len(ids)

    def borrow(self, room: int, pieces: list[tuple], opened: list[list]) -> None:
        while room and opened:
            before = room
            room -= self.take(opened[-1][1], room, pieces)
            opened[-1][0] += before - room
            if not opened[-1][1]:
                opened.pop()

    def finish(self) -> Iterator[tuple]:
        """All that is left, in one run: full windows of the largest length, then powers of two."""
        left = [p for t in self.tiers for w in self.open[t] for p in w[1]] + [p for t in self.tiers for p in self.waiting[t]]
        left.reverse()
        tokens = sum(len(p[2]) for p in left)
        while tokens:
            top = self.tiers[0]
            length = top if tokens >= top else 1 << (tokens.bit_length() - 1)
            pieces, room = [], length
            while room:
                room -= self.take(left, room, pieces)
            tokens -= length
            yield from self.close(pieces, length)


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: document, start and length in its ids (text ids, then ``END``), checksum of the
    piece's ids, the document's ids, sequence, offset in it, the sequence's length and its step group.

    Each partition is packed by itself while its documents stream by, with no shuffle and a bounded
    number of pieces held, so a lost executor's partitions are packed again alike. A sequence id is the
    partition's number times 2^32 plus a count. A null or empty text has one id, ``END``; a null id
    stays null; repeated rows are packed as often as they occur; other columns are ignored; an
    empty table gives no rows. A very long text only adds full windows.
    """
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tier lengths are powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        packer = Packer(tiers, TaskContext.get().partitionId() << 32)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(names))], names=names)

        rows: list[tuple] = []
        for b in pieces(batches, 1):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(END)
                rows.extend(packer.add(doc, ids, len(ids)))
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.finish())
        yield batch(rows)

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
