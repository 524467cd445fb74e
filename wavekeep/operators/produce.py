"""Producers: functions from a key and its values to any number of target keys and values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.keys import KeySpec
from ..sources.schema import ORD, ddl

Apply = Callable[[DataFrame, KeySpec], DataFrame]


@dataclass(frozen=True)
class Producer:
    """``apply`` takes upserts (key, value, ordinal) and gives (source_key, target_key, value, _ord). ``columns_only``:
    it only renames columns, so it may well be run again."""

    apply: Apply
    columns_only: bool = False


def _shaped(df: DataFrame) -> DataFrame:
    if ORD not in df.columns:
        df = df.withColumn(ORD, F.col("ordinal").cast("long") if "ordinal" in df.columns else F.lit(0).cast("long"))
    return df.select("source_key", "target_key", "value", ORD)


def native(fn: Callable[[DataFrame], DataFrame]) -> Producer:
    """``fn`` maps a DataFrame (key, value, ordinal) to one with source_key, target_key, value and perhaps
    ordinal, by DataFrame operations that never mix rows of different source keys."""
    return Producer(lambda upserts, spec: _shaped(fn(upserts)))


def identity() -> Producer:
    return replace(native(lambda u: u.select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), "value", "ordinal")), columns_only=True)


def _schema(source: T.DataType, target: T.DataType | str, value: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField("source_key", source), T.StructField("target_key", ddl(target)), T.StructField("value", ddl(value)), T.StructField(ORD, T.LongType())])


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    return isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)


def _grouped(upserts: DataFrame, spec: KeySpec, *first: Column) -> DataFrame:
    """Rows by group, in each by ``first``, ordinal, then key and value, so that reruns see one order."""
    rows = upserts.withColumn("_g", spec.of("key"))
    if spec.collation and not spec.group:  # Python tells groups apart by plain equality
        rows = rows.withColumn("_g", F.min(F.collate("key", "UTF8_BINARY")).over(Window.partitionBy("_g")))
    last = [c for c in ("key", "value") if _sortable(upserts.schema[c].dataType)]
    return rows.repartition("_g").sortWithinPartitions("_g", *first, "ordinal", *last)


def _held(kind: pa.DataType) -> pd.ArrowDtype | None:
    nested = pa.types.is_nested(kind)
    return None if nested else pd.ArrowDtype(kind)


def _plain(x: Any) -> Any:
    """Missing values and scalars of pandas and numpy, also inside dicts and lists, as plain Python."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, np.generic):
        return x.item()
    return None if x is pd.NA else x


def pandas(fn: Callable[[Any, pd.DataFrame], Iterable[tuple[Any, Any]]], target: T.DataType | str, value: T.DataType | str, batch: int = 10_000) -> Producer:
    """``fn(key, rows)`` gets a key (that of the group's first row) and its rows by ordinal (columns value and
    ordinal, Arrow-backed), and yields (target key, value). A group is held in memory; for larger ones use ``arrow``."""

    def apply(upserts: DataFrame, spec: KeySpec) -> DataFrame:
        schema = _schema(upserts.schema["key"].dataType, target, value)
        types = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = []
            for key, rows in _frames(batches):
                for i, (t, v) in enumerate(fn(key, rows)):
                    made.append({"source_key": key, "target_key": _plain(t), "value": _plain(v), ORD: i})
                    if len(made) >= batch:
                        yield pa.RecordBatch.from_pylist(made, types)
                        made = []
            yield pa.RecordBatch.from_pylist(made, types)

        return _grouped(upserts, spec).select("_g", "key", "value", "ordinal").mapInArrow(run, schema)

    return Producer(apply)


def _same(a: Any, b: Any) -> bool:
    """Equality of groups as Spark has it: NaN equals NaN, also inside structs and arrays."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b or (a != a and b != b)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, pd.DataFrame]]:
    """(key, rows) of each group of a sorted run. A batch is made a frame as a whole and groups are cut from it, as the
    fixed cost of a conversion is more than that of most groups' rows."""
    group, key, parts = None, None, []

    def whole() -> pd.DataFrame:
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        rows.index = pd.RangeIndex(len(rows))
        return rows

    for b in batches:
        groups, keys = b.column("_g").to_pylist(), b.column("key").to_pylist()
        # Arrow-backed columns: whole numbers beside nulls stay whole
        frame = pa.Table.from_batches([b]).select(["value", "ordinal"]).to_pandas(types_mapper=_held, integer_object_nulls=True)
        at = 0
        while at < len(groups):
            if not parts or not _same(group, groups[at]):
                if parts:
                    yield key, whole()
                group, key, parts = groups[at], keys[at], []
            end = at + 1
            while end < len(groups) and (groups[end] == group or _same(group, groups[end])):
                end += 1
            parts.append(frame.iloc[at:end])
            at = end
    if parts:
        yield key, whole()


def arrow(fn: Callable[[Any, Iterator[Any]], Iterable[tuple[Any, Any]]], target: T.DataType | str, value: T.DataType | str, batch: int = 10_000) -> Producer:
    """``fn(key, values)`` gets a key and a single-use iterator over its values by ordinal: groups of any
    size stream through in Arrow batches. It need not use all values."""
    return _streamed(fn, target, value, batch)


def _streamed(fn: Callable[[Any, Iterator[Any]], Iterable[tuple[Any, Any]]], target: T.DataType | str, value: T.DataType | str, batch: int, *first: Column) -> Producer:
    def apply(upserts: DataFrame, spec: KeySpec) -> DataFrame:
        schema = _schema(upserts.schema["key"].dataType, target, value)
        types = to_arrow_schema(schema)

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                yield from zip(b.column("_g").to_pylist(), b.column("key").to_pylist(), b.column("value").to_pylist(), strict=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, made = rows_of(batches), []
            ahead = next(rows, None)
            while ahead is not None:
                group, key = ahead[0], ahead[1]
                values = _Values(ahead, rows)
                for i, (t, v) in enumerate(fn(key, values)):
                    made.append({"source_key": key, "target_key": t, "value": v, ORD: i})
                    if len(made) >= batch:
                        yield pa.RecordBatch.from_pylist(made, types)
                        made = []
                ahead = values.rest(group)
            yield pa.RecordBatch.from_pylist(made, types)

        return _grouped(upserts, spec, *first).select("_g", "key", "value").mapInArrow(run, schema)

    return Producer(apply)


class _Values:
    """The values of one group of a sorted run; ends where the group does."""

    def __init__(self, first: tuple, rows: Iterator[tuple]):
        self.group, self.ahead, self.rows, self.used = first[0], first, rows, False

    def __iter__(self) -> Iterator[Any]:
        if self.used:
            raise ValueError("the values of a key can be read once")
        self.used = True
        while self.ahead is not None and self.ahead[0] == self.group:
            value = self.ahead[2]
            self.ahead = next(self.rows, None)
            yield value

    def rest(self, group: Any) -> tuple | None:
        while self.ahead is not None and self.ahead[0] == group:
            self.ahead = next(self.rows, None)
        return self.ahead


def cogroup_native(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Producer:
    """For a co-group: ``fn`` maps the sides, each (key, value, ordinal), to source_key, target_key, value and perhaps
    ordinal, by DataFrame operations that never mix rows of different source keys."""

    def side(u: DataFrame, i: int, name: str) -> DataFrame:
        return u.where(F.col("value.side") == i).select("key", F.col(f"value.{name}").alias("value"), "ordinal")

    return native(lambda u: fn(side(u, 0, "left"), side(u, 1, "right")))


def cogroup_arrow(fn: Callable[[Any, list, Iterator[Any]], Iterable[tuple[Any, Any]]], target: T.DataType | str, value: T.DataType | str, batch: int = 10_000) -> Producer:
    """For a co-group: ``fn(key, left values, right values)`` yields (target key, value). The left side of a key is
    held in memory, the right one streams through: any join of two lists a key, the many on the right."""

    def split(key: Any, values: Iterator[Any]) -> Iterable[tuple[Any, Any]]:
        rows, left, first = iter(values), [], []
        for v in rows:
            if v["side"]:
                first.append(v["right"])
                break
            left.append(v["left"])
        return fn(key, left, chain(first, (v["right"] for v in rows)))

    return _streamed(split, target, value, batch, F.col("value.side"))
