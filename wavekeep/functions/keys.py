"""How keys group and sort."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTED = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)")
_KEY = re.compile(r"(?<![\w.])key(?!\w)")


@dataclass(frozen=True)
class KeySpec:
    """``group`` and ``order`` are SQL expressions over ``key``. Rows whose group expressions are equal (null
    equals null) share a key; each row still carries its own full key. ``order`` entries may end in
    DESC. Empty means the key itself, ascending, nulls first. ``collation`` applies to string keys."""

    group: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    collation: str | None = None

    @property
    def plain(self) -> bool:
        """Whether a group has only one key."""
        return not self.group and not self.collation

    def of(self, column: str) -> Column:
        """The column that two keys of one group have in common."""
        if self.group:
            return F.struct(*[_over(x, column).alias(f"g{i}") for i, x in enumerate(self.group)])
        return F.collate(F.col(column), self.collation) if self.collation else F.col(column)

    def bucket(self, column: str, buckets: int) -> Column:
        """0 to ``buckets`` - 1, equal for all keys of a group. Hashes don't know collations: keys under one that is more
        than a matter of case are in one bucket (of several files, if large)."""
        same = self.of(column)
        if self.collation and not self.group:
            if self.collation.upper() != "UTF8_LCASE":
                return F.lit(0)
            same = F.collate(F.lower(F.col(column)), "UTF8_BINARY")
        return F.pmod(F.xxhash64(same), F.lit(buckets)).cast("int")

    def sort(self, column: str) -> list[Column]:
        out = []
        for x in self.order or self.group or ("key",):
            down = x.upper().endswith(" DESC")
            c = _over(x[:-5] if down else x, column)
            c = F.collate(c, self.collation) if self.collation else c
            out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        return out


def _over(text: str, column: str) -> Column:
    """The expression with ``key`` (outside quotes) bound to a column, whatever that column is called."""
    parts = _QUOTED.split(text)
    return F.expr("".join(x if i % 2 else _KEY.sub(f"`{column}`", x) for i, x in enumerate(parts)))


def match(left: DataFrame, right: DataFrame, how: str, on: str = "_g") -> DataFrame:
    """Null-safe join on a group column that both sides have; the right one's is dropped."""
    right = right.withColumnRenamed(on, f"{on}_r")
    out = left.join(right, F.col(on).eqNullSafe(F.col(f"{on}_r")), how)
    return out if how in ("left_semi", "left_anti") else out.drop(f"{on}_r")
