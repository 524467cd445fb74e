"""Text expressions that producers share."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Split at every space; empty words stay."""
    return F.split(text, " ", -1)


def copies(n: Column) -> Column:
    """1 to n, or null (so that explode drops the row) below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int")))
