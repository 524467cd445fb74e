"""Mixing sources to target weights by systematic sampling.

Within a source each document's expected copies are its source's target over its source's size; the
documents are put in an order, their expected copies are summed up along it, one offset is added, and
a document is emitted once for each integer that its sum crosses. The offset is the one of ``DRAWS``
draws that brings the words taken nearest to the target: every draw is a systematic sample, and small
sources with few long documents would else miss their target by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, free_name

WEIGHTS = (5, 2, 1)
CAP = 2.0
SHARE = 1.5
BUCKETS = 64
DRAWS = 32


def n_words(text: str):
    """Runs of characters that are no space, tab, line feed, vertical tab, form feed or carriage return."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources: one row a source (source, source_size, docs). Adds weight and target.

    Sources in code point order, null last, weigh 5, 2, 1, repeating; together they get ``SHARE`` times
    all sizes; a target stops at ``CAP`` times its source's size and the excess is shared by weight
    among the others until none is above. That is target = min(cap, level * weight), where the level
    is the largest that (what is left) / (weight that is left) reaches along rising cap / weight.
    Runs over one row a source, in one task.
    """
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place"), F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    rows = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.select("source", "source_size", "docs", w.alias("weight"), (F.col("source_size") * CAP).alias("cap"))
    every = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    prior, whole = every.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(prior), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(prior), F.lit(0.0))
    rows = rows.withColumn("level", left / weight)
    return rows.withColumn("target", F.least("cap", F.max("level").over(whole) * F.col("weight"))).drop("cap", "level")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken (= copies * size) and text_md5.

    A null text has size 0 and is sampled like any other; a null source is a source of its own; repeated
    rows are documents of their own, and where the sum crosses an integer within equal rows any of them
    is taken. The order in a source is by size class (sixteenths of a doubling), then a hash bucket,
    then size, id and text digest: it is numbered bucket by bucket from the rows before each, so no task
    gets a whole source, and as neighbours have like sizes the words taken come near the target. The
    draws follow from a digest of ``seed`` and the source, so reruns agree. Other columns are ignored.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), digest.alias("text_md5"))
    rows = Scratch(docs.sparkSession).put(
        rows.withColumn("class", F.floor(F.log2(F.col("size") + 1) * 16).cast("int")).withColumn(
            "bucket", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_md5")), 1, 7), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int")
        )
    )
    cells = rows.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    by_source = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("docs")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), "source"), F.lit("")))), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))
    by_source = by_source.select(F.col("source").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("offset"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).join(by_source, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("k"), "before", "source_size", "target", "rate", "offset")
    at = F.row_number().over(Window.partitionBy("source", "class", "bucket").orderBy("size", "doc_id", "text_md5"))
    rows = rows.withColumn("at", at).join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("bucket") == F.col("k"))).drop("s", "c", "k")

    def crossed(draw):
        start = F.col("offset") + draw
        upto = (F.col("before") + F.col("at")) * F.col("rate")
        less = (F.col("before") + F.col("at") - 1) * F.col("rate")
        return F.least((F.floor(upto + start) - F.floor(less + start)).cast("long"), F.lit(int(CAP)).cast("long"))

    shift = [F.lit(i / DRAWS) for i in range(DRAWS)]
    tried = rows.groupBy("source").agg(F.first("target").alias("goal"), *[F.sum(crossed(x) * F.col("size")).alias(f"t{i}") for i, x in enumerate(shift)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("goal")).alias("off"), x.alias("draw")) for i, x in enumerate(shift)]))["draw"]
    tried = tried.select(F.col("source").alias("s"), best.alias("draw"))
    rows = rows.join(tried, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", crossed(F.col("draw")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_md5")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as it was emitted; the columns of ``docs``."""
    d, n, c, i = (free_name(docs, x) for x in ("mix_md5", "mix_n", "mix_copies", "mix_id"))
    names = docs.columns
    picked = copies(docs, id_col, text_col, source_col, seed).groupBy("doc_id", "source", "text_md5").agg(F.sum("copies").alias(c)).where(F.col(c) > 0)
    picked = picked.select(F.col("doc_id").alias(i), F.col("source").alias(n), F.col("text_md5").alias(d + "_"), c)
    rows = docs.withColumn(d, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    rows = rows.join(picked, F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).eqNullSafe(F.col(n)) & (F.col(d) == F.col(d + "_")))
    # repeated rows share their copies: the first gets them
    one = Window.partitionBy(i, n, d).orderBy(d)
    f = free_name(rows, "mix_first")
    rows = rows.withColumn(f, F.row_number().over(one)).where(F.col(f) == 1)
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(c).cast("int")))).select(*names)
