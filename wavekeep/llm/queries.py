"""The queries opN_* over the table documents, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsample, fingerprints, langid, licenses, linededup, media, mixing, packing, pii, sharding
from ._common import documents


def tokenizer_path() -> str:
    """The vocabulary file that packing counts by; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(documents(spark, sf_dir).select("doc_id", "text")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = langid.predict(docs.select("doc_id", "text"), langid.fit(docs), out=("lang_pred", "score"))
    return rows.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 24)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(documents(spark, sf_dir), keep_tensor=True)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsample.classes(documents(spark, sf_dir))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_links(fingerprints.edited(documents(spark, sf_dir)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(documents(spark, sf_dir)).drop("detections")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_packing, op3_langid, op4_sharding, op5_media, op6_simhash, op7_lines, op8_fingerprints, op9_mixing, op10_licenses)}


_MIXING = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS m FROM documents),
c AS (SELECT *, CAST(floor(ln(size + 1) / ln(2) * 16) AS BIGINT) AS class,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || m), 1, 7) AS BIGINT) % 64 AS bucket FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT source, source_size, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
o AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('mix' || coalesce(':' || source, '')), 1, 7) AS BIGINT) AS DOUBLE) / CAST(268435456 AS DOUBLE) AS start FROM t),
r AS (SELECT c.doc_id, c.size, o.source, o.source_size, o.target, o.rate, o.start,
  row_number() OVER (PARTITION BY c.source ORDER BY class, bucket, size, doc_id NULLS FIRST, m) AS pos FROM c JOIN o ON c.source IS NOT DISTINCT FROM o.source),
x AS (SELECT r.*, CAST(i AS DOUBLE) / 32 AS draw FROM r, (SELECT unnest(generate_series(0, 31)) AS i) g),
k AS (SELECT *, CAST(least(floor(pos * rate + (start + draw)) - floor((pos - 1) * rate + (start + draw)), 2) AS BIGINT) AS copies FROM x),
b AS (SELECT source, draw, abs(sum(copies * size) - max(target)) AS off FROM k GROUP BY source, draw),
f AS (SELECT source, draw, row_number() OVER (PARTITION BY source ORDER BY off, draw) AS best FROM b)
SELECT k.doc_id, k.size, k.source_size, k.target, k.copies * k.size AS taken FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.draw = f.draw WHERE f.best = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": _MIXING}
