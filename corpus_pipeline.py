"""The corpus pipeline: language ID, line dedup, near-duplicate documents, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavekeep.llm import bitsample, langid, linededup, mixing, packing
from wavekeep.llm.queries import tokenizer_path
from wavekeep.sources.store import Scratch

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, by its own prediction, with a score of at least ``LEAST_SCORE``."""
    rows = langid.predict(docs, langid.fit(docs))
    pred, score = rows.columns[-2:]
    return rows.where((F.col(pred) != langid.UND) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that loses all its lines goes. n_chars follows the text."""
    rows = linededup.dedup(docs)
    n, dropped = rows.columns[-2:]
    rows = rows.where(F.col("text").isNull() | (F.col(dropped) == 0) | (F.length(F.trim(F.translate("text", "\n\r\t", "   "))) > 0))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id (nulls last); a null text is empty, and of rows
    equal in id and text one stays."""
    return bitsample.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times), its other columns unchanged; a null source is a source of
    its own, a null text has no words. Equal rows share their copies."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null or empty text is one piece of one id, and repeated rows are packed as often
    as they occur."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packed)]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage returns is written and read again, so that it runs once however often the next
    one reads it; what came before it is dropped then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        now = Scratch(spark)
        docs = now.put(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
