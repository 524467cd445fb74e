"""python -m wavekeep.cli STORAGE INPUT [BASED_ON]: one wave of a Parquet file of transactions, on the newest version by default.

Stage transactions keys them by their unique id; credits_and_invoices by supplier, absolute amount and
sign, where rows that differ only in sign share a key.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.keys import KeySpec
from .operators.produce import native
from .plans.graph import Graph
from .sources.readers import whole_file
from .sources.store import ParquetStore


def graph(spark: SparkSession, storage: str, value_type) -> Graph:
    g = Graph(spark, ParquetStore(storage))
    by_id = native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value.UniqueId").alias("target_key"), "value", "ordinal"))
    rows = g.source("transactions", "string", value_type, by_id, target_key="string", target_value=value_type)
    key = F.struct(F.col("value.SupplierRef").alias("SupplierRef"), F.abs("value.InvoiceAmount").alias("AbsAmount"), (F.col("value.InvoiceAmount") < 0).alias("IsCredit"))
    paired = native(lambda u: u.select(F.col("key").alias("source_key"), key.alias("target_key"), F.struct("value.InvoiceNumber", "value.EnteredDate").alias("value"), "ordinal"))
    amount = next(f.dataType.simpleString() for f in value_type.fields if f.name == "InvoiceAmount")
    entered = next(f.dataType.simpleString() for f in value_type.fields if f.name == "EnteredDate")
    rows.produces("credits_and_invoices", paired, f"struct<SupplierRef:string,AbsAmount:{amount},IsCredit:boolean>", f"struct<InvoiceNumber:string,EnteredDate:{entered}>", target_keys=KeySpec(("key.SupplierRef", "key.AbsAmount")))
    return g


def main(args: list[str]) -> None:
    storage, path, *based_on = args
    spark = SparkSession.builder.getOrCreate()
    wave = whole_file(spark, path)
    report = graph(spark, storage, wave.schema["value"].dataType).update({"transactions": wave}, int(based_on[0]) if based_on else None)
    print(f"version {report.version}: " + ", ".join(f"{k} {v:.1f} s" for k, v in report.seconds.items()))


if __name__ == "__main__":
    main(sys.argv[1:])
