"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wavekeep.operators.produce import native
from wavekeep.plans import catalogue
from wavekeep.plans.graph import Graph
from wavekeep.sources.readers import keyed

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("bulk_rekey", "mixed_wave", "group_sum", "delete_keys", "diamond_graph", "join_incremental", "preserve_ids_wave2")


def lineitem_waves(spark: SparkSession) -> tuple[dict[str, float], dict[str, float]]:
    """A bulk load of lineitem by order into totals by part, then waves of 0.1, 1 and 10 % of the orders: seconds, and
    of the waves the part of the bulk load's time and the rows of the first stage's feed for each key touched."""
    g = Graph(spark)
    by_part = native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value.part").alias("target_key"), F.col("value.q").alias("value"), "ordinal"))
    s = g.source("lines", "bigint", "struct<part:bigint,q:decimal(18,2)>", by_part, target_key="bigint", target_value="decimal(18,2)")
    s.produces("totals", catalogue.totals(), "bigint", catalogue.TOTALS)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    wave = lambda df, more: keyed(df, F.col("l_orderkey"), F.struct(F.col("l_partkey").alias("part"), (F.col("l_quantity") + more).cast("decimal(18,2)").alias("q")), F.col("l_linenumber"))
    out, more = {}, {}
    for name, df in {"bulk_load": lines, "wave_0.1%": lines.where("l_orderkey % 1000 = 0"), "wave_1%": lines.where("l_orderkey % 100 = 0"), "wave_10%": lines.where("l_orderkey % 10 = 0")}.items():
        began = time.time()
        rows = g.update({"lines": wave(df, 0 if name == "bulk_load" else 1)}, validate=False).rows["lines"]
        out[name] = round(time.time() - began, 3)
        if name != "bulk_load":
            more[f"{name} : bulk_load"] = round(out[name] / out["bulk_load"], 3)
            more[f"{name} feed rows a key"] = round(rows["updates"] / max(1, rows["touched"]), 1)
    return out, more


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    catalogue.QUERIES["bulk_rekey"](spark, SF).write.format("noop").mode("overwrite").save()  # code is compiled once
    took, more = lineitem_waves(spark)
    for name in QUERIES:
        began = time.time()
        catalogue.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    try:
        from wavekeep.llm.queries import queries
    except ImportError:
        queries = dict
    for name, query in queries().items():
        began = time.time()
        query(spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "waves": more, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
