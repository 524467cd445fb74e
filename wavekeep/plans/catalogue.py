"""Queries over the driver's tables, each with SQL for the state that its waves end in."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import KeySpec
from ..functions.text import copies, words
from ..operators import feed as feeds
from ..operators import produce
from ..operators.merge import affected_keys, augmented
from ..operators.preserve import Preserve
from ..operators.produce import Producer, identity, native
from ..sources.readers import deletes, keyed, whole_file
from ..sources.schema import DELETE, as_updates
from ..sources.store import ParquetStore, session_store, shared_dir
from ..streaming.waves import stream_graph
from .graph import Graph, Stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Orders after the second wave of ``orders_graph``: every seventh is deleted, every fifth of the rest is dearer.
ORDERS = "(SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 5 = 0 THEN 10 ELSE 0 END AS price FROM orders WHERE o_orderkey % 7 <> 0) o"
ORDERS_1 = "(SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders) o"
PRICED = "struct<cust:bigint,price:decimal(18,2)>"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def price(column: str) -> F.Column:
    return F.col(column).cast("decimal(18,2)")


def rekey(key: str, value: str = "value") -> Producer:
    return native(lambda u: u.select(F.col("key").alias("source_key"), F.expr(key).alias("target_key"), F.expr(value).alias("value"), "ordinal"))


def totals(of: str = "value") -> Producer:
    return native(lambda u: u.groupBy("key").agg(F.count("*").alias("n"), F.sum(of).cast("decimal(28,2)").alias("total")).select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), F.struct("n", "total").alias("value")))


TOTALS = "struct<n:bigint,total:decimal(28,2)>"


def orders_graph(spark: SparkSession, d: str, below: Callable[[Stage], Stage] | None = None, waves: int = 2, store=None) -> tuple[Graph, Stage]:
    """Orders by order key, rekeyed to customers, then ``below``."""
    g = Graph(spark, store)
    stage = g.source("by_customer", "bigint", PRICED, rekey("value.cust"), target_key="bigint", target_value=PRICED)
    stage = below(stage) if below else stage
    orders = table(spark, d, "orders")
    value = F.struct(F.col("o_custkey").alias("cust"), price("o_totalprice").alias("price"))
    dear = F.struct(F.col("o_custkey").alias("cust"), (price("o_totalprice") + 10).cast("decimal(18,2)").alias("price"))
    g.update({"by_customer": keyed(orders, F.col("o_orderkey"), value)}, validate=False)
    if waves > 1:
        gone = deletes(orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("key")), keyed(orders, F.col("o_orderkey"), value))
        again = keyed(orders.where("o_orderkey % 5 = 0 and o_orderkey % 7 <> 0"), F.col("o_orderkey"), dear)
        g.update({"by_customer": again.unionByName(gone)})
    return g, stage


def flat(df: DataFrame) -> DataFrame:
    return df.select("target_key", "source_key", F.col("value.price").alias("price"))


@query("SELECT o_custkey AS target_key, o_orderkey AS source_key, price FROM " + ORDERS_1)
def bulk_rekey(spark: SparkSession, d: str) -> DataFrame:
    return flat(orders_graph(spark, d, waves=1)[1].read())


@query("SELECT o_custkey AS target_key, o_orderkey AS source_key, price FROM " + ORDERS)
def mixed_wave(spark: SparkSession, d: str) -> DataFrame:
    return flat(orders_graph(spark, d)[1].read())


@query("SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS target_key, CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN month(o_orderdate) = 1 THEN 1 ELSE 0 END AS price FROM orders WHERE month(o_orderdate) <> 1 OR o_orderkey % 2 = 0")
def daily_replace(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark)
    s = g.source("orders", "date", "struct<id:bigint,price:decimal(18,2)>", rekey("value.id", "value.price"), target_key="bigint", target_value="decimal(18,2)")
    orders = table(spark, d, "orders")
    wave = lambda df, more: keyed(df, F.to_date("o_orderdate"), F.struct(F.col("o_orderkey").alias("id"), (price("o_totalprice") + more).cast("decimal(18,2)").alias("price")))
    g.update({"orders": wave(orders, 0)})
    # a January day without even orders stays away: it is deleted
    january = orders.where("month(o_orderdate) = 1")
    again = wave(january.where("o_orderkey % 2 = 0"), 1)
    days = january.select(F.to_date("o_orderdate").alias("key")).distinct()
    g.update({"orders": again.unionByName(deletes(days.join(again.select("key").distinct(), "key", "left_anti"), again))})
    return s.read().select(F.col("source_key").alias("day"), "target_key", F.col("value").alias("price"))


@query("SELECT l_partkey AS target_key, l_orderkey AS source_key, CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM lineitem WHERE l_orderkey % 7 <> 0")
def delete_keys(spark: SparkSession, d: str) -> DataFrame:
    g, s, _ = lineitem_graph(spark, d)
    return s.read().select("target_key", "source_key", F.col("value").alias("quantity"))


def lineitem_graph(spark: SparkSession, d: str) -> tuple[Graph, Stage, DataFrame]:
    g = Graph(spark)
    s = g.source("lines", "bigint", "struct<part:bigint,q:decimal(18,2)>", rekey("value.part", "value.q"), target_key="bigint", target_value="decimal(18,2)")
    lines = table(spark, d, "lineitem")
    wave = keyed(lines, F.col("l_orderkey"), F.struct(F.col("l_partkey").alias("part"), price("l_quantity").alias("q")), F.col("l_linenumber"))
    g.update({"lines": wave})
    g.update({"lines": deletes(lines.where("l_orderkey % 7 = 0").select(F.col("l_orderkey").alias("key")), wave)})
    return g, s, wave


@query("SELECT l_orderkey AS source_key, l_partkey AS target_key FROM lineitem WHERE l_orderkey % 7 <> 0")
def key_mappings(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_graph(spark, d)[1].read("key_mappings")


_TOUCHED = "touched AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0)"


@query(
    f"WITH {_TOUCHED} SELECT 'update' AS type, o_custkey AS key, price FROM {ORDERS} WHERE o_custkey IN (SELECT k FROM touched) "
    f"UNION ALL SELECT 'delete', k, NULL FROM touched WHERE k NOT IN (SELECT o_custkey FROM {ORDERS})"
)
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    return orders_graph(spark, d)[1].read("updates").select("type", "key", F.col("value.price").alias("price"))


def custs_graph(spark: SparkSession, d: str) -> Stage:
    """Orders of customers of even number, then a wave with the rest and deletes of every third of the first."""
    g = Graph(spark)
    s = g.source("o", "bigint", "bigint", rekey("value", "1L"), target_key="bigint", target_value="bigint")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    wave = lambda df: keyed(df, F.col("o_orderkey"), F.col("o_custkey"))
    first, third = "o_custkey % 2 = 0", "o_custkey % 2 = 0 and o_custkey % 3 = 0"
    g.update({"o": wave(orders.where(first))})
    gone = deletes(orders.where(third).select(F.col("o_orderkey").alias("key")), wave(orders))
    g.update({"o": wave(orders.where(f"not ({first})")).unionByName(gone)})
    return s


_WAS, _IS = "(SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)", "(SELECT o_custkey FROM orders WHERE o_custkey % 2 <> 0 OR o_custkey % 3 <> 0)"


@query(f"SELECT DISTINCT o_custkey AS key FROM {_IS} i WHERE o_custkey NOT IN {_WAS}")
def feed_added_keys(spark: SparkSession, d: str) -> DataFrame:
    return feeds.added_keys(custs_graph(spark, d).read("updates"))


@query(f"SELECT DISTINCT o_custkey AS key FROM {_WAS} w WHERE o_custkey NOT IN {_IS}")
def feed_deleted_keys(spark: SparkSession, d: str) -> DataFrame:
    return feeds.deleted_keys(custs_graph(spark, d).read("updates"))


@query(f"SELECT o_custkey AS key, price FROM {ORDERS}")
def feed_applied(spark: SparkSession, d: str) -> DataFrame:
    g, s = orders_graph(spark, d)
    old = s.read(version=1).select(F.col("target_key").alias("key"), "value")
    return feeds.apply_feed(old, s.read("updates")).select("key", F.col("value.price").alias("price"))


@query("SELECT CAST(p_size AS BIGINT) AS key, count(*) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY p_size")
def trailing_delete(spark: SparkSession, d: str) -> DataFrame:
    """Of each size the sources that sort last are deleted; a count below must not see the deletes."""
    g = Graph(spark)
    s = g.source("parts", "bigint", "bigint", rekey("value", "1L"), target_key="bigint", target_value="bigint")
    counted = native(lambda u: u.groupBy("key").agg(F.count("*").alias("n")).select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), F.col("n").alias("value")))
    n = s.produces("counts", counted, "bigint", "bigint")
    part = table(spark, d, "part")
    wave = keyed(part, F.col("p_partkey"), F.col("p_size").cast("bigint"))
    g.update({"parts": wave})
    g.update({"parts": deletes(part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key")), wave)})
    return n.read().select(F.col("target_key").alias("key"), F.col("value").alias("n"))


@query("SELECT c_custkey AS source_key, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 4 = 3")
def upsert_then_delete_next(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark)
    s = g.source("c", "bigint", "string")
    c = table(spark, d, "customer")
    wave = keyed(c, F.col("c_custkey"), F.col("c_name"))
    g.update({"c": wave})
    again = keyed(c.where("c_custkey % 2 = 0"), F.col("c_custkey"), F.concat("c_name", F.lit("!")))
    g.update({"c": again.unionByName(deletes(c.where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("key")), wave))})
    return s.read().select("source_key", "value")


@query("SELECT nullif(c_nationkey, 3) AS target_key, count(*) AS n, count(nullif(c_mktsegment, 'BUILDING')) AS n_values FROM customer WHERE nullif(c_nationkey, 4) IS NOT NULL GROUP BY 1")
def null_keys(spark: SparkSession, d: str) -> DataFrame:
    """A null key is a key like any other: nation 4 is sent under null, then null is deleted; nation 3 under null stays."""
    g = Graph(spark)
    s = g.source("c", "int", "string")
    c = table(spark, d, "customer")
    wave = keyed(c, F.expr("nullif(c_nationkey, 4)"), F.expr("nullif(c_mktsegment, 'BUILDING')"))
    g.update({"c": wave})
    g.update({"c": deletes(spark.sql("SELECT cast(null as int) AS key UNION ALL SELECT 3"), wave)})
    g.update({"c": keyed(c.where("c_nationkey = 3"), F.lit(None).cast("int"), F.expr("nullif(c_mktsegment, 'BUILDING')"))})
    return s.read().groupBy("target_key").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))


def totals_of(spark: SparkSession, d: str, producer: Producer) -> DataFrame:
    s = orders_graph(spark, d, lambda s: s.produces("totals", producer, "bigint", TOTALS))[1]
    return s.read().select(F.col("target_key").alias("cust"), "value.n", "value.total")


_BY_CUST = f"SELECT o_custkey AS cust, count(*) AS n, CAST(sum(price) AS DECIMAL(28,2)) AS total FROM {ORDERS} GROUP BY o_custkey"


@query(_BY_CUST)
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    return totals_of(spark, d, totals("value.price"))


@query(f"SELECT o_custkey AS cust, count(*) AS n FROM {ORDERS} GROUP BY o_custkey")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return totals_of(spark, d, totals("value.price")).select("cust", "n")


@query(f"SELECT o_custkey AS cust, CAST(sum(price) AS DOUBLE) / count(*) AS mean FROM {ORDERS} GROUP BY o_custkey")
def group_avg(spark: SparkSession, d: str) -> DataFrame:
    return totals_of(spark, d, totals("value.price")).select("cust", (F.col("total").cast("double") / F.col("n")).alias("mean"))


def _summed(key, values):
    prices = [v["price"] for v in values]
    yield key, {"n": len(prices), "total": sum(prices)}


@query(_BY_CUST)
def group_sum_arrow(spark: SparkSession, d: str) -> DataFrame:
    return totals_of(spark, d, produce.arrow(_summed, "bigint", TOTALS))


@query(_BY_CUST)
def group_sum_pandas(spark: SparkSession, d: str) -> DataFrame:
    return totals_of(spark, d, produce.pandas(lambda key, rows: _summed(key, rows["value"]), "bigint", TOTALS))


@query(f"SELECT o_custkey % 10 AS range, CAST(sum(price) AS DOUBLE) / count(*) AS mean FROM {ORDERS} GROUP BY 1")
def avg_salted_3stage(spark: SparkSession, d: str) -> DataFrame:
    salted = native(lambda u: u.select(F.col("key").alias("source_key"), F.struct((F.col("key") % 10).alias("range"), F.pmod(F.xxhash64("value", "ordinal"), F.lit(10)).alias("salt")).alias("target_key"), F.col("value.price").alias("value"), "ordinal"))
    partial = native(lambda u: u.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(28,2)").alias("total")).select(F.col("key").alias("source_key"), F.col("key.range").alias("target_key"), F.struct("n", "total").alias("value")))
    final = native(lambda u: u.groupBy("key").agg((F.sum("value.total").cast("double") / F.sum("value.n")).alias("value")).select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), "value"))

    def below(s: Stage) -> Stage:
        s = s.produces("salted", salted, "struct<range:bigint,salt:bigint>", "decimal(18,2)")
        return s.produces("partial", partial, "bigint", TOTALS).produces("mean", final, "bigint", "double")

    return orders_graph(spark, d, below)[1].read().select(F.col("target_key").alias("range"), F.col("value").alias("mean"))


@query("SELECT md5(text) AS digest, doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1 HAVING count(*) >= 2) AND doc_id % 11 <> 0")
def having_duplicates(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark)
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    s = g.source("docs", "bigint", "string", native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value").alias("target_key"), F.col("key").alias("value"))), target_key="string", target_value="bigint")
    several = native(lambda u: u.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2").join(u.select(F.col("key").alias("k"), "value"), F.expr("key <=> k")).select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), "value"))
    dup = s.produces("dups", several, "string", "bigint")
    wave = keyed(docs, F.col("doc_id"), F.col("digest"))
    g.update({"docs": wave})
    g.update({"docs": deletes(docs.where("doc_id % 11 = 0").select(F.col("doc_id").alias("key")), wave)})
    return dup.read().select(F.col("target_key").alias("digest"), F.col("value").alias("doc_id"))


@query(
    "WITH g AS (SELECT l_orderkey AS k, count(*) AS n, arg_min(l_returnflag, l_linenumber * 1000 + ascii(l_returnflag)) AS first, max(l_linenumber) AS copies FROM lineitem GROUP BY 1) "
    "SELECT n AS target_key, k AS source_key, first, CAST(c AS BIGINT) AS copy FROM g, LATERAL (SELECT unnest(generate_series(1, CAST(copies AS BIGINT))) AS c) x"
)
def first_max_expand(spark: SparkSession, d: str) -> DataFrame:
    """Key = number of values; the first value's flag, once for each copy up to the largest number."""
    made = lambda u: u.groupBy("key").agg(F.count("*").alias("n"), F.min_by("value.flag", F.struct("ordinal", "value.flag")).alias("first"), F.max("value.number").alias("most")).select(
        F.col("key").alias("source_key"), F.col("n").alias("target_key"), "first", F.explode(copies(F.col("most"))).alias("copy")
    ).select("source_key", "target_key", F.struct("first", F.col("copy").cast("bigint").alias("copy")).alias("value"), F.col("copy").cast("bigint").alias("ordinal"))
    g = Graph(spark)
    s = g.source("lines", "bigint", "struct<flag:string,number:int>", native(made), target_key="bigint", target_value="struct<first:string,copy:bigint>")
    lines = table(spark, d, "lineitem")
    g.update({"lines": keyed(lines, F.col("l_orderkey"), F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("number")), F.col("l_linenumber"))})
    return s.read().select("target_key", "source_key", "value.first", "value.copy")


def by_word() -> Producer:
    return native(lambda u: u.select(F.col("key").alias("source_key"), F.posexplode(words(F.col("value"))).alias("ordinal", "target_key"), F.col("key").alias("value")))


def counted_words() -> Producer:
    return native(lambda u: u.groupBy("key").agg(F.count("*").alias("n")).select(F.col("key").alias("source_key"), F.col("n").alias("target_key"), F.col("key").alias("value")))


def words_graph(spark: SparkSession, d: str) -> tuple[Graph, Stage, Stage]:
    """Benchmark items and conversation turns, merged by id, indexed by word and counted, most frequent first;
    then every third item of the first feeder is deleted."""
    g = Graph(spark)
    items, talks = g.source("items", "bigint", "string"), g.source("talks", "bigint", "string")
    index = items.produces("index", by_word(), "string", "bigint", (talks,))
    count = index.produces("counts", counted_words(), "bigint", "string", target_keys=KeySpec(order=("key DESC",)))
    a, b = table(spark, d, "benchmark"), table(spark, d, "conversations")
    wave = keyed(a, F.col("item_id"), F.col("text"))
    g.update({"items": wave, "talks": keyed(b, F.col("conv_id"), F.col("text"), F.col("turn"))})
    g.update({"items": deletes(a.where("item_id % 3 = 0").select(F.col("item_id").alias("key")), wave)})
    return g, index, count


_WORDS = "(SELECT item_id AS id, unnest(string_split(text, ' ')) AS word FROM benchmark WHERE item_id % 3 <> 0 UNION ALL SELECT conv_id, unnest(string_split(text, ' ')) FROM conversations) w"


@query("SELECT word, id FROM " + _WORDS)
def word_index(spark: SparkSession, d: str) -> DataFrame:
    return words_graph(spark, d)[1].read().select(F.col("target_key").alias("word"), F.col("value").alias("id"))


@query(f"SELECT word, count(*) AS n FROM {_WORDS} GROUP BY word")
def word_count_merged(spark: SparkSession, d: str) -> DataFrame:
    return words_graph(spark, d)[2].read().select(F.col("value").alias("word"), F.col("target_key").alias("n"))


@query(f"SELECT word, n, dense_rank() OVER (ORDER BY n DESC) AS place FROM (SELECT word, count(*) AS n FROM {_WORDS} GROUP BY word) x")
def order_desc_rank(spark: SparkSession, d: str) -> DataFrame:
    g, _, count = words_graph(spark, d)
    rows = count.read()
    # a rank among distinct counts only
    ranks = rows.select(F.col("target_key").alias("n")).distinct().withColumn("place", F.row_number().over(Window.orderBy(*KeySpec(order=("key DESC",)).sort("n"))))
    return rows.select(F.col("value").alias("word"), F.col("target_key").alias("n")).join(ranks, "n").select("word", "n", "place")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) w GROUP BY word")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark)
    s = g.source("items", "bigint", "string").produces("index", by_word(), "string", "bigint").produces("counts", counted_words(), "bigint", "string")
    g.update({"items": keyed(table(spark, d, "benchmark"), F.col("item_id"), F.col("text"))})
    return s.read().select(F.col("value").alias("word"), F.col("target_key").alias("n"))


def feeder_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Feed and content of customers (every tenth deleted) and of suppliers (unchanged but for every sixth)."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    content = lambda df, k, n: df.select(F.col(k).alias("target_key"), F.col(k).alias("source_key"), F.col(n).alias("value"), F.lit(0).cast("long").alias("_ord"))
    gone = as_updates(c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("key"), F.lit(None).cast("string").alias("value")), DELETE)
    again = keyed(s.where("s_suppkey % 6 = 0"), F.col("s_suppkey"), F.col("s_name"), change="update")
    return gone, content(c.where("c_custkey % 10 <> 0"), "c_custkey", "c_name"), again, content(s, "s_suppkey", "s_name")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey % 10 = 0 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 6 = 0")
def affected(spark: SparkSession, d: str) -> DataFrame:
    gone, _, again, _ = feeder_pair(spark, d)
    return affected_keys([gone, again]).select("key")


@query("SELECT 'update' AS type, s_suppkey AS key, s_name AS value FROM supplier WHERE s_suppkey % 6 = 0 OR s_suppkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def augmented_updates(spark: SparkSession, d: str) -> DataFrame:
    gone, _, again, content = feeder_pair(spark, d)
    return augmented(again, content, affected_keys([gone, again])).select("type", "key", "value")


@query("SELECT c_nationkey AS nation, CAST(floor(abs(c_acctbal) / 1000) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS credits FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1, 2")
def composite_coarse_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys with a sign that doesn't count: both signs of (nation, bucket) are one group."""
    coarse = KeySpec(("key.nation", "key.bucket"))
    key = "struct<nation:int,bucket:bigint,credit:boolean>"
    g = Graph(spark)
    made = native(lambda u: u.select(F.col("key").alias("source_key"), F.struct("value.nation", F.floor(F.abs("value.bal") / 1000).alias("bucket"), (F.col("value.bal") < 0).alias("credit")).alias("target_key"), F.struct("value.bal").alias("value")))
    s = g.source("c", "bigint", "struct<nation:int,bal:double>", made, target_key=key, target_value="struct<bal:double>", target_keys=coarse)
    grouped = native(
        lambda u: u.groupBy("key.nation", "key.bucket").agg(F.min("key").alias("source_key"), F.count("*").alias("n"), F.sum((F.col("value.bal") < 0).cast("long")).alias("credits")).select("source_key", F.struct("nation", "bucket").alias("target_key"), F.struct("n", "credits").alias("value"))
    )
    t = s.produces("groups", grouped, "struct<nation:int,bucket:bigint>", "struct<n:bigint,credits:bigint>")
    c = table(spark, d, "customer")
    wave = keyed(c, F.col("c_custkey"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")))
    g.update({"c": wave})
    g.update({"c": deletes(c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("key")), wave)})
    return t.read().select("target_key.nation", "target_key.bucket", "value.n", "value.credits")


def ids_graph(spark: SparkSession, d: str, waves: int) -> Stage:
    """Brands and sizes of parts with ids: all parts in one wave, or parts of odd size first, then the rest."""
    g = Graph(spark)
    s = g.source("parts", "bigint", "string", native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value").alias("target_key"), F.struct(F.lit(0).cast("bigint").alias("id")).alias("value"))), target_key="string", target_value="struct<id:bigint>", preserved=Preserve(("id",)))
    part = table(spark, d, "part")
    for i in range(waves):
        g.update({"parts": keyed(part.where("true" if waves == 1 else f"(p_size % 2 = 1) = {i == 0}"), F.col("p_partkey"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))})
    return s


_BRANDS = "SELECT b AS brand, CAST(row_number() OVER (ORDER BY b) AS BIGINT) AS id FROM (SELECT DISTINCT p_brand || '/' || CAST(p_size AS VARCHAR) AS b FROM part) x"
_IDS = _BRANDS.replace("FROM part", "FROM part WHERE p_size % 2 = 1")


@query(_BRANDS)
def preserve_ids(spark: SparkSession, d: str) -> DataFrame:
    return ids_graph(spark, d, 1).read().select(F.col("target_key").alias("brand"), "value.id").distinct()


@query(
    f"{_IDS} UNION ALL SELECT b, CAST(row_number() OVER (ORDER BY b) AS BIGINT) + (SELECT count(*) FROM ({_IDS}) y) FROM (SELECT DISTINCT p_brand || '/' || CAST(p_size AS VARCHAR) AS b FROM part WHERE p_size % 2 = 0) x"
)
def preserve_ids_wave2(spark: SparkSession, d: str) -> DataFrame:
    return ids_graph(spark, d, 2).read().select(F.col("target_key").alias("brand"), "value.id").distinct()


def joined(spark: SparkSession, d: str, how: str) -> DataFrame:
    g = Graph(spark)
    c, o = g.source("c", "bigint", "string"), g.source("o", "bigint", "struct<cust:bigint,price:decimal(18,2)>", rekey("value.cust"), target_key="bigint", target_value=PRICED)
    j = c.joins("j", o, how)
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    value = F.struct(F.col("o_custkey").alias("cust"), price("o_totalprice").alias("price"))
    wave = keyed(customer, F.col("c_custkey"), F.col("c_name"))
    g.update({"c": wave, "o": keyed(orders, F.col("o_orderkey"), value)})
    g.update({"o": deletes(orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("key")), keyed(orders, F.col("o_orderkey"), value))})
    g.update({"c": deletes(customer.where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("key")), wave)})
    return j.read().select(F.col("target_key").alias("cust"), F.col("value.left").alias("name"), "value.right.price")


_SIDES = "(SELECT c_custkey, c_name FROM customer WHERE c_custkey % 9 <> 0) c {} JOIN (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders WHERE o_orderkey % 7 <> 0) o ON c_custkey = o_custkey"


@query("SELECT c_custkey AS cust, c_name AS name, price FROM " + _SIDES.format(""))
def join_incremental(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d, "inner")


@query("SELECT c_custkey AS cust, c_name AS name, price FROM " + _SIDES.format("LEFT"))
def join_incremental_left(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d, "left")


@query("SELECT coalesce(c_custkey, o_custkey) AS cust, c_name AS name, price FROM " + _SIDES.format("FULL"))
def join_incremental_full(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d, "full")


def cogrouped(spark: SparkSession, d: str, producer: Producer) -> DataFrame:
    """Customers beside their orders; then every seventh order and every ninth customer goes."""
    g = Graph(spark)
    c = g.source("c", "bigint", "string")
    o = g.source("o", "bigint", "bigint", native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value").alias("target_key"), F.col("key").alias("value"))), target_key="bigint", target_value="bigint")
    both = c.cogroups("both", o, producer, "bigint", "struct<name:string,n:bigint>")
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    names, wave = keyed(customer, F.col("c_custkey"), F.col("c_name")), keyed(orders, F.col("o_orderkey"), F.col("o_custkey"))
    g.update({"c": names, "o": wave})
    g.update({"o": deletes(orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("key")), wave)})
    g.update({"c": deletes(customer.where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("key")), names)})
    return both.read().select(F.col("target_key").alias("cust"), "value.name", "value.n")


def counted_beside(how: str) -> Producer:
    """The names of a key with the number of values on the other side."""

    def made(left: DataFrame, right: DataFrame) -> DataFrame:
        n = right.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n"))
        rows = left.join(n, F.col("key").eqNullSafe(F.col("k")), how)
        return rows.select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), F.struct(F.col("value").alias("name"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")).alias("value"), "ordinal")

    return produce.cogroup_native(made)


_BESIDE = "SELECT c_custkey AS cust, c_name AS name, count(o_orderkey) AS n FROM (SELECT * FROM customer WHERE c_custkey % 9 <> 0) c {} JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o ON c_custkey = o_custkey GROUP BY 1, 2"


@query(_BESIDE.format(""))
def cogroup_inner(spark: SparkSession, d: str) -> DataFrame:
    return cogrouped(spark, d, counted_beside("inner"))


@query(_BESIDE.format("LEFT"))
def cogroup_left(spark: SparkSession, d: str) -> DataFrame:
    return cogrouped(spark, d, counted_beside("left"))


def _beside(key, names, orders):
    n = sum(1 for _ in orders)
    for name in names:
        yield key, {"name": name, "n": n}


@query(_BESIDE.format("LEFT"))
def cogroup_arrow(spark: SparkSession, d: str) -> DataFrame:
    return cogrouped(spark, d, produce.cogroup_arrow(_beside, "bigint", "struct<name:string,n:bigint>"))


@query(
    "SELECT upper(substr(c_mktsegment, 1, 1)) || '/' || CAST(c_nationkey AS VARCHAR) AS grp, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS left_sum, CAST(sum(s_suppkey) AS BIGINT) AS right_sum "
    "FROM (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c JOIN (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'B' ELSE 'F' END AS f FROM supplier) s ON c_nationkey = s_nationkey AND substr(c_mktsegment, 1, 1) = f GROUP BY 1"
)
def join_coarse_key(spark: SparkSession, d: str) -> DataFrame:
    """A join on keys that agree in part only: letters count without case, and a last field of the key not at all."""
    rows = coarse_graph(spark, d).read().select(F.concat_ws("/", F.upper("target_key.letter"), F.col("target_key.nation").cast("string")).alias("grp"), "value.left", "value.right")
    # sums over all pairs of a group, from both sides' own sums
    pairs = {"n": "left.n * right.n", "left_sum": "left.total * right.n", "right_sum": "right.total * left.n"}
    return rows.groupBy("grp").agg(*[F.sum(F.expr(x)).alias(name) for name, x in pairs.items()])


def coarse_graph(spark: SparkSession, d: str) -> Stage:
    """Customers and suppliers counted and summed by coarse key, then joined: the pairs of a group are as many as its
    customers times its suppliers, and their sums need none of them."""
    coarse = KeySpec(("upper(key.letter)", "key.nation"))
    kind = "struct<letter:string,nation:int,id:bigint>"

    def side(letter: str) -> Producer:
        key = F.struct(F.expr(letter).alias("letter"), F.col("value.nation").alias("nation"), F.col("key").alias("id"))
        return native(lambda u: u.select(F.col("key").alias("source_key"), key.alias("target_key"), F.col("key").alias("value"), "ordinal"))

    g = Graph(spark)
    value, sums = "struct<nation:int,word:string>", "struct<n:bigint,total:bigint>"
    c = g.source("c", "bigint", value, side("upper(substr(value.word, 1, 1))"), target_key=kind, target_value="bigint", target_keys=coarse)
    s = g.source("s", "bigint", value, side("lower(substr(value.word, 1, 1))"), target_key=kind, target_value="bigint", target_keys=coarse)
    # a spelling of the letter has its own sums, under the least id
    summed = native(
        lambda u: u.groupBy("key.letter", "key.nation").agg(F.min("key.id").alias("id"), F.count("*").alias("n"), F.sum("value").alias("total")).select(F.struct("letter", "nation", "id").alias("source_key"), F.struct("letter", "nation", "id").alias("target_key"), F.struct("n", "total").alias("value"))
    )
    left, right = (x.produces(f"{x.name}_sums", summed, kind, sums, target_keys=coarse) for x in (c, s))
    both = left.joins("both", right)
    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    wave = keyed(customer, F.col("c_custkey"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("word")))
    g.update({"c": wave, "s": keyed(supplier, F.col("s_suppkey"), F.struct(F.col("s_nationkey").alias("nation"), F.expr("if(s_suppkey % 2 = 0, 'B', 'F')").alias("word")))})
    g.update({"c": deletes(customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("key")), wave)})
    return both


@query(f"SELECT o_custkey % 100 AS key, count(*) AS n, CAST(sum(price) AS DECIMAL(28,2)) AS total FROM (SELECT * FROM {ORDERS} WHERE price < 100000 UNION ALL SELECT * FROM {ORDERS} WHERE price >= 50000) x GROUP BY 1")
def diamond_graph(spark: SparkSession, d: str) -> DataFrame:
    """Two filters of one stage, rekeyed and merged again; rows that pass both count twice."""

    def below(s: Stage) -> Stage:
        low = s.produces("low", native(lambda u: u.where("value.price < 100000").select(F.col("key").alias("source_key"), (F.col("key") % 100).alias("target_key"), F.col("value.price").alias("value"), "ordinal")), "bigint", "decimal(18,2)")
        high = s.produces("high", native(lambda u: u.where("value.price >= 50000").select(F.col("key").alias("source_key"), (F.col("key") % 100).alias("target_key"), F.col("value.price").alias("value"), "ordinal")), "bigint", "decimal(18,2)")
        return low.produces("both", totals(), "bigint", TOTALS, (high,))

    return orders_graph(spark, d, below)[1].read().select(F.col("target_key").alias("key"), "value.n", "value.total")


@query("SELECT k AS key, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_nationkey FROM supplier) x GROUP BY k")
def multi_root_graph(spark: SparkSession, d: str) -> DataFrame:
    """Two roots; the second wave goes to one of them, and the idle one keeps its rows."""
    g = Graph(spark)
    a = g.source("c", "bigint", "int", rekey("value", "1L"), target_key="int", target_value="bigint")
    b = g.source("s", "bigint", "int", rekey("value", "1L"), target_key="int", target_value="bigint")
    counted = native(lambda u: u.groupBy("key").agg(F.count("*").alias("n")).select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), F.col("n").alias("value")))
    n = a.produces("n", counted, "int", "bigint", (b,))
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    wave = keyed(c, F.col("c_custkey"), F.col("c_nationkey"))
    g.update({"c": wave, "s": keyed(s, F.col("s_suppkey"), F.col("s_nationkey"))})
    g.update({"c": deletes(c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("key")), wave)})
    return n.read().select(F.col("target_key").alias("key"), F.col("value").alias("n"))


@query(f"SELECT o_custkey AS target_key, o_orderkey AS source_key, price FROM {ORDERS_1}")
def version_time_travel(spark: SparkSession, d: str) -> DataFrame:
    """Version 1 read after version 2."""
    return flat(orders_graph(spark, d)[1].read(version=1))


@query(f"SELECT 3 AS version, o_custkey AS cust, CAST(sum(price) AS DECIMAL(28,2)) AS total FROM (SELECT * FROM {ORDERS} WHERE o_orderkey % 11 <> 0) x GROUP BY o_custkey UNION ALL SELECT 1, o_custkey, CAST(sum(price) AS DECIMAL(28,2)) FROM {ORDERS_1} GROUP BY o_custkey")
def reopened_store(spark: SparkSession, d: str) -> DataFrame:
    """A third wave by a graph that opens the store anew, and version 1 read by yet another: both as they should be."""
    below = lambda s: s.produces("totals", totals("value.price"), "bigint", TOTALS)
    store = session_store(spark)
    orders_graph(spark, d, below, store=store)
    g = Graph(spark, ParquetStore(store.root))
    below(g.source("by_customer", "bigint", PRICED, rekey("value.cust"), target_key="bigint", target_value=PRICED))
    orders = table(spark, d, "orders")
    like = keyed(orders, F.col("o_orderkey"), F.struct(F.col("o_custkey").alias("cust"), price("o_totalprice").alias("price")))
    g.update({"by_customer": deletes(orders.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("key")), like)})
    again = Graph(spark, ParquetStore(store.root))
    s = below(again.source("by_customer", "bigint", PRICED, rekey("value.cust"), target_key="bigint", target_value=PRICED))
    versions = [s.read(version=v).select(F.lit(v).alias("version"), F.col("target_key").alias("cust"), "value.total") for v in (again.version, 1)]
    return versions[0].unionByName(versions[1])


@query("SELECT 'update' AS type, o_custkey AS key, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY o_custkey")
def suppressed_feed(spark: SparkSession, d: str) -> DataFrame:
    """All orders are sent again, every fifth with another price: only customers with one of those are in the feed."""
    g = Graph(spark)
    s = g.source("o", "bigint", PRICED, rekey("value.cust", "value.price"), target_key="bigint", target_value="decimal(18,2)", suppress_unchanged=True)
    orders = table(spark, d, "orders")
    wave = lambda more: keyed(orders, F.col("o_orderkey"), F.struct(F.col("o_custkey").alias("cust"), (price("o_totalprice") + F.expr(more)).cast("decimal(18,2)").alias("price")))
    g.update({"o": wave("0")})
    g.update({"o": wave("if(o_orderkey % 5 = 0, 1, 0)")})
    return s.read("updates").groupBy("type", "key").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS feed_rows, (SELECT count(*) FROM supplier) AS content_rows FROM supplier WHERE false")
def no_feed(spark: SparkSession, d: str) -> DataFrame:
    """A stage that is told to write no feed has its content all the same."""
    g = Graph(spark)
    s = g.source("s", "bigint", "string", emit_updates=False)
    g.update({"s": keyed(table(spark, d, "supplier"), F.col("s_suppkey"), F.col("s_name"))})
    return s.read("updates").agg(F.count("*").alias("feed_rows")).crossJoin(s.read().agg(F.count("*").alias("content_rows")))


@query("SELECT 'nation.parquet' AS source_key, n_regionkey AS target_key, n_name AS name FROM nation")
def whole_file_key(spark: SparkSession, d: str) -> DataFrame:
    """A file under its own name: sending it again replaces all that it made."""
    g = Graph(spark)
    wave = whole_file(spark, f"{d}/nation.parquet")
    kind = wave.schema["value"].dataType
    s = g.source("files", "string", kind, rekey("value.n_regionkey", "value.n_name"), target_key=kind["n_regionkey"].dataType, target_value="string")
    g.update({"files": wave})
    g.update({"files": wave})
    return s.read().select("source_key", "target_key", F.col("value").alias("name"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey AS cust, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE min(c_custkey) OVER (PARTITION BY c_nationkey) END AS first FROM customer")
def preserve_merged(spark: SparkSession, d: str) -> DataFrame:
    """Values that take their first writer from an example: in the first wave that of the key's first row; the second
    wave sends every third customer under a flag that takes its own number instead."""
    kind = "struct<first:bigint,own:boolean>"
    keep = lambda new, old: F.struct(F.when(new["own"] | old.isNull(), new["first"]).otherwise(old["first"]).alias("first"), new["own"].alias("own"))
    g = Graph(spark)
    made = native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value.nation").alias("target_key"), F.struct(F.col("key").alias("first"), F.col("value.own").alias("own")).alias("value")))
    s = g.source("c", "bigint", "struct<nation:bigint,own:boolean>", made, target_key="bigint", target_value=kind, preserved=Preserve(merge=keep))
    customer = table(spark, d, "customer")
    wave = lambda df, own: keyed(df, F.col("c_custkey"), F.struct(F.col("c_nationkey").cast("bigint").alias("nation"), F.lit(own).alias("own")))
    g.update({"c": wave(customer, False)})
    g.update({"c": wave(customer.where("c_custkey % 3 = 0"), True)})
    return s.read().select(F.col("target_key").alias("nation"), F.col("source_key").alias("cust"), "value.first")


@query("SELECT count(DISTINCT p_brand) AS keys, count(DISTINCT p_brand) AS ids, CAST(0 AS BIGINT) AS changed FROM part")
def preserve_uuids(spark: SparkSession, d: str) -> DataFrame:
    """One identifier a brand, the same before and after half of the parts are sent again."""
    g = Graph(spark)
    made = native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value").alias("target_key"), F.struct(F.lit("").alias("id")).alias("value")))
    s = g.source("p", "bigint", "string", made, target_key="string", target_value="struct<id:string>", preserved=Preserve(("id",), "uuid"))
    part = table(spark, d, "part")
    g.update({"p": keyed(part, F.col("p_partkey"), F.col("p_brand"))})
    g.update({"p": keyed(part.where("p_partkey % 2 = 0"), F.col("p_partkey"), F.col("p_brand"))})
    old, new = (s.read(version=v).select("target_key", F.col("value.id").alias(f"id{v}")).distinct() for v in (1, 2))
    return old.join(new, "target_key").agg(F.countDistinct("target_key").alias("keys"), F.countDistinct("id2").alias("ids"), F.count_if(F.col("id1") != F.col("id2")).alias("changed"))


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id")
def stream_waves(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark)
    s = g.source("events", "bigint", "bigint", rekey("value", "1L"), target_key="bigint", target_value="bigint")
    counted = native(lambda u: u.groupBy("key").agg(F.count("*").alias("n")).select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), F.col("n").alias("value")))
    n = s.produces("per_user", counted, "bigint", "bigint")
    kind = table(spark, d, "events").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "events*.parquet").parquet(d)
    stream_graph(g, "events", rows, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", lambda b: keyed(b, F.col("event_id"), F.col("user_id"))).awaitTermination()
    return n.read().select(F.col("target_key").alias("key"), F.col("value").alias("n"))
