"""What keeps waves in proportion to their input on large tables."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from wavekeep.functions.keys import KeySpec
from wavekeep.operators import produce, reconcile
from wavekeep.operators.join import join_wave
from wavekeep.operators.merge import affected_keys
from wavekeep.operators.produce import native
from wavekeep.plans import catalogue
from wavekeep.plans.graph import Graph
from wavekeep.sources.schema import check_wave

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTENT = "target_key string, source_key string, value bigint, _ord bigint"
DIR = "/root/testdata/sf0.01"


def test_coarse_join_has_no_pairs(spark):
    """the stage has a row for each group, not one for each customer beside each supplier of a group."""
    groups = catalogue.QUERIES["join_coarse_key"](spark, DIR)
    both = catalogue.coarse_graph(spark, DIR).read()
    assert both.count() == groups.count() < groups.agg(F.sum("n")).first()[0]


def test_pandas_groups_are_cut_from_batches(spark):
    """groups share batches, and one may go over several; NaN is one group, and so is null."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        keys = [None, float("nan"), 1.5, 2.0, 3.0]
        rows = [("add", k, i, i) for n, k in enumerate(keys) for i in range(n * n + 1)]
        df = spark.createDataFrame(rows, "type string, key double, value bigint, ordinal bigint")
        p = produce.pandas(lambda k, rows: [(k, list(rows.index) == list(range(len(rows))) and int((rows["value"] * rows["ordinal"]).sum()) * 100 + len(rows))], "double", "bigint")
        out = p.apply(df, KeySpec())
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        found = {str(r["target_key"]): r["value"] for r in out.collect()}
        assert out.count() == len(keys)
        assert found == {str(k): sum(i * i for i in range(n * n + 1)) * 100 + n * n + 1 for n, k in enumerate(keys)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_string_keys_are_hashed(spark):
    """distinct keys of a wave are found without sorting all rows of a task."""
    rows = spark.createDataFrame([("a", "x", 1, 0), ("a", "y", 2, 0), (None, "x", 3, 0)], CONTENT)
    feed = rows.selectExpr("'update' type", "target_key key", "value", "_ord ordinal")
    spec = KeySpec()
    changed = reconcile.changed_keys(feed, spec)
    touched = reconcile.touched_keys(rows.select("source_key", "target_key"), changed.selectExpr("'x' key").distinct(), rows, spec, spec)
    affected = affected_keys([feed, feed], spec)
    for df in (changed, touched, affected):
        assert "SortAggregate" not in planned(df)
    assert {r["key"] for r in changed.collect()} == {r["key"] for r in affected.collect()} == {"a", None}
    assert {tuple(r) for r in touched.collect()} == {("a", 1, 2), (None, 1, 1)}


def test_feed_sorts_new_keys_only(spark):
    """rows of keys that were there go into a feed as they are; those of new keys are sorted once."""
    rows = spark.createDataFrame([("a", "x", 1, 0), ("a", "y", 2, 0), ("b", "x", 3, 0)], CONTENT)
    touched = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", True, False)], "key string, known boolean, alive boolean")
    spec = KeySpec()
    bulk = planned(reconcile.change_feed(None, None, rows, spec))
    assert bulk.count("Window ") == 1 and "Join" not in bulk and "Aggregate" not in bulk
    assert "Window " not in planned(reconcile.change_feed(touched, rows, rows, spec, fresh=False))
    feed = reconcile.change_feed(touched, rows, rows, spec)
    assert sorted(tuple(r) for r in feed.select("type", "key", "value").fillna(0).collect()) == [("add", "b", 3), ("delete", "c", 0), ("update", "a", 1), ("update", "a", 2)]


def test_hot_new_keys(spark, monkeypatch):
    """the rows of a frequent new key are dealt out, and its feed has one add, that of the first source."""
    monkeypatch.setattr(reconcile, "HOT", 64)
    g = Graph(spark)
    s = g.source("s", "bigint", "bigint", native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value").alias("target_key"), F.col("key").alias("value"))), target_key="bigint", target_value="bigint")
    for wave in range(2):  # an empty stage, then new keys beside old ones
        ids = spark.range(wave * 2000, wave * 2000 + 2000)
        g.update({"s": ids.selectExpr("'add' type", "id key", f"if(id % 2 = 0, {wave}, id + 10) value", "0L ordinal")})
        feed = s.read("updates").collect()
        adds = {r["key"]: r["value"] for r in feed if r["type"] == "add"}
        assert len(feed) == 2000 and len(adds) == sum(r["type"] == "add" for r in feed) == 1001
        assert adds[wave] == wave * 2000


def test_a_join_is_run_once(spark):
    """The keys without result are found from keys, not by running the join again; a bulk load joins only its sides."""
    sides = [spark.createDataFrame([(k, k, i, 0) for i, k in enumerate(ks)], CONTENT) for ks in (["a", "b", "b"], ["b", "c"])]
    affected = affected_keys([s.selectExpr("target_key key") for s in sides]).unionByName(spark.createDataFrame([("d", "d")], "key string, _g string"))
    for how, rows, gone in (("inner", 2, "acd"), ("left", 3, "cd"), ("right", 3, "ad"), ("full", 4, "d")):
        wave = join_wave(tuple(sides), affected, how)
        found = wave.collect()
        assert sum(r["type"] == "update" for r in found) == rows and sorted(r["key"] for r in found if r["type"] == "delete") == list(gone)
        assert wave._jdf.queryExecution().analyzed().toString().count("Join ") <= 5
        bulk = join_wave(tuple(sides), None, how)
        assert bulk._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        assert bulk.count() == rows


def test_upserts_are_not_grouped_by_key(spark):
    """a wave without deletes has nothing to check by key."""
    rows = spark.createDataFrame([("add", 1, 1, 0), ("update", 1, 2, 1)], "type string, key int, value int, ordinal bigint")
    check_wave(rows, F.raise_error(F.lit("grouped")).cast("int"))


def test_touched_keys_are_found_once(spark, monkeypatch):
    """a stage takes its changed keys from what its sources found, not from the rows of their feeds."""
    asked = []
    monkeypatch.setattr(reconcile, "changed_keys", lambda u, spec, real=reconcile.changed_keys: asked.append(1) or real(u, spec))
    g = Graph(spark)
    a, b = g.source("a", "int", "string"), g.source("b", "int", "string")
    n = a.cogroups("n", b, produce.cogroup_arrow(lambda k, x, y: [(k, len(x) * 10 + sum(1 for _ in y))], "int", "int"), "int", "int")
    wave = lambda keys: spark.createDataFrame([("add", k, "v", 0) for k in keys], "type string, key int, value string, ordinal bigint")
    g.update({"a": wave([1, 2]), "b": wave([2, 3])})
    assert not asked
    g.update({"b": wave([1]).unionByName(wave([3]).selectExpr("'delete' type", "key", "cast(null as string) value", "ordinal"))})
    assert len(asked) == 1  # that of b
    assert {(r["target_key"], r["value"]) for r in n.read().collect()} == {(1, 11), (2, 11)}
