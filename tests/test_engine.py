"""Waves through stages: golden scenarios, edge cases, and incremental against full recomputation."""

import importlib
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wavekeep.functions.keys import KeySpec
from wavekeep.functions.text import copies, words
from wavekeep.operators import feed, produce
from wavekeep.operators.merge import merge_sources
from wavekeep.operators.preserve import Preserve
from wavekeep.operators.produce import native
from wavekeep.plans.graph import Graph
from wavekeep.sources.schema import WaveError
from wavekeep.sources.store import ParquetStore, Scratch
from wavekeep.streaming.waves import stream_graph

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def wave(spark, rows, key="int", value="string"):
    """(key, value) upserts in order; (key,) a delete."""
    data = [("delete", r[0], None, 0) if len(r) == 1 else ("add", r[0], r[1], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"type string, key {key}, value {value}, ordinal bigint")


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


NAME = "struct<first:string,last:string,copies:int>"
COPY = "struct<id:int,name:string,copy:int>"


def expanded_native():
    def made(u):
        g = u.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.min_by("value", "ordinal").alias("v"), F.max("value.copies").alias("most"))
        g = g.select("key", "n", "v", F.explode(copies(F.col("most"))).alias("copy"))
        value = F.struct(F.col("key").alias("id"), F.concat_ws(" ", "v.first", "v.last").alias("name"), "copy")
        return g.select(F.col("key").alias("source_key"), F.col("n").alias("target_key"), value.alias("value"), F.col("copy").cast("long").alias("ordinal"))

    return native(made)


def _expand(key, values):
    values = list(values)
    for i in range(1, max(v["copies"] for v in values) + 1):
        yield len(values), {"id": key, "name": f"{values[0]['first']} {values[0]['last']}", "copy": i}


@pytest.mark.parametrize("tier", ["native", "pandas", "arrow"])
def test_many_to_many(spark, tier):
    p = {"native": expanded_native, "pandas": lambda: produce.pandas(lambda k, rows: _expand(k, rows["value"]), "int", COPY), "arrow": lambda: produce.arrow(_expand, "int", COPY)}[tier]()
    g = Graph(spark)
    s = g.source("people", "int", NAME, p, target_key="int", target_value=COPY)
    steps = [
        ([(1, ("Ada", "Moss", 1)), (2, ("Bo", "Reed", 1)), (2, ("Bo", "Moss", 1)), (3, ("Ada", "Reed", 1))], [(1, 1, "Ada Moss", 1), (1, 3, "Ada Reed", 1), (2, 2, "Bo Reed", 1)], [(1, 1), (2, 2), (3, 1)]),
        ([(1, ("Ada", "Moss", 3))], [(1, 1, "Ada Moss", 1), (1, 1, "Ada Moss", 2), (1, 1, "Ada Moss", 3), (1, 3, "Ada Reed", 1), (2, 2, "Bo Reed", 1)], [(1, 1)] * 3 + [(2, 2), (3, 1)]),
        ([(3, ("Cy", "Reed", 1)), (3, ("Ada", "Reed", 1))], [(1, 1, "Ada Moss", 1), (1, 1, "Ada Moss", 2), (1, 1, "Ada Moss", 3), (2, 2, "Bo Reed", 1), (2, 3, "Cy Reed", 1)], [(1, 1)] * 3 + [(2, 2), (3, 2)]),
        ([(2,)], [(1, 1, "Ada Moss", 1), (1, 1, "Ada Moss", 2), (1, 1, "Ada Moss", 3), (2, 3, "Cy Reed", 1)], [(1, 1)] * 3 + [(3, 2)]),
    ]
    for rows, content, mappings in steps:
        g.update({"people": wave(spark, rows, value=NAME)})
        assert got(s.read().select("target_key", "source_key", "value.name", "value.copy"), "target_key", "source_key", "name", "copy") == sorted(content, key=repr)
        assert got(s.read("key_mappings"), "source_key", "target_key") == sorted(mappings)


PHRASES = [(1, "the quick red hen"), (2, "hops over the idle pig"), (3, "at times a pig is red"), (4, "red is my preferred hue")]
BOOKS = [(1, "the mind patrol"), (2, "at times the hen is idle"), (3, "the riddle of pig manor")]


def word_graph(spark):
    g = Graph(spark)
    a, b = g.source("phrases", "int", "string"), g.source("books", "int", "string")
    split = native(lambda u: u.select(F.col("key").alias("source_key"), F.posexplode(words(F.col("value"))).alias("ordinal", "target_key"), F.col("key").alias("value")))
    ids = a.produces("ids", split, "string", "int", (b,))
    count = native(lambda u: u.groupBy("key").agg(F.count("*").cast("int").alias("n")).select(F.col("key").alias("source_key"), F.col("n").alias("target_key"), F.col("key").alias("value")))
    return g, a, b, ids, ids.produces("counts", count, "int", "string", target_keys=KeySpec(order=("key DESC",)))


def brute_counts(*sets):
    n = {}
    for s in sets:
        for _, t in s:
            for w in t.split(" "):
                n[w] = n.get(w, 0) + 1
    return sorted(((c, w) for w, c in n.items()), key=repr)


def test_word_counting(spark):
    g, a, b, ids, counts = word_graph(spark)
    g.update({"phrases": wave(spark, PHRASES), "books": wave(spark, BOOKS)})
    assert all(t == "add" for (t,) in got(a.read("updates"), "type"))
    assert got(counts.read(), "target_key", "value") == brute_counts(PHRASES, BOOKS)
    g.update({"phrases": wave(spark, [(2,)])})
    assert got(a.read("updates"), "type", "key", "value") == [("delete", 2, None)]
    held = g._held(2)
    merged = merge_sources([(a.read("updates"), g._read(a, "content", held["phrases"])), (b.read("updates").limit(0), g._read(b, "content", held["books"]))])
    assert got(merged, "type", "key", "value") == [("update", 2, "at times the hen is idle")]
    assert got(counts.read(), "target_key", "value") == brute_counts([p for p in PHRASES if p[0] != 2], BOOKS)
    changes = got(ids.read("updates"), "type", "key", "value")
    assert {k for t, k, _ in changes if t == "delete"} == {"hops", "over"}
    assert [(t, v) for t, k, v in changes if k == "the"] == [("update", 1), ("update", 1), ("update", 2), ("update", 3)]
    assert [r["target_key"] for r in counts.read().orderBy(*counts.target_keys.sort("target_key")).collect()][0] == 4


def test_preserved_ids(spark):
    g = Graph(spark)
    split = native(lambda u: u.select(F.col("key").alias("source_key"), F.posexplode(words(F.col("value"))).alias("ordinal", "target_key"), F.struct(F.lit(0).alias("id")).alias("value")))
    s = g.source("animals", "int", "string", split, target_key="string", target_value="struct<id:int>", preserved=Preserve(("id",)))
    steps = [
        ([(1, "ox rat"), (2, "ox cow"), (3, "yak ox cow")], {"cow": 1, "ox": 2, "rat": 3, "yak": 4}, None),
        ([(2, "wasp yak ant")], {"ant": 5, "cow": 1, "ox": 2, "rat": 3, "wasp": 6, "yak": 4}, {("add", "ant"), ("update", "cow"), ("update", "ox"), ("update", "yak"), ("add", "wasp")}),
        ([(1, "ox wasp")], {"ant": 5, "cow": 1, "ox": 2, "wasp": 6, "yak": 4}, {("delete", "rat"), ("update", "ox"), ("update", "wasp")}),
        ([(1, "ox rat")], {"ant": 5, "cow": 1, "ox": 2, "rat": 7, "wasp": 6, "yak": 4}, {("add", "rat"), ("update", "ox"), ("update", "wasp")}),
    ]
    for rows, ids, changes in steps:
        g.update({"animals": wave(spark, rows)})
        assert dict(got(s.read().select("target_key", "value.id").distinct(), "target_key", "id")) == ids
        if changes:
            assert set(got(s.read("updates"), "type", "key")) == changes
    adds = [k for t, k in got(s.read("updates"), "type", "key") if t == "add"]
    assert adds == ["rat"]


def test_edges(spark):
    g = Graph(spark)
    tk = native(lambda u: u.select(F.col("key").alias("source_key"), F.lit(105).alias("target_key"), "value", "ordinal"))
    s = g.source("s", "int", "string", tk, target_key="int", target_value="string")
    n = s.produces("n", native(lambda u: u.groupBy("key").agg(F.count("*").alias("value")).select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), "value")), "int", "bigint")
    g.update({"s": wave(spark, [(6, "apple"), (9, "banana"), (None, "fig"), (1, None)])})
    g.update({"s": wave(spark, [(9,), (None,), (77,)])})
    assert got(s.read("updates"), "type", "key", "value") == [("update", 105, "apple"), ("update", 105, None)]
    assert got(n.read(), "target_key", "value") == [(105, 2)]
    g.update({"s": wave(spark, [(6,), (1,)])})
    assert got(s.read("updates"), "type", "key", "value") == [("delete", 105, None)] and n.read().count() == 0
    g.update({"s": wave(spark, [(5,)])})
    assert s.read("updates").count() == 0
    with pytest.raises(WaveError):
        g.update({"s": wave(spark, [(1,), (1, "x")])})
    with pytest.raises(WaveError):
        g.update({"s": wave(spark, [(1,), (1,)])})
    with pytest.raises(ValueError):
        g.source("s", "int", "string")
    with pytest.raises(ValueError):
        s.produces("twice", tk, "int", "string", (s,))
    with pytest.raises(ValueError):
        g.update({"n": wave(spark, [])})


def test_values_are_read_once(spark):
    def twice(key, values):
        list(values)
        yield key, len(list(values))

    g = Graph(spark)
    g.source("s", "int", "string", produce.arrow(twice, "int", "int"), target_key="int", target_value="int")
    with pytest.raises(Exception, match="read once"):
        g.update({"s": wave(spark, [(1, "a"), (1, "b")])})
    first = produce.arrow(lambda k, v: [(k, next(iter(v)))], "int", "string")
    g = Graph(spark)
    s = g.source("s", "int", "string", first, target_key="int", target_value="string")
    g.update({"s": wave(spark, [(1, "a"), (1, "b"), (2, "c"), (2, "d")])})
    assert got(s.read(), "target_key", "value") == [(1, "a"), (2, "c")]


def test_coarse_keys(spark):
    kind = "struct<ref:string,amount:int,credit:boolean>"
    g = Graph(spark)
    made = native(lambda u: u.select(F.col("key").alias("source_key"), F.struct(F.col("value.ref").alias("ref"), F.abs("value.amount").alias("amount"), (F.col("value.amount") < 0).alias("credit")).alias("target_key"), F.struct("value.amount").alias("value")))
    s = g.source("t", "string", "struct<ref:string,amount:int>", made, target_key=kind, target_value="struct<amount:int>", target_keys=KeySpec(("key.ref", "key.amount")))
    g.update({"t": wave(spark, [("a", ("x", 5)), ("b", ("x", -5)), ("c", ("y", 5))], "string", "struct<ref:string,amount:int>")})
    g.update({"t": wave(spark, [("a",)], "string", "struct<ref:string,amount:int>")})
    assert [(t, k["credit"]) for t, k in got(s.read("updates"), "type", "key")] == [("update", True)]
    g.update({"t": wave(spark, [("b",)], "string", "struct<ref:string,amount:int>")})
    assert [(t, k["ref"]) for t, k in got(s.read("updates"), "type", "key")] == [("delete", "x")]


def test_random_waves_equal_full_recomputation(spark, tmp_path):
    rng = random.Random(11)
    split = native(lambda u: u.select(F.col("key").alias("source_key"), F.posexplode(words(F.col("value"))).alias("ordinal", "target_key"), F.col("value").alias("value")))
    g = Graph(spark, ParquetStore(str(tmp_path / "store"), buckets=3))
    s = g.source("s", "int", "string", split, target_key="string", target_value="string")
    state, values = {}, spark.createDataFrame([], "key string, value string")
    for v in range(1, 5):
        rows, before = [], dict(state)
        for k in rng.sample([None, *range(12)], 6):
            if rng.random() < 0.3:
                rows.append((k,))
                state.pop(k, None)
            else:
                state[k] = [" ".join(rng.choices("abcdefg", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 2))]
                rows += [(k, t) for t in state[k]]
        g.update({"s": wave(spark, rows)})
        want = sorted(((w, k, t) for k, ts in state.items() for t in ts for w in t.split(" ")), key=repr)
        assert got(s.read(), "target_key", "source_key", "value") == want
        assert got(s.read("key_mappings"), "source_key", "target_key") == sorted(((k, w) for w, k, _ in want), key=repr)
        changes = s.read("updates")
        values = spark.createDataFrame(got(feed.apply_feed(values, changes), "key", "value"), "key string, value string")
        assert got(values, "key", "value") == sorted(((w, t) for w, _, t in want), key=repr)
        was, now = {w for ts in before.values() for t in ts for w in t.split(" ")}, {w for w, *_ in want}
        assert {k for (k,) in got(feed.deleted_keys(changes), "key")} == was - now
        assert got(feed.added_keys(changes), "key") == sorted((k,) for k in now - was)
    fresh = Graph(spark, ParquetStore(str(tmp_path / "store")))
    again = fresh.source("s", "int", "string", split, target_key="string", target_value="string")
    assert got(again.read(version=4), "target_key", "source_key", "value") == want
    second = got(again.read(version=2), "target_key", "source_key", "value")
    assert fresh.version == 4
    fresh.update({"s": wave(spark, [(0, "z")])}, based_on=1)
    assert fresh.version == 5 and ("z", 0, "z") in got(again.read(), "target_key", "source_key", "value")
    assert got(again.read(version=2), "target_key", "source_key", "value") == second
    with pytest.raises(ValueError):
        fresh.read("s", version=99)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    def run(name):
        g = Graph(spark, ParquetStore(str(tmp_path / "store")))
        s = g.source("s", "int", "string")
        rows = spark.readStream.schema("type string, key int, value string, ordinal bigint").parquet(str(tmp_path / "in"))
        stream_graph(g, "s", rows, str(tmp_path / name)).awaitTermination()
        return g.version, got(s.read(), "target_key", "value")

    wave(spark, [(1, "a b"), (2, "b")]).write.parquet(str(tmp_path / "in"))
    assert run("c1") == (1, [(1, "a b"), (2, "b")])
    wave(spark, [(3, "c")]).write.mode("append").parquet(str(tmp_path / "in"))
    assert run("c1") == (2, [(1, "a b"), (2, "b"), (3, "c")])
    # as if the process had ended between the commit of the wave and that of the batch
    for f in (tmp_path / "c1" / "commits").iterdir():
        if f.name.strip(".") in ("1", "1.crc"):
            f.unlink()
    assert run("c1") == (2, [(1, "a b"), (2, "b"), (3, "c")])
    assert run("another")[0] == 3  # another stream's first batch is its own


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_a_new_graph_a_wave(spark, tmp_path):
    def opened():
        g = Graph(spark, ParquetStore(str(tmp_path / "store"), buckets=4))
        a, b = g.source("a", "int", "string"), g.source("b", "int", "string")
        return g, a, b, a.produces("both", native(lambda u: u.select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), "value", "ordinal")), "int", "string", (b,))

    waves = [{"a": [(1, "x"), (2, "y")], "b": [(1, "p")]}, {"b": [(3, "q")]}, {"a": [(1,), (5, "z")]}, {"b": [(1,), (2, "r")]}]
    states, seen = {"a": {}, "b": {}}, []
    for n, w in enumerate(waves, 1):
        g, *_ = opened()
        assert g.version == n - 1
        before = files(tmp_path / "store")
        g.update({k: wave(spark, rows) for k, rows in w.items()})
        after = files(tmp_path / "store")
        assert before == {p: after[p] for p in before}
        for k, rows in w.items():
            for row in rows:
                states[k].pop(row[0], None)
                if len(row) == 2:
                    states[k][row[0]] = row[1]
        seen.append(sorted([*states["a"].items(), *states["b"].items()]))
    g, a, b, both = opened()
    assert g.version == 4
    for n, want in enumerate(seen, 1):
        assert got(both.read(version=n), "target_key", "value") == want
    assert got(a.read(), "target_key", "value") == sorted(states["a"].items())
    assert g.vacuum(2) == [1, 2] and got(both.read(version=3), "target_key", "value") == seen[2]
    assert got(both.read(), "target_key", "value") == seen[3]
    with pytest.raises(ValueError):
        both.read(version=1)


def test_a_wave_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    store = ParquetStore(str(tmp_path / "store"), buckets=8)
    g = Graph(spark, store)
    s = g.source("s", "int", "string")
    g.update({"s": wave(spark, [(i, "v") for i in range(200)])})
    report = g.update({"s": wave(spark, [(7, "w"), (900,)])})
    first, second = (g._held(v)["s"] for v in (1, 2))
    for kind in ("content", "key_mappings"):
        moved = {b for b in second[kind] if second[kind][b] != first[kind].get(b)}
        assert len(moved) <= 2 and len(second[kind]) == 8
    assert report.rows["s"]["touched"] == 1 and report.rows["s"]["updates"] == 1 and report.rows["s"]["content"] < 80
    assert got(s.read(), "target_key", "value") == sorted([(i, "w" if i == 7 else "v") for i in range(200)], key=repr)
    assert [r["target_key"] for r in g.read("s", ordered=True).collect()] == list(range(200))


def test_a_version_is_committed_once(spark, tmp_path):
    store = ParquetStore(str(tmp_path / "store"))
    store.commit(spark, {"version": 1, "stages": {}, "streams": {}})
    with pytest.raises(WaveError):
        store.commit(spark, {"version": 1, "stages": {"other": {}}, "streams": {}})
    assert store.manifest(spark, 1)["stages"] == {} and store.versions(spark) == [1]


def test_damage_is_noticed(spark, tmp_path):
    g = Graph(spark, ParquetStore(str(tmp_path / "store"), buckets=1))
    s = g.source("s", "int", "string")
    g.update({"s": wave(spark, [(1, "a"), (2, "b")])})
    where = str(next((tmp_path / "store" / "s").glob("*/content/_b=0")))
    rows = spark.read.parquet(where).where("target_key <> 1").collect()
    spark.createDataFrame(rows, s.graph._schema(s, "content")).coalesce(1).write.mode("overwrite").parquet(where)
    with pytest.raises(WaveError, match="damaged"):
        g.update({"s": wave(spark, [(1, "c")])})
    assert g.version == 1


def test_output_types_are_checked(spark):
    g = Graph(spark)
    g.source("s", "int", "string", native(lambda u: u.select(F.col("key").alias("source_key"), F.lit(1.5).alias("target_key"), "value")), target_key="int", target_value="string")
    with pytest.raises(WaveError, match="target_key"):
        g.update({"s": wave(spark, [(1, "a")])})


def test_cancel(spark, tmp_path):
    import threading
    import time

    mark = tmp_path / "began"

    def slow(key, values):
        mark.touch()
        time.sleep(20)
        yield key, "x"

    g = Graph(spark)
    s = g.source("s", "int", "string", produce.arrow(slow, "int", "string"), target_key="int", target_value="string")
    failed = []

    def run():
        try:
            g.update({"s": wave(spark, [(1, "a"), (2, "b"), (3, "c")])})
        except Exception as e:
            failed.append(e)

    t, began = threading.Thread(target=run), time.time()
    t.start()
    while not mark.exists() and time.time() - began < 60:
        time.sleep(0.05)
    g.cancel()
    t.join()
    assert failed and g.version == 0 and s.read().count() == 0
    assert spark.range(3).count() == 3


@pytest.mark.parametrize("tier", ["native", "pandas", "arrow"])
def test_large_numbers_beside_nulls(spark, tier):
    big = 9007199254740993
    kind = "struct<n:bigint>"
    p = {
        "native": native(lambda u: u.select(F.col("key").alias("source_key"), F.col("key").alias("target_key"), "value", "ordinal")),
        "pandas": produce.pandas(lambda k, rows: [(k, v) for v in rows["value"]], "int", "bigint"),
        "arrow": produce.arrow(lambda k, values: ((k, v) for v in values), "int", "bigint"),
    }[tier]
    g = Graph(spark)
    s = g.source("s", "int", "bigint", p)
    g.update({"s": wave(spark, [(1, big), (1, None)], value="bigint")})
    assert got(s.read(), "value") == [(big,), (None,)]
    if tier == "pandas":
        t = g.source("t", "int", kind, produce.pandas(lambda k, rows: [(k, v) for v in rows["value"]], "int", kind))
        g.update({"t": spark.createDataFrame([("add", 1, (big,), 0), ("add", 1, (None,), 1)], f"type string, key int, value {kind}, ordinal bigint")})
        assert got(t.read().select("value.n"), "n") == [(big,), (None,)]


def test_joins_under_coarse_keys(spark):
    lower = KeySpec(("lower(key)",))
    for spec in (lower, KeySpec(collation="UTF8_LCASE")):
        g = Graph(spark)
        a, b = g.source("a", "string", "int", target_keys=spec), g.source("b", "string", "int", target_keys=spec)
        both = a.joins("both", b, "full")
        count = a.cogroups("count", b, produce.cogroup_arrow(lambda k, x, y: [(k.lower(), len(x) * 100 + sum(1 for _ in y))], "string", "int"), "string", "int")
        g.update({"a": wave(spark, [("X", 1), ("y", 2)], "string", "int"), "b": wave(spark, [("x", 10), ("z", 30)], "string", "int")})
        rows = lambda: got(both.read().select(F.lower("target_key").alias("k"), "value.left", "value.right"), "k", "left", "right")
        assert rows() == [("x", 1, 10), ("y", 2, None), ("z", None, 30)]
        assert got(count.read(), "target_key", "value") == [("x", 101), ("y", 100), ("z", 1)]
        g.update({"b": wave(spark, [("x",), ("Y", 20)], "string", "int")})
        assert rows() == [("x", 1, None), ("y", 2, 20), ("z", None, 30)]
        assert got(count.read(), "target_key", "value") == [("x", 100), ("y", 101), ("z", 1)]


def test_preserved_values(spark):
    kind = "struct<id:string,n:int>"
    made = native(lambda u: u.select(F.col("key").alias("source_key"), F.lit("all").alias("target_key"), F.struct(F.concat(F.lit("new"), F.col("value")).alias("id"), F.length("value").alias("n")).alias("value")))

    def rows(s):
        return got(s.read().select("source_key", "value.id", "value.n"), "source_key", "id", "n")

    keep = lambda new, old: F.struct(F.coalesce(old["id"], new["id"]).alias("id"), new["n"].alias("n"))
    g = Graph(spark)
    s = g.source("s", "int", "string", made, target_key="string", target_value=kind, preserved=Preserve(merge=keep))
    g.update({"s": wave(spark, [(1, "a"), (2, "bb")])})
    assert rows(s) == [(1, "newa", 1), (2, "newa", 2)]  # the first row's value is the example of the key's others
    own = lambda new, old: F.struct(F.concat(F.coalesce(old["id"], F.lit("none")), F.lit("+"), new["id"]).alias("id"), new["n"].alias("n"))
    g = Graph(spark)
    s = g.source("s", "int", "string", made, target_key="string", target_value=kind, preserved=Preserve(merge=own))
    g.update({"s": wave(spark, [(1, "a"), (2, "b")])})
    assert rows(s) == [(1, "none+newa", 1), (2, "none+newa+newb", 1)]
    g.update({"s": wave(spark, [(2, "c"), (3, "d")])})  # 2 has a row of its own before, 3 takes the first of the key
    assert rows(s) == [(1, "none+newa", 1), (2, "none+newa+newb+newc", 1), (3, "none+newa+newd", 1)]
    g = Graph(spark)
    s = g.source("s", "int", "string", made, target_key="string", target_value=kind, preserved=Preserve(("id",), "uuid"))
    g.update({"s": wave(spark, [(1, "a"), (2, "bb")])})
    ids = {r[1] for r in rows(s)}
    g.update({"s": wave(spark, [(1, "c"), (3, "c")])})
    assert len(ids) == 1 and len(ids.copy().pop()) == 36 and {r[1] for r in rows(s)} == ids
    hashed = native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value").alias("target_key"), F.struct(F.lit(0).cast("bigint").alias("id")).alias("value")))
    g = Graph(spark)
    s = g.source("s", "int", "string", hashed, target_key="string", target_value="struct<id:bigint>", preserved=Preserve(("id",), "hash"))
    g.update({"s": wave(spark, [(1, "a"), (2, "a"), (3, "b")])})
    ids = dict(got(s.read().select("target_key", "value.id"), "target_key", "id"))
    assert ids == {k: spark.sql(f"select xxhash64('{k}')").first()[0] for k in "ab"}
    narrow = native(lambda u: u.select(F.col("key").alias("source_key"), F.col("value").alias("target_key"), F.struct(F.lit(0).alias("id")).alias("value")))
    g = Graph(spark)
    g.source("s", "int", "string", narrow, target_key="string", target_value="struct<id:int>", preserved=Preserve(("id",), "hash"))
    with pytest.raises(WaveError, match="hash"):
        g.update({"s": wave(spark, [(1, "a")])})


def test_key_expressions():
    from wavekeep.functions.keys import _over

    assert "transform" not in str(_over("key.letter", "source_key")) and "`source_key`" not in "key"
    assert str(_over("concat(key, 'key', x.key)", "t")) == str(F.expr("concat(`t`, 'key', x.key)"))


def test_cli(spark, tmp_path):
    from wavekeep import cli

    kind = "UniqueId string, InvoiceNumber string, InvoiceDate timestamp_ntz, SupplierRef string, SupplierName string, InvoiceAmount decimal(38,18), PONumber string, EnteredDate timestamp_ntz, ORG string, PayGroup string, SupplierSite string"
    rows = spark.sql("select 'u1', 'i1', timestamp_ntz'2020-01-01', 's', 'n', cast(5 as decimal(38,18)), 'p', timestamp_ntz'2020-01-02', 'o', 'g', 't' union all select 'u2', 'i2', null, 's', 'n', cast(-5 as decimal(38,18)), 'p', null, 'o', 'g', 't'")
    rows.toDF(*[x.split()[0] for x in kind.split(", ")]).write.parquet(str(tmp_path / "in.parquet"))
    cli.main([str(tmp_path / "out"), str(tmp_path / "in.parquet"), "0"])
    out = spark.read.parquet(str(next((tmp_path / "out/credits_and_invoices").glob("*/content"))))
    cli.main([str(tmp_path / "out"), str(tmp_path / "in.parquet")])
    assert ParquetStore(str(tmp_path / "out")).versions(spark) == [1, 2]
    assert got(out.select("target_key.IsCredit", "value.InvoiceNumber"), "IsCredit", "InvoiceNumber") == [(False, "i1"), (True, "i2")]


def test_entry_works_without_the_text_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "wavekeep.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__

    try:
        entry = importlib.reload(__spark_entry__)
        assert entry.text is None and "group_sum" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_throttled_log():
    from wavekeep.functions.logs import Throttle

    ticks = iter([0.0, 0.5, 1.1, 1.2])
    t = Throttle(1.0, lambda: next(ticks))
    assert [t.filter(None) for _ in range(4)] == [True, False, True, False]


def test_sync_outside_table(spark, tmp_path):
    changes = spark.createDataFrame([("add", 1), ("update", 2), ("delete", 3)], "type string, key int")
    put = lambda kind: lambda rows: [(tmp_path / f"{kind}{r.key}").touch() for r in rows]
    feed.sync(changes, put("new"), put("gone"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["gone3", "new1"]


def test_dropped_tables_release_shuffle_files(spark):
    jvm = spark.sparkContext._jvm

    def files():
        found = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}

    scratch, had = Scratch(spark), files()
    scratch.put(spark.range(1000).repartition(3, "id"))
    new = files() - had
    assert new
    scratch.drop()
    end = time.time() + 30
    while files() & new and time.time() < end:
        time.sleep(0.5)
    assert not files() & new
