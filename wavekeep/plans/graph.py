"""A directed acyclic graph of stages, updated wave by wave."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from ..functions.keys import KeySpec
from ..operators import reconcile as r
from ..operators.join import cogroup_wave, join_wave
from ..operators.merge import affected_keys, merge_wave
from ..operators.preserve import Preserve, preserve
from ..operators.produce import Producer, identity
from ..sources.schema import DELETE, ORD, WaveError, check_shape, check_wave, content_schema, ddl, empty, mappings_schema, updates_schema
from ..sources.store import Scratch, Store, session_store

log = logging.getLogger(__name__)


def _filled(held: dict | None) -> bool:
    """Whether a version of a stage has rows."""
    return bool(held and (held["content"] or held["key_mappings"]))


@dataclass
class Stage:
    graph: Graph
    name: str
    producer: Producer
    sources: list[Stage]
    source_type: T.DataType
    target_type: T.DataType
    value_type: T.DataType
    source_keys: KeySpec
    target_keys: KeySpec
    preserved: Preserve | None = None
    emit_updates: bool = True  # the feed of a stage that feeds others is written all the same
    suppress_unchanged: bool = False  # keys whose rows are as before stay out of the feed
    how: str | None = None  # of a join; "cogroup" for a co-group
    targets: list[Stage] = field(default_factory=list)

    def produces(self, name: str, producer: Producer, target_key: T.DataType | str, value: T.DataType | str, also: tuple[Stage, ...] = (), **options) -> Stage:
        """A stage fed by this one and ``also``, whose values have the same types."""
        return self.graph._stage(name, producer, [self, *also], target_key, value, **options)

    def joins(self, name: str, other: Stage, how: str = "inner", **options) -> Stage:
        """A stage with the join of this one's and another's values by key: struct<left, right>."""
        value = T.StructType([T.StructField("left", self.value_type), T.StructField("right", other.value_type)])
        return self.graph._stage(name, identity(), [self, other], self.target_type, value, how=how, **options)

    def cogroups(self, name: str, other: Stage, producer: Producer, target_key: T.DataType | str, value: T.DataType | str, **options) -> Stage:
        """A stage that makes rows from both sides' values of a key, by a producer of ``cogroup_native`` or
        ``cogroup_arrow``."""
        return self.graph._stage(name, producer, [self, other], target_key, value, how="cogroup", **options)

    def read(self, kind: str = "content", version: int | None = None) -> DataFrame:
        return self.graph.read(self.name, kind, version)


@dataclass
class WaveReport:
    version: int
    seconds: dict[str, float]
    rows: dict[str, dict[str, int]]  # by stage: rows written of content and key_mappings, of the feed, keys touched


class Graph:
    """Opens at the newest version of its store. Waves may come from any process, one at a time: a version whose
    number another process has taken meanwhile is not committed."""

    def __init__(self, spark: SparkSession, store: Store | None = None):
        self.spark, self.store, self.stages = spark, store or session_store(spark), {}
        self.version = max(self.store.versions(spark), default=0)
        self.tag = f"graph-{uuid.uuid4().hex}"

    def source(self, name: str, key: T.DataType | str, value: T.DataType | str, producer: Producer | None = None, **options) -> Stage:
        """A root: waves are given to it from outside."""
        return self._stage(name, producer or identity(), [], options.pop("target_key", key), options.pop("target_value", value), source_type=ddl(key), **options)

    def _stage(self, name: str, producer: Producer, sources: list[Stage], target_key, value, source_type: T.DataType | None = None, **options) -> Stage:
        if name in self.stages:
            raise ValueError(f"there is a stage {name} already")
        if name[:1] in ("_", ".") or "/" in name:
            raise ValueError(f"{name} can't be a folder of the store")
        if len({id(s) for s in sources}) < len(sources):
            raise ValueError(f"{name} has a source twice")
        if any(s.target_type != sources[0].target_type for s in sources):
            raise ValueError(f"the sources of {name} have different key types")
        keys = options.pop("source_keys", sources[0].target_keys if sources else KeySpec())
        joined = options.get("how") not in (None, "cogroup")
        stage = Stage(self, name, producer, sources, source_type or sources[0].target_type, ddl(target_key), ddl(value), keys, options.pop("target_keys", keys if joined else KeySpec()), **options)
        for s in sources:
            s.targets.append(stage)
        self.stages[name] = stage
        return stage

    def _schema(self, stage: Stage, kind: str) -> T.StructType:
        if kind == "content":
            return content_schema(stage.target_type, stage.source_type, stage.value_type)
        if kind == "key_mappings":
            return mappings_schema(stage.source_type, stage.target_type)
        return updates_schema(stage.target_type, stage.value_type)

    def _held(self, version: int) -> dict[str, dict]:
        if not version:
            return {}
        found = self.store.manifest(self.spark, version)
        if found is None:
            raise ValueError(f"there is no version {version}")
        return found["stages"]

    def _read(self, stage: Stage, kind: str, held: dict | None, only: set[int] | None = None) -> DataFrame:
        return self.store.read(self.spark, stage.name, kind, held, self._schema(stage, kind), only)

    def read(self, name: str, kind: str = "content", version: int | None = None, ordered: bool = False) -> DataFrame:
        """A dataset as of a version, the latest by default; ``ordered`` sorts it by its keys. The feed is that of
        the stage's last wave."""
        stage = self.stages[name]
        df = self._read(stage, kind, self._held(self.version if version is None else version).get(name))
        if ordered:
            df = df.orderBy(*self._sort(stage, kind))
        return df.drop(ORD) if kind == "content" else df

    def _sort(self, stage: Stage, kind: str) -> list[Column]:
        if kind == "updates":
            return stage.target_keys.sort("key")
        target, source = stage.target_keys.sort("target_key"), stage.source_keys.sort("source_key")
        return [*target, *source, F.col(ORD)] if kind == "content" else [*source, *target]

    def _levels(self, roots: list[str]) -> list[list[Stage]]:
        """The stages that a wave reaches, in steps: those of one step don't depend on each other."""
        reached, todo = set(), [self.stages[x] for x in roots]
        while todo:
            s = todo.pop()
            if s.name not in reached:
                reached.add(s.name)
                todo += s.targets
        order = TopologicalSorter({n: [x.name for x in self.stages[n].sources if x.name in reached] for n in sorted(reached)})
        order.prepare()
        out = []
        while order.is_active():
            out.append([self.stages[n] for n in order.get_ready()])
            order.done(*[s.name for s in out[-1]])
        return out

    def _together(self, *tasks: Callable[[], object]) -> list:
        """Runs tasks side by side, so that short Spark jobs don't wait for each other; the first error is raised."""
        if len(tasks) == 1:
            return [tasks[0]()]

        def tagged(task: Callable[[], object]) -> object:
            self.spark.sparkContext.addJobTag(self.tag)
            return task()

        with ThreadPoolExecutor(len(tasks)) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(tagged), t) for t in tasks]]

    def update(self, inputs: dict[str, DataFrame], based_on: int | None = None, stream: tuple[str, int] | None = None, validate: bool = True) -> WaveReport:
        """One wave into any number of roots, then into all stages below them, each from written inputs.

        The wave starts from the newest version, or from ``based_on``, and gets the number after the newest: no
        version is ever overwritten. Nothing counts before its manifest is there, so a wave that fails can be run
        again. Stages that the wave doesn't reach keep their version. ``stream``: (name, batch) to remember.
        """
        for name in inputs:
            if self.stages[name].sources:
                raise ValueError(f"{name} is not a root")
        self.spark.sparkContext.addJobTag(self.tag)
        scratch = Scratch(self.spark)
        try:
            newest = max(self.store.versions(self.spark), default=0)
            base = newest if based_on is None else based_on
            return self._update(inputs, base, newest + 1, stream, validate, scratch)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            scratch.drop()

    def cancel(self) -> None:
        """Interrupts the wave that another thread is running; its version is not committed."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Drops all but the newest versions, with the files that only they name."""
        return self.store.vacuum(self.spark, keep)

    def _update(self, inputs: dict[str, DataFrame], base: int, version: int, stream: tuple[str, int] | None, validate: bool, scratch: Scratch) -> WaveReport:
        found = (self.store.manifest(self.spark, base) if base else None) or {"stages": {}}
        before = self._held(base)
        held = before | {}
        wave, seconds, rows = f"{version:06d}-{uuid.uuid4().hex[:12]}", {}, {}
        feeds: set[str] = set()
        touched: dict[str, DataFrame] = {}  # by stage: one key of each group in its feed

        def run(stage: Stage) -> tuple[str, dict, dict, float]:
            began, changed = time.time(), None
            if not stage.sources:
                changes = inputs[stage.name].select("type", "key", "value", "ordinal")
                if held.get(stage.name):  # read several times below
                    changes = scratch.put(changes)
                if validate:
                    check_wave(changes, stage.source_keys.of("key"))
            else:
                changes, changed = self._fed(stage, before, held, feeds, touched, scratch)
            now, n, keys = self._stage_wave(stage, held.get(stage.name), changes, changed, wave, scratch)
            if keys is not None and not stage.suppress_unchanged:
                touched[stage.name] = keys
            return stage.name, now, n, time.time() - began

        for level in self._levels(list(inputs)):
            for name, now, n, took in self._together(*[lambda s=s: run(s) for s in level]):
                held[name], rows[name], seconds[name] = now, n, took
                if now["updates"]:
                    feeds.add(name)
                log.info("%s: version %d after %.1f s", name, version, took)
        streams = found.get("streams", {}) | (dict([stream]) if stream else {})
        self.store.commit(self.spark, {"version": version, "based_on": base, "streams": streams, "stages": held})
        self.version = version
        return WaveReport(version, seconds, rows)

    def _fed(self, stage: Stage, before: dict[str, dict], held: dict[str, dict], feeds: set[str], touched: dict[str, DataFrame], scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
        """The wave that a stage's sources give it, and one key of each group that it changes if that is known."""
        spec = stage.source_keys
        known = {s.name: touched[s.name] for s in stage.sources if s.name in touched and s.name in feeds and s.target_keys == spec}
        if len(stage.sources) == 1:
            name = stage.sources[0].name
            return self._read(stage.sources[0], "updates", held[name] if name in feeds else None), known.get(name)
        # a bulk load: all that the sources hold is new
        whole = not any(_filled(before.get(s.name)) for s in (stage, *stage.sources))
        affected = None
        if not whole:
            keys = [known.get(s.name, self._read(s, "updates", held[s.name])) for s in stage.sources if s.name in feeds]
            if len(keys) == 1 and known:
                affected = keys[0]
            else:
                affected = scratch.put(affected_keys(keys or [empty(self.spark, self._schema(stage.sources[0], "updates"))], spec).select("key"))
            affected = affected.withColumn("_g", spec.of("key"))
        contents = []
        for s in stage.sources:
            at = held.get(s.name)
            # of a source that groups its keys alike only the buckets of affected keys are read
            only = self._buckets(affected, spec, "key", at["buckets"]) if at and not whole and s.target_keys == spec else None
            contents.append(self._read(s, "content", at, only))
        if stage.how == "cogroup":
            changes = cogroup_wave(tuple(contents), affected, spec)
        elif stage.how:
            changes = join_wave(tuple(contents), affected, stage.how, spec)
        else:
            changes = merge_wave(contents, affected, spec)
        return (changes, None) if whole else (scratch.put(changes), affected.select("key"))

    def _buckets(self, rows: DataFrame, spec: KeySpec, column: str, buckets: int) -> set[int]:
        """The buckets of rows' keys: at most ``buckets`` numbers."""
        return {x[0] for x in rows.select(spec.bucket(column, buckets).alias("b")).distinct().collect()}

    def _stage_wave(self, stage: Stage, before: dict | None, changes: DataFrame, changed: DataFrame | None, wave: str, scratch: Scratch) -> tuple[dict, dict, DataFrame | None]:
        """Writes what changes of one stage: the buckets that the wave touches, and the feed. Gives the touched keys of
        a stage that had rows. changed: one source key of each group in ``changes``, None if not known."""
        source, target = stage.source_keys, stage.target_keys
        n = before["buckets"] if before else self.store.buckets
        top = before["top_id"] if before else 0
        known = _filled(before)
        feed_wanted = stage.emit_updates or bool(stage.targets)
        if known:
            keys = changed
            changed, produced = self._together(lambda: scratch.put(r.changed_keys(changes, source)) if keys is None else keys, lambda: self._produced(stage, changes, scratch, True))
        else:
            changed, produced = None, self._produced(stage, changes, scratch, False)

        def write(kind: str, df: DataFrame, spec: KeySpec, column: str) -> tuple[dict[str, str], int]:
            return self.store.write(stage.name, kind, wave, df, spec.bucket(column, n), self._sort(stage, kind))

        if not known:
            if stage.preserved is not None:
                produced, top = preserve(produced, empty(self.spark, self._schema(stage, "content")), stage.preserved, target, source, top, scratch)
                produced = scratch.put(produced)
            (content, rows), (mappings, pairs) = self._together(lambda: write("content", produced, target, "target_key"), lambda: write("key_mappings", produced.select(*r.MAPPING), source, "source_key"))
            touched, past, hot = None, None, None
            if feed_wanted and rows > r.HOT:
                hot = r.hot_groups(produced, target)
        else:
            from_buckets = self._buckets(changed, source, "key", n)
            lineage = self._read(stage, "key_mappings", before, from_buckets)
            keys = scratch.put(r.touched_keys(lineage, changed, produced, source, target))
            to_buckets = self._buckets(keys, target, "key", n)
            past = self._read(stage, "content", before, to_buckets)
            if stage.preserved is not None:
                produced, top = preserve(produced, past, stage.preserved, target, source, top, scratch)
                produced = scratch.put(produced)
            (content, rows), (mappings, pairs), touched = self._together(
                lambda: write("content", r.next_content(past, changed, produced, source), target, "target_key"),
                lambda: write("key_mappings", r.next_mappings(lineage, changed, produced, source), source, "source_key"),
                lambda: scratch.put(r.with_past(keys, past, changed, source, target)),
            )
            made = F.when(~F.col("known"), F.col("made"))  # of a key that was not there
            n_touched, torn, most = touched.agg(F.count("*"), F.max(F.col("torn").cast("int")), F.max(made)).first()
            hot = touched.where(made > r.HOT).select(target.of("key").alias("_g")) if (most or 0) > r.HOT else None
            if torn:
                raise WaveError(f"content and lineage of {stage.name} disagree: the version that the wave starts from is damaged")
            content = {b: w for b, w in before["content"].items() if int(b) not in to_buckets} | content
            mappings = {b: w for b, w in before["key_mappings"].items() if int(b) not in from_buckets} | mappings
        held = {"buckets": n, "top_id": top, "content": content, "key_mappings": mappings, "updates": {}}
        count = {"content": rows, "key_mappings": pairs}
        if feed_wanted:
            if touched is None:
                if hot is not None:
                    hot = scratch.put(hot)
                    hot = None if hot.isEmpty() else hot
                feed = r.change_feed(None, None, produced, target, hot=hot)
            else:  # from what was just written
                now = self._read(stage, "content", held, to_buckets)
                feed = r.change_feed(touched, now, produced, target, past if stage.suppress_unchanged else None, most is not None, hot)
            held["updates"], count["updates"] = self.store.write(stage.name, "updates", wave, feed, None, [])
        if touched is not None:
            count["touched"] = n_touched
        return held, count, touched.select("key") if touched is not None else None

    def _produced(self, stage: Stage, changes: DataFrame, scratch: Scratch, written: bool) -> DataFrame:
        """What the changed keys produce now; written, as several outputs come from it, unless it is but a choice of
        columns from changes that are ``written``."""
        out = stage.producer.apply(changes.where(F.col("type") != DELETE).select("key", "value", "ordinal"), stage.source_keys)
        out = out.select("source_key", "target_key", "value", ORD)
        check_shape(out, self._schema(stage, "content"), stage.name)
        return out if written and stage.producer.columns_only else scratch.put(out)
