"""Where versions of stages are kept: Parquet under any path that Spark can open.

A stage's content and lineage are dealt into buckets by a hash of their key's group. A wave writes only the
buckets it touches, into a folder of its own; the manifest of a version says for each bucket which wave's
folder holds it. Nothing that a manifest names is ever written again.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from itertools import count
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import WaveError, empty

KINDS = ("content", "key_mappings", "updates")
BUCKET = "_b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only on one machine may it be unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wavekeep-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def file_at(spark: SparkSession, path: str):
    """(file system, path) on the side of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables of one piece of work in the shared folder, deleted together when it is done. Spark deletes the shuffle
    files of a finished query only after the driver's JVM has collected its plan, so ``drop`` asks for that too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.numbers = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", count()

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{next(self.numbers)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        fs, p = file_at(self.spark, self.root)
        fs.delete(p, True)
        self.spark._jvm.System.gc()


def _count(seen: Observation, written: DataFrame, path: str) -> int:
    """Rows written. An observation is lost if the optimizer finds that there are none; then the files are asked."""
    try:
        return seen.get["n"]
    except Exception:
        return written.sparkSession.read.schema(written.schema).parquet(path).count()


class Store(Protocol):
    buckets: int

    def read(self, spark: SparkSession, stage: str, kind: str, held: dict | None, schema: T.StructType, only: set[int] | None = None) -> DataFrame: ...

    def write(self, stage: str, kind: str, wave: str, df: DataFrame, bucket: Column | None, sort: list[Column]) -> tuple[dict[str, str], int]: ...

    def commit(self, spark: SparkSession, manifest: dict) -> None: ...

    def manifest(self, spark: SparkSession, version: int) -> dict | None: ...

    def versions(self, spark: SparkSession) -> list[int]: ...


class ParquetStore:
    """``<root>/<stage>/<wave>/<kind>/_b=<bucket>/``, sorted within files. ``buckets`` is how many a new stage gets;
    one that is there keeps its number. A hot bucket is split over several files by AQE's rebalancing.

    Manifests are ``<root>/_manifests/<version>.json``: written beside and renamed to a name that must be free.
    """

    def __init__(self, root: str, buckets: int = 16) -> None:
        self.root, self.buckets = root.rstrip("/"), buckets

    def path(self, stage: str, wave: str, kind: str) -> str:
        return f"{self.root}/{stage}/{wave}/{kind}"

    def read(self, spark: SparkSession, stage: str, kind: str, held: dict | None, schema: T.StructType, only: set[int] | None = None) -> DataFrame:
        parts = (held or {}).get(kind) or {}
        paths = [self.path(stage, wave, kind) + (f"/{BUCKET}={b}" if b else "") for b, wave in sorted(parts.items()) if only is None or not b or int(b) in only]
        return spark.read.schema(schema).parquet(*paths) if paths else empty(spark, schema)

    def write(self, stage: str, kind: str, wave: str, df: DataFrame, bucket: Column | None, sort: list[Column]) -> tuple[dict[str, str], int]:
        """The buckets that got rows, each with the wave that holds it (without ``bucket`` one, named ""), and the rows."""
        path, seen = self.path(stage, wave, kind), Observation()
        if bucket is None:
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
            return {"": wave}, _count(seen, df, path)
        rows = df.withColumn(BUCKET, bucket.cast("int")).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *sort).write.partitionBy(BUCKET).parquet(path)
        fs, p = file_at(df.sparkSession, path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        found = {x.removeprefix(f"{BUCKET}="): wave for x in names if x.startswith(f"{BUCKET}=")}
        return found, _count(seen, df, path) if found else 0

    def commit(self, spark: SparkSession, manifest: dict) -> None:
        """Makes a version count, by one rename. Raises if another process has taken its number."""
        jvm = spark._jvm
        fs, part = file_at(spark, f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifests/{manifest['version']}.json")
        kept = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(part).toUri(), spark._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(part), fs.makeQualified(target), kept)
        except Exception as e:
            fs.delete(part, False)
            raise WaveError(f"version {manifest['version']} could not be committed") from e

    def manifest(self, spark: SparkSession, version: int) -> dict | None:
        fs, p = file_at(spark, f"{self.root}/_manifests/{version}.json")
        if not fs.exists(p):
            return None
        return json.loads("\n".join(r["value"] for r in spark.read.text(p.toString()).collect()))

    def versions(self, spark: SparkSession) -> list[int]:
        fs, p = file_at(spark, f"{self.root}/_manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json") and x[0] != ".")

    def vacuum(self, spark: SparkSession, keep: int = 1) -> list[int]:
        """Drops all versions but the newest ``keep``, and the folders of waves that no kept version names. Not to be
        run beside a wave. Gives the versions dropped."""
        every = self.versions(spark)
        gone = every[: max(0, len(every) - keep)]
        for v in gone:
            fs, p = file_at(spark, f"{self.root}/_manifests/{v}.json")
            fs.delete(p, False)
        kept = [self.manifest(spark, v) for v in every[len(gone) :]]
        named = {(s, w) for m in kept for s, held in m["stages"].items() for k in KINDS for w in (held.get(k) or {}).values()}
        fs, top = file_at(spark, self.root)
        for stage in fs.listStatus(top) if fs.exists(top) else []:
            name = stage.getPath().getName()
            if name[0] not in "_.":
                for wave in fs.listStatus(stage.getPath()):
                    if (name, wave.getPath().getName()) not in named:
                        fs.delete(wave.getPath(), True)
        return gone


def session_store(spark: SparkSession, buckets: int = 16) -> ParquetStore:
    """A store for the time of a session, in the shared folder."""
    return ParquetStore(f"{shared_dir(spark)}/session-{uuid.uuid4().hex}", buckets)
