"""The pipeline stage by stage on a small table, against brute force."""

import re

import corpus_pipeline
from wavekeep.llm import langid
from test_ops import AWKWARD, COLUMNS  # noqa: F401


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, g, s, len(t or "")) for d, t, g, s in AWKWARD], COLUMNS + ", n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, before = docs.columns, docs
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        out[name] = after
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        before = after
    letters = {d for d, t, *_ in AWKWARD if t and re.search(r"[^\W\d_]", t)}
    assert {r["doc_id"] for r in out["language"].collect()} == letters
    kept = [r for r in out["lines"].collect()]
    lines = [x for r in kept for x in r["text"].split("\n") if x.strip(" ")]
    distinct = {r["doc_id"]: r["text"] for r in kept}
    assert 11 not in distinct and 10 not in distinct and all(r["n_chars"] == len(r["text"]) for r in kept)
    assert len(lines) == len(set(lines))
    assert out["near_duplicates"].count() == len({(r["doc_id"], r["text"]) for r in kept})
    near = {(r["doc_id"], r["text"]) for r in out["near_duplicates"].collect()}
    mixed = [(r["doc_id"], r["text"]) for r in out["mixture"].collect()]
    assert set(mixed) <= near and max(map(mixed.count, set(mixed))) <= 2
    pieces = out["packing"].collect()
    assert {r["doc_id"] for r in pieces} == {d for d, _ in mixed}
    assert sum(r["length"] for r in pieces if r["start"] == 0) <= sum(r["length"] for r in pieces)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces) and langid.UND == "und"


def test_each_stage_runs_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"some text number {i} with words of its own {i * 7}", "en", f"s{i % 3}", 1) for i in range(20)], COLUMNS + ", n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = []

    def counted(name, stage):
        def run(spark, docs, sf_dir):
            n = spark.sparkContext.accumulator(0)
            seen.append((name, n, docs.count()))

            def pass_on(batches):
                for b in batches:
                    n.add(b.num_rows)
                    yield b

            out = stage(spark, docs, sf_dir)
            return out.mapInArrow(pass_on, out.schema)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(n, s)) for n, s in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    given = [rows for _, _, rows in seen] + [len(out)]
    assert [n.value for _, n, _ in seen] == given[1:] and given[0] == 20  # what a stage gave, the next one got, once


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS + ", n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
