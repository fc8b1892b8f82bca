"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import re

import pytest

from .test_contracts import ALNUM, WORD, awkward, components, low, shingle_sets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(awkward(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(14)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, str(d))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns
        found.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        out.append(docs.collect())
    return out


def test_language_stage(stages):
    kept = {r.doc_id for r in stages[1]}
    for r in stages[0]:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert r.doc_id not in kept
        elif len((r.text or "").split()) > 20:
            assert r.doc_id in kept


def test_line_stage(stages):
    before, after = {r.doc_id: r.text for r in stages[1]}, {r.doc_id: r.text for r in stages[2]}
    seen, want = set(), {}
    for i in sorted(before):
        lines, gone = before[i].split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        if len(gone) < len(lines):
            want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert after == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[2]]
    comp = components(shingle_sets(rows, 5), 80)
    assert sorted(r.doc_id for r in stages[3]) == sorted(i for i in comp if comp[i] == i)


def test_benchmark_stage(stages):
    item = [f"bench{i}" for i in range(14)]
    windows = {tuple(item[k : k + 10]) for k in range(5)}
    clean = []
    for r in stages[3]:
        w = ALNUM.findall(low(r.text))
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in stages[4]) == sorted(clean) and len(clean) < len(stages[3])


def test_packed_stage(stages):
    pieces = {}
    for r in sorted(stages[5], key=lambda r: (r.doc_id, r.start)):
        assert r.start == pieces.get(r.doc_id, 0) and len(r.ids) == 4 * r.length
        pieces[r.doc_id] = r.start + r.length
    assert set(pieces) == {r.doc_id for r in stages[4]}
    assert WORD  # the documents' words are those of the contracts


def test_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(1, "plain english words stand here for a while", "en", "s", 1), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "n_removed", "first", "contaminated", "start"):
        df = df.withColumn(c, F.lit("mine"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        assert all(r.score == "mine" and r.first == "mine" for r in out.collect())
