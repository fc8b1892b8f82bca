"""Vector functions, quantizers, exact search and the index against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import ivfpq, knn


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(12, 16)) * 4
    x = (centers[r.integers(12, size=600)] + r.normal(size=(600, 16))).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").cache()


def one(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(f(F.col("a"), F.col("b")).alias("d")).first().d


@pytest.mark.parametrize("metric", sorted(V.METRICS))
def test_edges(spark, metric):
    d = lambda a, b: one(spark, a, b, lambda x, y: V.distance(metric, x, y))
    assert d([1.0, 2.0], [1.0]) == V.FAR
    assert d([float("nan"), 1.0], [1.0, 1.0]) == V.FAR
    assert d([0.0, 0.0], [1.0, 1.0]) == {"cosine": 1.0, "dot": 0.0, "euclidean_sq": 2.0, "manhattan": 2.0}[metric]


@pytest.mark.parametrize("metric", sorted(V.METRICS))
def test_knn(spark, data, metric):
    x, df = data
    want = sorted((round(float(d), 5), i) for i, d in enumerate(knn._distances(metric, x[5][None].astype(float), x.astype(float))[0]))[:7]
    got = [(round(r.distance, 5), r.vec_id) for r in knn.nearest(df, [float(v) for v in x[5]], 7, metric=metric, digits=5).collect()]
    assert [i for _, i in got] == [i for _, i in want]
    assert knn.nearest(df, [1.0] * 16, 0).count() == 0
    many = knn.nearest_many(df, df.filter("vec_id < 9"), 3, metric=metric, block=4).collect()
    assert len(many) == 27
    d = knn._distances(metric, x[:9].astype(float), x.astype(float))
    for r in many:
        assert r.id == np.lexsort((np.arange(len(x)), d[r.query_id]))[r["rank"] - 1]


def test_quantizers(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.0, 2.0, 1.0, 1.0, -3.0, 0.1, 9.0],), ([],), ([2.0, 2.0],), ([float("inf"), 1.0],)], "v array<float>")
    rows = df.select(F.hex(V.quantize_binary(F.col("v"))).alias("b"), V.quantize_scalar(F.col("v")).alias("q"), V.read_f32_le(V.write_f32_le(F.col("v"))).alias("r"), "v").collect()
    assert rows[0].b == "9D80" and rows[1].b == ""
    q = rows[0].q
    assert (q.min, q.max) == (-3.0, 9.0) and list(q.codes) == [int((x + 3) * 255 / 12 + 0.5) for x in (0.5, -1, 0, 2, 1, 1, -3, np.float32(0.1), 9)]
    assert list(rows[2].q.codes) == [0, 0] and list(rows[3].q.codes) == [0, 0]
    assert all(list(r.r) == list(r.v) for r in rows)


@pytest.mark.parametrize("metric", sorted(V.METRICS))
def test_index(spark, data, metric, tmp_path):
    x, df = data
    index = ivfpq.build(ivfpq.train(df, ivfpq.IndexConfig(16, 8, 8, metric)), df, f"file://{tmp_path}/ix")
    queries = {i: [float(v) for v in x[i]] for i in range(0, 600, 30)}
    d = knn._distances(metric, x[list(queries)].astype(float), x.astype(float))
    truth = {q: set(np.lexsort((np.arange(600), row))[:10].tolist()) for q, row in zip(queries, d, strict=True)}

    def recall(p):
        hits = {}
        for r in ivfpq.search(spark, index, queries, p).collect():
            hits.setdefault(r.query_id, set()).add(r.vec_id)
        return np.mean([len(hits.get(q, set()) & truth[q]) / 10 for q in queries])

    assert recall(ivfpq.SearchParams(10, nprobe=8, candidates=600)) == 1.0
    assert recall(ivfpq.SearchParams(10, nprobe=4)) >= 0.9
    assert recall(ivfpq.SearchParams(10, nprobe=4, rerank=False)) >= 0.35
    assert recall(ivfpq.SearchParams(10, nprobe=4, diversity=0.3)) >= 0.7


def test_index_edges(spark, data, tmp_path):
    x, df = data
    with pytest.raises(ValueError):
        ivfpq.IndexConfig(16, 8, 3)
    with pytest.raises(ivfpq.IndexNotTrained):
        ivfpq.search(spark, ivfpq.Index(ivfpq.IndexConfig(16, 8, 8)), {1: [0.0] * 16}, ivfpq.SearchParams(3))
    index = ivfpq.build(ivfpq.train(df, ivfpq.IndexConfig(16, 200, 8, "cosine")), df, f"file://{tmp_path}/ix")
    assert index.warnings and index.config.default_nprobe == 14
    assert ivfpq.search(spark, index, {1: [0.0] * 16}, ivfpq.SearchParams(3)).count() == 0
    with pytest.raises(ValueError):
        ivfpq.search(spark, index, {1: [0.0] * 4}, ivfpq.SearchParams(3))
    assert len(ivfpq.decode(index, b"\x00" * 8)) == 16 and len(ivfpq.decode(index, b"")) == 0
    bad = spark.createDataFrame([(1, [float("nan")] * 16), (2, [1.0]), (3, None), (4, [1.0] * 16)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in ivfpq.encoded(index, bad, skip_invalid=True).collect()] == [4]
    for i in (1, 2, 3):
        with pytest.raises(Exception, match="no vector that the index can hold"):
            ivfpq.encoded(index, bad.filter(f"vec_id = {i}")).collect()
    assert ivfpq.encoded(index, bad.filter("vec_id = 4")).count() == 1
