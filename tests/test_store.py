"""Versions, savepoints, blobs, graphs and change logs at their edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import blobs, changes, graph
from lodestrata.plans.composite import CompositeQuery, InvalidQuery
from lodestrata.sources.store import CommitConflict, TableStore, VersionNotRetained
from lodestrata.sources.tables import TableDoesNotExist


def test_store(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/db", keep=2)
    for i in (1, 2, 3):
        t = s.begin(i * 10)
        t.write("a", spark.range(i))
        late = s.begin(i * 10)
        assert t.commit() == i
        with pytest.raises(CommitConflict):
            late.commit()
    assert s.versions() == [2, 3] and s.read("a", s.version_at(29)).count() == 2
    with pytest.raises(VersionNotRetained):
        s.read("a", 1)
    with pytest.raises(VersionNotRetained):
        s.version_at(5)
    with pytest.raises(TableDoesNotExist):
        s.read("b")
    assert [tuple(r) for r in s.history().collect()] == [(2, 20), (3, 30)]
    assert s.fingerprint("a", 2) != s.fingerprint("a", 3)


def test_blob_edges(spark):
    rows = [(0, b"", None), (1, b"x" * 100, "é" * 40), (2, b"x" * 100, "b"), (3, b"y" * 129, "c"), (4, None, "d")]
    df = spark.createDataFrame(rows, "seq long, data binary, label string")
    s = blobs.ingest(df, seq="seq", data="data", label="label", tags=F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("t"), i.cast("string"))), dedup=True, dedup_min=50, chunk=64)
    read = {r.seq: (bytes(r.data), r.intact) for r in blobs.read(s).collect()}
    assert read == {i: (d or b"", True) for i, d, _ in rows}
    assert {(r.seq, r.idx) for r in s.chunks.collect()} == {(1, 0), (1, 1), (3, 0), (3, 1), (3, 2)}
    assert s.tags.count() == 5 * 8
    assert {r.seq: r.label for r in s.meta.collect()}[1] == "é" * 31
    assert bytes(blobs.read_range(s, 2, 60, 10, chunk=64).first().data) == b"x" * 10
    assert bytes(blobs.read_range(s, 3, 129, 0, chunk=64).first().data) == b""
    with pytest.raises(blobs.BlobRangeOutOfBounds):
        blobs.read_range(s, 3, 100, 30, chunk=64)
    assert tuple(blobs.dedup_stats(s, 50).first()) == (2, 3, 100)
    left, _ = blobs.delete(s, spark.createDataFrame([], "parent long, child long"), spark.createDataFrame([(1,)], "seq long"))
    assert {r.seq: bytes(r.data) for r in blobs.read(left).collect()}[2] == b"x" * 100


def test_graph_edges(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 3), (6, 6)], "node long, parent long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 7)], "parent long, child long")
    assert [r.node for r in graph.chain(nodes, 5, 10).collect()] == [5, 3, 2, 1]
    assert [r.node for r in graph.chain(nodes, 5, 1).collect()] == [5, 3]
    assert [r.node for r in graph.chain(nodes, 4, 5).collect()] == [4]
    assert [r.node for r in graph.chain(nodes, 6, 3).collect()] == [6] * 4  # a cycle ends with the hops
    assert graph.path(nodes, 5, 4, 10).count() == 0
    assert [r.node for r in graph.path(nodes, 77, 77, 10).collect()] == [77]
    assert {r.node: r.hops for r in graph.hops(edges, nodes, 1, 2).collect()} == {1: 0, 2: 1, 7: 1, 3: 2}


def test_cdc_edges(spark):
    writes = spark.createDataFrame([("k", 1, 1, 5, False), ("k", 2, 1, 6, False), ("k", 3, 1, None, True), ("k", 4, 1, None, True), ("k", 5, 1, 7, False)], "key string, txn long, seq long, value long, deleted boolean")
    log = changes.capture(writes, keys=["key"], order=["txn", "seq"], value="value", deleted="deleted")
    assert [(r.txn, r.op, r.old_value, r.new_value) for r in log.orderBy("txn").collect()] == [(1, "insert", None, 5), (2, "update", 5, 6), (3, "delete", 6, None), (5, "insert", None, 7)]
    kept = changes.retained(log, 5, 2)
    assert [r.txn for r in kept.collect()] == [5]
    with pytest.raises(changes.CursorBehindRetention):
        changes.since(kept, 2)
    assert changes.since(kept, 0).count() == 1
    assert changes.between(log, 3, 1).count() == 0


def test_composite_validation(spark):
    b = spark.createDataFrame([(1, 0)], "seq long, wall_ns long")
    for q in (CompositeQuery(b), CompositeQuery(b).temporal(1.0), CompositeQuery(b, weights=(1.0, 0, 0)), CompositeQuery(b).temporal(1.0).time_range(0, 1).top_k(0)):
        with pytest.raises(InvalidQuery):
            q.run()
    r = CompositeQuery(b).temporal(3.0).time_range(0, 1).run().first()
    assert (r.seq, r.score, r.semantic, r.temporal, r.causal) == (1, 1.0, None, 1.0, None)


def test_repeated_keys_are_one_event(spark, tmp_path):
    from lodestrata.plans.engine import Engine, EngineConfig

    e = Engine(spark, f"file://{tmp_path}/engine", EngineConfig(cdc=True))
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k long, v string, at int")
    e.commit(1, lambda t: e.apply(t, "x", ["k"], rows, order="at"), lambda t: e.apply(t, "x", ["k"], rows.select("k", "v")))
    assert sorted(map(tuple, e.read("x").collect())) == [(1, "b"), (2, "c")]
    log = e.log().orderBy("seq").collect()
    assert [(r.op, r.key) for r in log] == [("insert", '{"k":1}'), ("insert", '{"k":2}'), ("update", '{"k":1}'), ("update", '{"k":2}')]
    assert len({r.seq for r in log}) == 4


def test_log_retention_rewrites_nothing(spark, tmp_path):
    from lodestrata.plans.engine import LOG, Engine, EngineConfig

    e = Engine(spark, f"file://{tmp_path}/engine", EngineConfig(cdc=True, cdc_retention=2, history_retention=1))
    for i in range(1, 5):
        e.commit(i, lambda t, i=i: e.apply(t, "x", ["k"], spark.createDataFrame([(i, "v")], "k long, v string")))
    assert sorted(r.txn for r in e.log().collect()) == [3, 4]
    assert len(e.store.fingerprint(LOG, 4)) == 2 and e.store.versions() == [4]
    assert len(list((tmp_path / "engine" / "data" / LOG).iterdir())) == 2  # dropped folders are gone from the disk


def test_savepoints_outlive_their_session(spark, tmp_path):
    from lodestrata.sources.store import TableStore

    s = TableStore(spark, f"file://{tmp_path}/s", keep=1)
    for i in (1, 2, 3):
        t = s.begin(i)
        t.write("x", spark.range(i))
        t.commit()
        s.savepoint(f"p{i}")
    other = TableStore(spark, s.root, keep=1)
    assert other.savepoints() == {"p1": 1, "p2": 2, "p3": 3} and other.read("x", 1).count() == 1
    assert other.delete_savepoint("p1") and not other.delete_savepoint("p1")
    other.restore("p2", 9)
    assert s.savepoints() == {"p2": 2} and s.read("x").count() == 2 and s.versions() == [2, 4]


def test_blobs_are_added_to_a_store(spark, tmp_path):
    from lodestrata.operators import blobs
    from lodestrata.plans.engine import Engine, EngineConfig

    e = Engine(spark, f"file://{tmp_path}/engine", EngineConfig(blob_dedup=True, blob_dedup_min=4))
    batch = lambda *rows: spark.createDataFrame(rows, "seq long, data string")
    e.commit(1, lambda t: e.store_blobs(t, batch((1, "abcdef"), (2, "xy")), seq="seq", data="data", chunk=2))
    e.commit(2, lambda t: e.store_blobs(t, batch((3, "abcdef"), (4, "xy"), (5, "")), seq="seq", data="data", chunk=2))
    s = e.blobs()
    assert {r.seq: r.owner for r in s.meta.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert {r.seq: (bytes(r.data), r.intact) for r in blobs.read(s).collect()} == {1: (b"abcdef", True), 2: (b"xy", True), 3: (b"abcdef", True), 4: (b"xy", True), 5: (b"", True)}
    assert s.chunks.filter("seq = 3").count() == 0
    with pytest.raises(Exception, match="3"):
        e.commit(3, lambda t: e.store_blobs(t, batch((3, "z")), seq="seq", data="data"))


def test_composite_over_a_store(spark):
    from lodestrata.operators import blobs
    from lodestrata.plans.composite import CompositeQuery, InvalidQuery

    rows = spark.createDataFrame([(i, "x", i * 10, ["even" if i % 2 == 0 else "odd"], "ns") for i in range(6)], "seq long, data string, w long, tags array<string>, ns string")
    s = blobs.ingest(rows, seq="seq", data="data", wall_ns=rows["w"], namespace=rows["ns"], tags=rows["tags"])
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    q = CompositeQuery.of(s).top_k(2).nearest_to(vectors, [5.0, 1.0], 1.0, metric="euclidean_sq").namespace("ns")
    assert [r.seq for r in q.tag("even").run().collect()] == [4, 2]
    with pytest.raises(InvalidQuery):
        CompositeQuery(s.meta).tag("even")
