"""Ordered tables, multimaps, merges and TTL against plain Python models."""

from __future__ import annotations

from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators import merge, multimap, ordered, ttl
from lodestrata.operators.ordered import Bounds
from lodestrata.sources.tables import TableTypeMismatch, check_schema

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
KV = "k long, v long"


def kv(spark, d):
    return spark.createDataFrame(list(d.items()), KV)


def pairs(df):
    return [(r[0], r[1]) for r in df.collect()]


@few
@given(st.dictionaries(st.integers(-50, 50), st.integers(0, 9), max_size=30), st.integers(-60, 60), st.integers(-60, 60), st.booleans(), st.booleans())
def test_range(spark, d, lo, hi, a, b):
    want = sorted((k, v) for k, v in d.items() if (k >= lo if a else k > lo) and (k <= hi if b else k < hi))
    bounds = Bounds(lo, hi, a, b)
    assert pairs(ordered.scan(kv(spark, d), "k", bounds)) == want
    assert pairs(ordered.scan(kv(spark, d), "k", bounds, reverse=True)) == want[::-1]
    n, rest = ordered.drain(kv(spark, d), "k", bounds)
    assert n.first()[0] == len(want)
    assert sorted(pairs(rest)) == sorted(set(d.items()) - set(want))


@few
@given(st.dictionaries(st.integers(0, 9), st.integers(0, 9), max_size=8), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=20))
def test_upsert(spark, d, ops):
    changes = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(ops)], "k long, v long, i long")
    assert dict(pairs(ordered.upsert(kv(spark, d), changes, ["k"], "i"))) == d | dict(ops)
    assert sorted(pairs(ordered.replaced(kv(spark, d), changes, ["k"]))) == sorted((k, v) for k, v in d.items() if k in dict(ops))


def test_empty_and_nulls(spark):
    none = kv(spark, {})
    assert ordered.first(none, "k").count() == 0 and ordered.length(none).first()[0] == 0
    t = spark.createDataFrame([(None, 1), (2, None), (1, 5)], KV)
    assert pairs(ordered.first(t, "k")) == [(None, 1)]
    assert pairs(ordered.last(t, "k")) == [(2, None)]
    out, rest = ordered.extract_if(t, F.col("v") > 2)
    assert pairs(out) == [(1, 5)] and rest.count() == 2
    assert ordered.retain(t, F.col("v") > 2).count() == 1


def test_pop(spark):
    top, rest = ordered.pop_first(kv(spark, {3: 1, 1: 2, 2: 3}), "k")
    assert pairs(top) == [(1, 2)] and sorted(pairs(rest)) == [(2, 3), (3, 1)]


def test_schema_check(spark):
    with pytest.raises(TableTypeMismatch):
        check_schema(kv(spark, {}), T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())]))


def test_multimap(spark):
    m = multimap.of(spark.createDataFrame([(1, 2), (1, 1), (1, 2), (5, 0)], "a long, b long"), "a", "b")
    assert pairs(multimap.get(m, 1)) == [(1, 1), (1, 2)]
    assert multimap.length(m).first()[0] == 3
    more = spark.createDataFrame([(1, 2), (7, 7)], "k long, v long")
    assert sorted(pairs(multimap.insert(m, more))) == [(1, 1), (1, 2), (5, 0), (7, 7)]
    assert sorted(tuple(r) for r in multimap.existed(m, more).collect()) == [(1, 2, True), (7, 7, False)]
    gone, rest = multimap.remove_all(m, spark.createDataFrame([(1,)], "k long"))
    assert gone.count() == 2 and pairs(rest) == [(5, 0)]


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2**64 - 1)), min_size=1, max_size=12), st.sampled_from([1, 2, 4, 8]))
def test_merge(spark, rows, width):
    top = 1 << (8 * width)
    df = spark.createDataFrame([(k, str(v)) for k, v in rows], "k long, v string").withColumn("v", F.col("v").cast("decimal(20,0)"))
    c = F.col("v")
    got = {r.k: (int(r.a), int(r.s), int(r.hi), int(r.lo)) for r in df.groupBy("k").agg(merge.numeric_add(c, width).alias("a"), merge.saturating_add(c, width).alias("s"), merge.numeric_max(c, width).alias("hi"), merge.numeric_min(c, width).alias("lo")).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        vs = [v % top for x, v in rows if x == k]
        want[k] = (sum(vs) % top, min(sum(vs), top - 1), max(vs), min(vs))
    assert got == want


def test_ordered_folds(spark):
    rows = [("a", 3, b"3"), ("a", 1, b"1"), ("b", 2, b"x"), ("a", 70000, b"4"), ("a", 2, None)]
    df = spark.createDataFrame(rows, "k string, o long, v binary")
    assert {r.k: bytes(r.all) for r in merge.bytes_append(df, ["k"], "v", "o", "all").collect()} == {"a": b"134", "b": b"x"}
    n = spark.createDataFrame([(k, o, o % 7) for k in "abc" for o in range(50)], "k string, o long, n long")
    step = lambda key, old, new: None if new == 6 else (old or 0) * 2 + new
    want = {k: reduce(lambda a, o: step(k, a, o % 7), range(50), None) for k in "abc"}
    assert {r.k: r.x for r in merge.fold_python(n, ["k"], "n", "o", T.StructField("x", T.LongType()), step).collect()} == want


def test_ttl(spark):
    t = spark.createDataFrame([(1, 0), (2, 100), (3, 101)], "k long, expires_at_ms long")
    assert [r.k for r in ttl.scan(t, "k", 100).collect()] == [1, 3]
    assert ttl.purge(t, 100)[0].first()[0] == 1 and ttl.len_with_expired(t).first()[0] == 3
    old, rest = ttl.remove(t, spark.createDataFrame([(2,)], "k long"), "k")
    assert [r.k for r in old.collect()] == [2] and rest.count() == 2
    big = spark.range(1).select(ttl.expiry(F.lit(5).cast("long"), F.lit((1 << 63) - 1)).alias("x"), ttl.expiry(F.lit(5).cast("long"), F.lit(None).cast("long")).alias("y")).first()
    assert big.x == (1 << 63) - 1 and big.y == 0
