"""Connected components: both ways give the same, and few edges take few jobs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestrata.llm.components import components, smallest


def plain(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


def shapes():
    r = random.Random(7)
    chain = [(i, i + 1) for i in range(300)]
    mixed = list(range(1 << 33, (1 << 33) + 200))
    r.shuffle(mixed)
    return {
        "none": [],
        "loop": [(5, 5), (7, 7), (7, 9)],
        "chain": chain,
        "shuffled chain": list(zip(mixed, mixed[1:], strict=False)),
        "stars": [(1000 - i % 3, i) for i in range(600)] + [(2000, 3 * i) for i in range(9)],
        "random": [(r.randrange(900), r.randrange(900)) for _ in range(500)] * 2,
    }


@pytest.mark.parametrize("shape", shapes())
def test_smallest(shape):
    edges = shapes()[shape]
    u, v = np.array(edges, np.int64).reshape(-1, 2).T
    assert dict(zip(*[x.tolist() for x in smallest(u, v)], strict=True)) == plain(edges)


@pytest.mark.parametrize("alone", [0, 1 << 19])
def test_one_task_and_rounds(spark, alone):
    for shape in ("none", "stars", "random"):
        edges = shapes()[shape]
        got = components(spark.createDataFrame(edges, "a long, b long"), alone=alone).collect()
        assert {x.node: x.label for x in got} == plain(edges) and len(got) == len(plain(edges))


def test_few_edges_take_few_jobs(spark):
    sc, edges = spark.sparkContext, shapes()["shuffled chain"]
    sc.setJobGroup("few-edges", "components")
    try:
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {x.node: x.label for x in got} == plain(edges)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("few-edges")) <= 8
