"""Queries over a whole table beside those over a prefix or a range."""

from __future__ import annotations

import os

import pytest

from lodestrata.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_whole_operands_and_keys(spark):
    q = catalog.queries()
    types = {r.event_type for r in catalog._events(spark, SF).select("event_type").distinct().collect()}
    logs = {x for r in q["merge_bytes_append_whole"](spark, SF).collect() for x in r.log.split("|")[:-1]}
    assert logs == types and max(map(len, types)) > 1
    keys = {r.k for r in catalog._mm(spark, SF).select("k").distinct().collect()}
    assert {r.k for r in q["mm_grouped_whole"](spark, SF).collect()} == keys
