"""Ranges that end after a blob."""

from __future__ import annotations

import pytest

from lodestrata.operators import blobs
from lodestrata.plans import catalog

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize(("n", "want"), [(2500, "x" * 1200), (2100, "x" * 1100), (1000, ""), (5, "")])
def test_range_read_of_a_short_text(spark, tmp_path, n, want):
    spark.createDataFrame([(3, "x" * n, "en", "s")], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in catalog.blob_range_read(spark, str(tmp_path)).collect()] == [(3, want.encode().hex().upper())]


def test_clip(spark):
    store = blobs.ingest(spark.createDataFrame([(1, b"abcdef")], "seq long, data binary"), seq="seq", data="data", chunk=4)
    read = lambda *a, **b: [bytes(r.data) for r in blobs.read_range(store, *a, chunk=4, **b).collect()]
    assert read(1, 2, 4) == read(1, 2, 9, clip=True) == [b"cdef"] and read(2, 0, 1, clip=True) == []
    for seq, offset, length, clip, error in ((1, 2, 9, False, blobs.BlobRangeOutOfBounds), (1, -1, 2, True, blobs.BlobRangeOutOfBounds), (2, 0, 1, False, KeyError)):
        with pytest.raises(error):
            read(seq, offset, length, clip=clip)
