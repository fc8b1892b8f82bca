"""Tables with expiry: a column ``expires_at_ms``, 0 for never. The time of a read is always passed in."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Bounds

EXPIRY = "expires_at_ms"
LARGEST = (1 << 63) - 1


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def live(as_of_ms: int) -> Column:
    return (F.col(EXPIRY) == 0) | (F.col(EXPIRY) > F.lit(as_of_ms))


def expiry(now_ms: Column, ttl_ms: Column) -> Column:
    """now + ttl, held at the largest value; a null ttl never expires."""
    room = F.lit(LARGEST) - now_ms
    return F.when(ttl_ms.isNull(), F.lit(0).cast("long")).when(ttl_ms > room, F.lit(LARGEST)).otherwise(now_ms + ttl_ms)


def get(table: DataFrame, key: str, value: Any, as_of_ms: int) -> DataFrame:
    return table.filter((F.col(key) == F.lit(value)) & live(as_of_ms))


def scan(table: DataFrame, key: str, as_of_ms: int, bounds: Bounds = Bounds()) -> DataFrame:
    return table.filter(bounds.predicate(key) & live(as_of_ms)).orderBy(key)


def len_with_expired(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("len_with_expired"))


def purge(table: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame]:
    """(number of rows purged, live rows)."""
    return table.agg(F.count_if(~live(as_of_ms)).alias("purged")), table.filter(live(as_of_ms))


def remove(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(old rows, even if expired; rest)."""
    keys = keys.select(key).distinct()
    return table.join(keys, key, "left_semi"), table.join(keys, key, "left_anti")
