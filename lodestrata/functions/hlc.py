"""Hybrid logical clocks: 48 bits of milliseconds, 16 bits of a logical counter, in one BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGICAL = 0xFFFF


def from_parts(physical_ms: Column, logical: Column) -> Column:
    return F.shiftleft(physical_ms.cast("long"), 16).bitwiseOR(logical.cast("long").bitwiseAND(F.lit(LOGICAL)))


def physical(h: Column) -> Column:
    return F.shiftrightunsigned(h, 16)


def logical(h: Column) -> Column:
    return h.bitwiseAND(F.lit(LOGICAL).cast("long"))


def from_wall_ns(ns: Column) -> Column:
    return from_parts(F.call_function("div", ns, F.lit(1_000_000)), F.lit(0))


def _step(p: Column, n: Column) -> Column:
    """(p, n) one later: a full counter moves the physical part by a millisecond."""
    return F.when(n >= LOGICAL, from_parts(p + 1, F.lit(0))).otherwise(from_parts(p, n + 1))


def tick(h: Column, now_ms: Column) -> Column:
    """The next local event."""
    return F.when(now_ms > physical(h), from_parts(now_ms, F.lit(0))).otherwise(_step(physical(h), logical(h)))


def merge(h: Column, other: Column, now_ms: Column) -> Column:
    """After a message: later than both clocks."""
    top = F.greatest(h, other)
    return F.when(now_ms > physical(top), from_parts(now_ms, F.lit(0))).otherwise(_step(physical(top), logical(top)))
