"""Ordered tables: one row a key. Every operator is a DataFrame transformation; mutations return the new table.

Order is that of the key columns, nulls first (an absent optional key sorts before all others).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """A key range; None is unbounded. ``include_*`` say whether the ends belong to it."""

    low: Any = None
    high: Any = None
    include_low: bool = True
    include_high: bool = False

    def predicate(self, key: str) -> Column:
        c = F.lit(True)
        if self.low is not None:
            c = c & (F.col(key) >= F.lit(self.low) if self.include_low else F.col(key) > F.lit(self.low))
        if self.high is not None:
            c = c & (F.col(key) <= F.lit(self.high) if self.include_high else F.col(key) < F.lit(self.high))
        return c


def _order(keys: list[str], reverse: bool = False) -> list[Column]:
    return [F.col(k).desc_nulls_last() if reverse else F.col(k).asc_nulls_first() for k in keys]


# ---- reads -------------------------------------------------------------------------------------


def get(table: DataFrame, key: str, value: Any) -> DataFrame:
    """The row of a key, or none. Reaches the scan as a pushed filter."""
    return table.filter(F.col(key) == F.lit(value))


def scan(table: DataFrame, key: str, bounds: Bounds = Bounds(), *, reverse: bool = False) -> DataFrame:
    """Rows of a key range in order of the key."""
    return table.filter(bounds.predicate(key)).orderBy(*_order([key], reverse))


def first(table: DataFrame, *keys: str) -> DataFrame:
    """The row of the smallest key (top-1 of each partition, then of those)."""
    return table.orderBy(*_order(list(keys))).limit(1)


def last(table: DataFrame, *keys: str) -> DataFrame:
    return table.orderBy(*_order(list(keys), reverse=True)).limit(1)


def length(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("len"))


# ---- writes ------------------------------------------------------------------------------------


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The table after inserting ``changes``; of several changes of a key, the one with the largest ``order`` wins.

    One aggregation that combines before the shuffle: a hot key's changes never meet in one task.
    """
    values = [c for c in table.columns if c not in keys]
    rank = F.struct(F.lit(1).alias("new"), (F.col(order) if order else F.lit(0)).alias("at"))
    base = table.select(*keys, F.struct(F.lit(0).alias("new"), (F.lit(None).cast(changes.schema[order].dataType) if order else F.lit(0)).alias("at")).alias("__at"), F.struct(*values).alias("__v"))
    news = changes.select(*keys, rank.alias("__at"), F.struct(*values).alias("__v"))
    won = base.unionByName(news).groupBy(*keys).agg(F.max_by("__v", "__at").alias("__v"))
    return won.select(*keys, *[F.col("__v")[c].alias(c) for c in values])


def replaced(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """What an insert or remove of these keys returns: the rows they had before."""
    return table.join(changes.select(*keys).distinct(), keys, "left_semi")


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def pop_first(table: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(the row of the smallest key, the rest)."""
    top = first(table, *keys)
    return top, table.join(top.select(*keys), list(keys), "left_anti")


def pop_last(table: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    top = last(table, *keys)
    return top, table.join(top.select(*keys), list(keys), "left_anti")


def extract_if(table: DataFrame, predicate: Column, within: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows taken out, rows left), all matches consumed. A null predicate takes nothing."""
    hit = F.coalesce(predicate, F.lit(False)) & (F.lit(True) if within is None else F.coalesce(within, F.lit(False)))
    return table.filter(hit), table.filter(~hit)


def retain(table: DataFrame, predicate: Column, within: Column | None = None) -> DataFrame:
    """Rows for which the predicate holds; outside ``within`` all rows stay."""
    ok = F.coalesce(predicate, F.lit(False))
    return table.filter(ok if within is None else ok | ~F.coalesce(within, F.lit(False)))


def drain(table: DataFrame, key: str, bounds: Bounds = Bounds()) -> tuple[DataFrame, DataFrame]:
    """(number of rows deleted, rows left)."""
    inside = F.coalesce(bounds.predicate(key), F.lit(False))
    return table.filter(inside).agg(F.count("*").alias("drained")), table.filter(~inside)
