"""Multimaps: unique (key, value) rows; the values of a key form a sorted set."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Bounds


def of(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A multimap from any rows: distinct pairs."""
    return rows.select(F.col(key).alias("k"), F.col(value).alias("v")).distinct()


def get(m: DataFrame, key: Any) -> DataFrame:
    return m.filter(F.col("k") == F.lit(key)).orderBy("v")


def scan(m: DataFrame, bounds: Bounds = Bounds(), *, reverse: bool = False) -> DataFrame:
    """(k, v) of a key range, by key and then value (values ascend in either direction)."""
    return m.filter(bounds.predicate("k")).orderBy(F.col("k").desc() if reverse else F.col("k"), "v")


def grouped(m: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """(k, values as a sorted array). Its rows are as long as a key has values; use ``scan`` where that has no bound."""
    return m.filter(bounds.predicate("k")).groupBy("k").agg(F.array_sort(F.collect_set("v")).alias("values"))


def length(m: DataFrame) -> DataFrame:
    """The number of values, not of keys."""
    return m.agg(F.count("*").alias("len"))


def value_count(m: DataFrame) -> DataFrame:
    return m.groupBy("k").agg(F.count("*").alias("n_values"))


def insert(m: DataFrame, pairs: DataFrame) -> DataFrame:
    return m.select("k", "v").unionByName(pairs.select("k", "v")).distinct()


def existed(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, v, existed): what inserting or removing each pair returns."""
    have = m.select("k", "v", F.lit(True).alias("existed"))
    return pairs.select("k", "v").distinct().join(have, ["k", "v"], "left").select("k", "v", F.coalesce("existed", F.lit(False)).alias("existed"))


def remove(m: DataFrame, pairs: DataFrame) -> DataFrame:
    return m.join(pairs.select("k", "v").distinct(), ["k", "v"], "left_anti")


def remove_all(m: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values removed, rest)."""
    keys = keys.select("k").distinct()
    return m.join(keys, "k", "left_semi"), m.join(keys, "k", "left_anti")


def drain(m: DataFrame, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """(number of values removed, rest)."""
    inside: Column = bounds.predicate("k")
    return m.filter(inside).agg(F.count("*").alias("drained")), m.filter(~inside)
