"""Change data capture, retention, cursors, and differences between versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class CursorBehindRetention(ValueError):
    pass


def capture(writes: DataFrame, *, keys: list[str], order: list[str], value: str, deleted: str) -> DataFrame:
    """The change log of a sequence of writes: op (insert, update, delete), old_value and new_value.

    The old value is the one before in order, where that was no delete. A delete of what isn't there is no
    event. Only neighbours of one key are compared, and rows of a key are dealt by key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before, there = F.lag(value).over(w), F.coalesce(~F.lag(deleted).over(w), F.lit(False))
    seen = writes.withColumn("__there", there).withColumn("old_value", F.when(F.col("__there"), before))
    op = F.when(F.col(deleted), F.when(F.col("__there"), F.lit("delete"))).when(F.col("__there"), F.lit("update")).otherwise(F.lit("insert"))
    return seen.select(*keys, *order, op.alias("op"), "old_value", F.when(~F.col(deleted), F.col(value)).alias("new_value")).filter("op is not null")


def check_retention(log: DataFrame, after: int, txn: str = "txn") -> None:
    """Raise where events after the cursor may have been dropped; a cursor of 0 asks for what there is."""
    if after <= 0:
        return
    oldest = log.agg(F.min(txn).alias("t")).first().t
    if oldest is not None and oldest > after + 1:
        raise CursorBehindRetention(f"cursor {after}, oldest event {oldest}")


def since(log: DataFrame, after: int, *, txn: str = "txn", seq: str = "seq", check: bool = True) -> DataFrame:
    if check:
        check_retention(log, after, txn)
    return log.filter(F.col(txn) > after).orderBy(txn, seq)


def between(log: DataFrame, start: int, end: int, *, txn: str = "txn", seq: str = "seq", check: bool = False) -> DataFrame:
    """Both ends included; an inverted range is empty."""
    if check and start <= end:
        check_retention(log, start - 1, txn)
    return log.filter(F.col(txn).between(start, end)).orderBy(txn, seq)


def latest(log: DataFrame, txn: str = "txn") -> DataFrame:
    return log.agg(F.max(txn).alias("latest_txn"))


def retained(log: DataFrame, current: int, most: int, cursors: DataFrame | None = None, *, txn: str = "txn") -> DataFrame:
    """Drop events up to min(current - most, oldest cursor), where current > most > 0."""
    if not current > most > 0:
        return log
    limit = current - most
    if cursors is None:
        return log.filter(F.col(txn) > limit)
    oldest = cursors.agg(F.least(F.lit(limit), F.coalesce(F.min("position"), F.lit(limit))).alias("__limit"))
    return log.join(F.broadcast(oldest), F.col(txn) > F.col("__limit")).drop("__limit")


def advance_cursor(cursors: DataFrame, name: str, position: int) -> DataFrame:
    """A cursor's new place; it may move back."""
    spark = cursors.sparkSession
    return cursors.filter(F.col("name") != name).select("name", "position").unionByName(spark.createDataFrame([(name, position)], "name string, position long"))


# ---- versions ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Diff:
    upserts: DataFrame
    deletes: DataFrame  # keys only

    def counts(self) -> DataFrame:
        a = self.upserts.agg(F.count("*").alias("upserts"))
        return a.crossJoin(F.broadcast(self.deletes.agg(F.count("*").alias("deletes"))))


def diff(base: DataFrame, current: DataFrame, keys: list[str]) -> Diff:
    """What turns ``base`` into ``current``; a null value equals a null value."""
    values = [c for c in current.columns if c not in keys]
    old = base.select(*keys, F.struct(*values).alias("__old"), F.lit(True).alias("__had"))
    new = current.join(old, keys, "left")
    same = F.struct(*values).eqNullSafe(F.col("__old"))
    return Diff(new.filter(F.col("__had").isNull() | ~same).select(*current.columns), base.join(current.select(*keys), keys, "left_anti").select(*keys))


def apply_diff(base: DataFrame, d: Diff, keys: list[str]) -> DataFrame:
    gone = d.deletes.select(*keys).unionByName(d.upserts.select(*keys))
    return base.join(gone, keys, "left_anti").select(*d.upserts.columns).unionByName(d.upserts)


def export_diff(d: Diff, folder: str) -> None:
    """An incremental backup: upserts and deletes as two tables."""
    d.upserts.write.parquet(f"{folder}/upserts")
    d.deletes.write.parquet(f"{folder}/deletes")


def import_diff(spark: SparkSession, folder: str) -> Diff:
    return Diff(spark.read.parquet(f"{folder}/upserts"), spark.read.parquet(f"{folder}/deletes"))


def as_of(commits: DataFrame, at: int, *, version: str = "version", ts: str = "ts_ms") -> DataFrame:
    """The highest version whose time is not after ``at``."""
    return commits.agg(F.max(F.when(F.col(ts) <= at, F.col(version))).alias("version"))


def state_at(history: DataFrame, version: int, keys: list[str], *, at: str = "version", deleted: str | None = None) -> DataFrame:
    """The table as it was: each key's last row up to a version, unless that deleted it. Combines before the shuffle."""
    rest = [c for c in history.columns if c not in keys]
    won = history.filter(F.col(at) <= version).groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("__v"))
    out = won.select(*keys, *[F.col("__v")[c].alias(c) for c in rest])
    return out.filter(~F.col(deleted)) if deleted else out
