"""The engine in one object: a versioned store with change capture, retention, cursors and group commit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import blobs, changes, ordered
from ..operators.blobs import DEDUP_MIN
from ..sources.store import TableStore, Transaction, folders, written_by

LOG, CURSORS, BLOBS = "__changes", "__cursors", "__blob_"
LOG_SCHEMA = "txn long, seq long, tab string, op string, key string, old_value string, new_value string"
CURSOR_SCHEMA = "name string, position long"


@dataclass(frozen=True)
class EngineConfig:
    """The switches that change what queries see."""

    cdc: bool = False
    cdc_retention: int = 0  # transactions; 0: all
    history_retention: int = 0  # versions; 0: all
    blob_dedup: bool = False
    blob_dedup_min: int = DEDUP_MIN


def as_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


class PeerFailed(RuntimeError):
    """Another change of the same group failed, so none was applied."""


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: EngineConfig = EngineConfig()) -> None:
        self.spark, self.config = spark, config
        self.store = TableStore(spark, root, keep=config.history_retention)

    # ---- writes ----

    def apply(self, txn: Transaction, name: str, keys: list[str], upserts: DataFrame | None = None, deletes: DataFrame | None = None, order: str | None = None) -> None:
        """Upsert and then delete rows of a table; events go to the change log. A delete of what isn't there is no event.

        Of several upserts of a key the one with the largest ``order`` counts (without: that with the largest values), as one event.
        """
        if name in txn.tables:
            base = txn.read(name)
        elif upserts is not None:
            base = self.spark.createDataFrame([], upserts.drop(order).schema if order else upserts.schema)
        else:
            return
        values = [c for c in base.columns if c not in keys]
        now, events = base, []
        had = base.select(*keys, as_json(values).alias("old_value"))
        if upserts is not None:
            won = upserts.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order) if order else F.struct(*values)).alias("__v"))
            new = won.select(*[F.col(c) if c in keys else F.col("__v")[c].alias(c) for c in base.columns])
            events.append(new.join(had, keys, "left").select(*keys, F.when(F.col("old_value").isNull(), "insert").otherwise("update").alias("op"), "old_value", as_json(values).alias("new_value")))
            now = now.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(new)
        if deletes is not None:
            gone = deletes.select(*keys).distinct()
            before = now.select(*keys, as_json(values).alias("old_value"))
            events.append(gone.join(before, keys).select(*keys, F.lit("delete").alias("op"), "old_value", F.lit(None).cast("string").alias("new_value")))
            now = now.join(gone, keys, "left_anti").select(*base.columns)
        self._log(txn, name, keys, events)
        txn.write(name, now)

    def retain(self, txn: Transaction, name: str, keys: list[str], predicate: Column, within: Column | None = None) -> None:
        """Delete the rows for which the predicate doesn't hold."""
        self.extract(txn, name, keys, ~F.coalesce(predicate, F.lit(False)), within)

    def extract(self, txn: Transaction, name: str, keys: list[str], predicate: Column, within: Column | None = None) -> DataFrame:
        """Delete the rows for which the predicate holds, and return them."""
        taken, _ = ordered.extract_if(txn.read(name), predicate, within)
        self.apply(txn, name, keys, None, taken)
        return taken

    def drain(self, txn: Transaction, name: str, key: str, bounds: ordered.Bounds = ordered.Bounds()) -> None:
        self.extract(txn, name, [key], bounds.predicate(key))

    def merge(self, txn: Transaction, name: str, keys: list[str], merged: DataFrame) -> None:
        """Write what a merge operator made of a table's values and its operands."""
        self.apply(txn, name, keys, merged)

    def insert_pairs(self, txn: Transaction, name: str, pairs: DataFrame) -> None:
        """Add (k, v) pairs to a multimap; a pair that it has is no event."""
        pairs = pairs.select("k", "v").distinct()
        new = pairs if name not in txn.tables else pairs.join(txn.read(name), ["k", "v"], "left_anti")
        nothing = F.lit(None).cast("string")
        self._log(txn, name, ["k"], [new.select("k", F.lit("insert").alias("op"), nothing.alias("old_value"), as_json(["v"]).alias("new_value"))])
        txn.append(name, new)

    def remove_pairs(self, txn: Transaction, name: str, gone: DataFrame) -> None:
        """Remove pairs (columns k and v) or all values of keys (column k) from a multimap."""
        on, m, nothing = [c for c in ("k", "v") if c in gone.columns], txn.read(name), F.lit(None).cast("string")
        gone = gone.select(*on).distinct()
        self._log(txn, name, ["k"], [m.join(gone, on, "left_semi").select("k", F.lit("delete").alias("op"), as_json(["v"]).alias("old_value"), nothing.alias("new_value"))])
        txn.write(name, m.join(gone, on, "left_anti").select("k", "v"))

    def drain_pairs(self, txn: Transaction, name: str, bounds: ordered.Bounds = ordered.Bounds()) -> None:
        self.remove_pairs(txn, name, txn.read(name).filter(bounds.predicate("k")).select("k"))

    def _log(self, txn: Transaction, name: str, keys: list[str], events: list[DataFrame]) -> None:
        """Append events to the change log (a folder for each call), and drop the folders beyond its retention."""
        if not self.config.cdc or not events:
            return
        every = events[0]
        for e in events[1:]:
            every = every.unionByName(e)
        number = txn.base + 1
        rows = every.select(F.lit(number).cast("long").alias("txn"), F.lit(name).alias("tab"), "op", as_json(keys).alias("key"), "old_value", "new_value")
        mine = [f for f in folders(txn.tables.get(LOG, [])) if written_by(f) == number]
        last = self.spark.read.schema(LOG_SCHEMA).parquet(*mine).agg(F.max("seq").alias("n")).first().n if mine else None
        # numbers rise in order of key and leave gaps between tasks
        dealt = rows.repartitionByRange("op", "key").sortWithinPartitions("op", "key").withColumn("seq", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1))
        txn.append(LOG, dealt.select("txn", "seq", "tab", "op", "key", "old_value", "new_value"))
        if number > self.config.cdc_retention > 0:
            limit = number - self.config.cdc_retention
            if CURSORS in txn.tables:
                oldest = txn.read(CURSORS).agg(F.min("position").alias("p")).first().p
                limit = limit if oldest is None else min(limit, oldest)
            txn.tables[LOG] = [f for f in folders(txn.tables[LOG]) if written_by(f) > limit]

    def store_blobs(self, txn: Transaction, rows: DataFrame, **columns) -> None:
        """Add a batch to the blob catalogue, with the dedup that the configuration asks for."""
        switches = {"dedup": self.config.blob_dedup, "dedup_min": self.config.blob_dedup_min}
        if f"{BLOBS}meta" not in txn.tables:
            new = blobs.ingest(rows, **switches, **columns)
            for part in ("meta", "chunks", "tags", "namespaces"):
                txn.write(f"{BLOBS}{part}", getattr(new, part))
            return
        old = self.blobs(txn)
        both = blobs.append(old, rows, **switches, **columns)
        mine = lambda df: df.join(old.meta.select("seq"), "seq", "left_anti").select(*df.columns)
        for part in ("meta", "chunks", "tags", "namespaces"):
            txn.append(f"{BLOBS}{part}", mine(getattr(both, part)))

    def blobs(self, txn: Transaction | None = None) -> blobs.Store:
        read = txn.read if txn is not None else self.store.read
        return blobs.Store(*[read(f"{BLOBS}{part}") for part in ("meta", "chunks", "tags", "namespaces")])

    def commit(self, stamp_ms: int, *writes: Callable[[Transaction], None]) -> int:
        """Group commit: all writes become visible together, or none does and the others' failure is PeerFailed."""
        txn, failed = self.store.begin(stamp_ms), None
        for w in writes:
            try:
                w(txn)
            except Exception as e:
                failed = e
                break
        if failed is not None:
            raise PeerFailed(f"a write of the group failed: {failed}") from failed
        return txn.commit()

    # ---- reads ----

    def read(self, name: str, version: int | None = None, declared: T.StructType | None = None) -> DataFrame:
        return self.store.read(name, version, declared)

    def log(self) -> DataFrame:
        return self.store.read(LOG) if self.store.tables() and self.store.fingerprint(LOG, self.store.latest()) else self.spark.createDataFrame([], LOG_SCHEMA)

    def changes_since(self, after: int) -> DataFrame:
        return changes.since(self.log(), after)

    def cursor(self, name: str) -> int | None:
        if CURSORS not in self.store.tables():
            return None
        found = self.store.read(CURSORS).filter(F.col("name") == name).take(1)
        return found[0].position if found else None

    def advance_cursor(self, name: str, position: int, stamp_ms: int) -> int:
        def write(txn: Transaction) -> None:
            old = txn.read(CURSORS) if CURSORS in txn.tables else self.spark.createDataFrame([], CURSOR_SCHEMA)
            txn.write(CURSORS, changes.advance_cursor(old, name, position))

        return self.commit(stamp_ms, write)

    def changes_between(self, name: str, old: int, new: int, keys: list[str]) -> changes.Diff:
        """What turns one version of a table into another; nothing is read where both share its files."""
        a, b = self.store.read(name, old), self.store.read(name, new)
        if self.store.fingerprint(name, old) == self.store.fingerprint(name, new):
            return changes.Diff(b.limit(0), b.select(*keys).limit(0))
        return changes.diff(a, b, keys)
