"""Live change feeds by Structured Streaming: the checkpoint is the cursor.

``tail`` follows a folder of change files. ``apply_batches`` folds each micro-batch into a versioned table
as one commit, all or nothing, and skips a batch it has already committed. ``windows`` counts events in
time windows with a watermark for late data, and ``expiring`` passes on the rows of a TTL table that are live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import TableStore


def tail(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def apply_batches(stream: DataFrame, store: TableStore, name: str, keys: list[str], order: str, checkpoint: str, stamp_ms: Callable[[int], int] = lambda batch: batch):
    """Group commit: a micro-batch's changes become visible together; of each key the row with the largest
    ``order`` stays, whatever batch brought it. Start with ``.start()``, or run what is there with ``availableNow``."""

    def commit(batch: DataFrame, number: int) -> None:
        txn = store.begin(stamp_ms(number))
        done = f"__batches_{name}"
        if done in txn.tables and not txn.read(done).filter(F.col("batch") == number).isEmpty():
            return  # a restart repeats the last batch
        spark = batch.sparkSession
        every = txn.read(name).unionByName(batch) if name in txn.tables else batch
        rest = [c for c in batch.columns if c not in keys]
        won = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__v"))
        txn.write(name, won.select(*keys, *[F.col("__v")[c].alias(c) for c in rest]))
        txn.write(done, spark.createDataFrame([(number,)], "batch long"))
        txn.commit()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def windows(stream: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are dropped, as state must end."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def expiring(stream: DataFrame, as_of_ms: int) -> DataFrame:
    """Live rows as they arrive."""
    return stream.filter((F.col("expires_at_ms") == 0) | (F.col("expires_at_ms") > as_of_ms))
