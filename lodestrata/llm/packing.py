"""Packing by shortest-pack-first over the length histogram.

Each text is encoded, an end id is appended, and the ids are cut into pieces of at most ``capacity``.
Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. Lengths are
placed longest first, each into the packs with most room left, where any has enough; what is updated are counts of
packing patterns, not packs. Every pattern then claims a range of ranks of each of its lengths, and
pieces join their pattern by rank among the pieces of equal length: the task that cut a piece numbers it
within its own output, and a running sum over tasks makes that number global. No length, however
common, is gathered in one task.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each for itself.
An empty table gives no rows. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import byte_slices, pass_through, plain_strings, small_batches, work_dir
from .tokens import TEXT_BYTES, encoder

#: Rows of the table of running sums up to which it is broadcast (about 24 bytes each).
BROADCAST_ROWS = 1_000_000

PIECES = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)
RESULT = T.StructType([*PIECES, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of a pack, number of such packs)]. Each step splits one pattern at most, so there are at most two for each length."""
    room: dict[int, list[list]] = {}
    open_ = []  # largest room first
    done: list[tuple[list[int], int]] = []

    def put(pack: list[int], count: int, left: int) -> None:
        if left <= 0:
            done.append((pack, count))
            return
        if left not in room:
            heapq.heappush(open_, -left)
            room[left] = []
        room[left].append([pack, count])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        placed = []
        while n:
            while open_ and not room.get(-open_[0]):
                room.pop(-heapq.heappop(open_), None)
            left = -open_[0] if open_ else 0
            # one pack may take several of this length: as deep as its room, while packs of most room are levelled
            if left < length:
                placed.append(([length], n, capacity - length))
                n = 0
            else:
                pack, count = room[left].pop()
                take = min(n, count)
                if take < count:
                    room[left].append([pack, count - take])
                put([*pack, length], take, left - length)
                n -= take
        for x in placed:
            # new packs of one piece each; fold them together while several fit
            pack, count, left = x
            depth = capacity // length
            if depth > 1 and count > 1:
                full, rest = divmod(count, depth)
                if full:
                    put([length] * depth, full, capacity - depth * length)
                if rest:
                    put([length] * rest, 1, capacity - rest * length)
            else:
                put(pack, count, left)
    return done + [(p, c) for packs in room.values() for p, c in packs]


def slots(found: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset in the sequence)."""
    out, used, base = [], {}, 0
    for pack, count in found:
        at = 0
        for length in pack:
            lo = used.get(length, 0)
            out.append((length, lo, lo + count, base, at))
            used[length] = lo + count
            at += length
        base += count
    return out


def cut_pieces(documents: DataFrame, tokenizer_path: str, *, text_col: str, keep: list[str] | None, end_id: int, capacity: int) -> DataFrame:
    """One row a piece, with the number of the task that cut it and its rank among the task's pieces of that length."""
    small_batches(documents.sparkSession)
    kept = pass_through(documents, keep, RESULT)
    schema = T.StructType([*[documents.schema[c] for c in kept], *PIECES, T.StructField("__part", T.LongType()), T.StructField("__rank", T.LongType())])

    def run(batches):
        enc, seen, end = encoder(tokenizer_path), np.zeros(capacity + 1, np.int64), np.array([end_id], np.uint32).tobytes()
        part = TaskContext.get().partitionId()
        for b in batches:
            for s in byte_slices(b, b.num_columns - 1, TEXT_BYTES):
                ids = [x + end for x in enc.encode([t or "" for t in plain_strings(s.column(s.num_columns - 1)).to_pylist()])]
                total = np.array([len(x) // 4 for x in ids], np.int64)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(ids)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, total[row] - start)
                rank = np.empty(len(row), np.int64)
                for i, k in enumerate(length.tolist()):
                    rank[i] = seen[k]
                    seen[k] += 1
                cells = [ids[r][4 * i : 4 * (i + k)] for r, i, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[s.column(i).take(at) for i in range(s.num_columns - 1)], pa.array(start), pa.array(length), pa.array(cells, pa.binary()), pa.array(total[row]), pa.array(np.full(len(row), part, np.int64)), pa.array(rank)], names=schema.names)
        enc.rest()

    return documents.select(*[documents[c] for c in kept], documents[text_col].cast("string").alias("__text")).mapInArrow(run, schema)


def pack(documents: DataFrame, tokenizer_path: str, *, text_col: str = "text", keep: list[str] | None = None, end_id: int = 0, capacity: int = 1024) -> DataFrame:
    """Kept columns and, one row a piece: start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    pieces = cut_pieces(documents, tokenizer_path, text_col=text_col, keep=keep, end_id=end_id, capacity=capacity)
    folder = work_dir(spark, "pieces")
    pieces.write.parquet(folder)
    pieces = spark.read.schema(pieces.schema).parquet(folder)
    parts = pieces.groupBy("__part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select("__part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    sums.write.parquet(f"{folder}-sums")
    sums = spark.read.schema(sums.schema).parquet(f"{folder}-sums")
    histogram = {r["length"]: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    claims = spark.createDataFrame(slots(patterns(histogram, capacity)), "length long, lo long, hi long, base long, at long")
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    ranked = pieces.join(sums, ["__part", "length"]).withColumn("__at", F.col("__before") + F.col("__rank"))
    c = F.broadcast(claims.withColumnRenamed("length", "__length"))
    placed = ranked.join(c, (F.col("length") == F.col("__length")) & (F.col("__at") >= F.col("lo")) & (F.col("__at") < F.col("hi")))
    names = [x for x in pieces.columns if x not in ("__part", "__rank")]
    return placed.select(*names, (F.col("base") + F.col("__at") - F.col("lo")).alias("sequence_id"), F.col("at").alias("offset"))
