"""Token-id files of independent zstandard frames with a trailing seek table.

Layout of a file, in the public seekable format of zstandard:

- one frame for each document, in ascending order of id, each with zstandard's own content checksum;
- a skippable frame with the document ids (so that a reader finds a document's frame);
- a skippable frame with the seek table: for each frame its compressed and decompressed size and the low
  32 bits of the XXH64 of its content, then the number of frames, a descriptor and the magic number.

A reader takes the end of the file, then only the frames of the documents asked for. Ids are stored
in 16 bits where the vocabulary allows it.

Writing: documents are dealt by range of id, one file a task, and a task publishes its file under its
final name when it is whole, so a repeated attempt replaces it with an equal one. A small manifest (one
row a file) carries the running number of ids and the least and greatest document id, so that a request for a few
documents opens only the files that may hold them.

Defined results: a null or empty text is the end id alone. Null ids come first; rows of equal id follow
in order of a hash of their text, and then of the text. An empty table gives no files. Further input columns are not stored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import byte_slices, move_shared, one_each, open_shared, plain_strings, small_batches
from .tokens import TEXT_BYTES, encoder

#: Fixed values of the format.
INDEX_MAGIC, SEEK_MAGIC, END_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

MANIFEST = "file string, part long, n_docs long, n_tokens long, least long, greatest long, n_null long"


class Writer:
    """Writes one file, frame by frame."""

    def __init__(self, sink, width: int, level: int = 3) -> None:
        import zstandard

        self.sink, self.width, self.pack = sink, width, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.pack.compress(raw)
        self.sink.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        known = np.array([x is not None for x in self.ids], np.uint8)
        body = struct.pack("<QB", len(self.ids), self.width) + known.tobytes() + np.array([x or 0 for x in self.ids], "<i8").tobytes()
        index = struct.pack("<II", INDEX_MAGIC, len(body)) + body
        self.sink.write(index)
        self.entries.append((len(index), 0, 0))
        table = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, END_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class Reader:
    """Reads the seek table and index at once, and frames only when asked for."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.open = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != END_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.table = table
        body = source.read_at(int(table[-1, 0]), int(self.at[n - 1]))
        docs, self.width = struct.unpack_from("<QB", body, 8)
        known = np.frombuffer(body, np.uint8, docs, 17)
        ids = np.frombuffer(body, "<i8", docs, 17 + docs)
        self.ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]

    def __len__(self) -> int:
        return len(self.ids)

    def n_tokens(self, i: int) -> int:
        return int(self.table[i, 1]) // self.width

    def frame(self, i: int) -> bytes:
        """Document i's ids as little-endian unsigned 32-bit integers; its checksum is compared."""
        import xxhash

        raw = self.open.decompress(self.source.read_at(int(self.table[i, 0]), int(self.at[i])))
        if len(raw) != self.table[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} doesn't match its checksum")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes()

    def find(self, doc_ids: set[int]) -> list[int]:
        return [i for i, x in enumerate(self.ids) if x in doc_ids]


def write_token_files(documents: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Encode and write; the manifest (file, part, n_docs, n_tokens, least, greatest, n_null, start), kept in ``folder``/manifest."""
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    by = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = (rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)).sortWithinPartitions(*by, F.col("text").asc_nulls_first())

    def run(batches):
        enc, end = encoder(tokenizer_path), np.array([end_id], np.uint32)
        part, writer, docs, tokens = TaskContext.get().partitionId(), None, 0, 0
        final = f"{folder}/part-{part:08d}.ids.zst"
        draft = f"{folder}/_draft/{part:08d}-{uuid.uuid4().hex}"
        for b in batches:
            for s in byte_slices(b, 1, TEXT_BYTES):
                if writer is None:
                    sink = open_shared(draft, "wb")
                    writer = Writer(sink, 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4)
                for i, raw in zip(s.column(0).to_pylist(), enc.encode([t or "" for t in plain_strings(s.column(1)).to_pylist()]), strict=True):
                    ids = np.append(np.frombuffer(raw, np.uint32), end)
                    writer.add(i, ids)
                    docs, tokens = docs + 1, tokens + len(ids)
        enc.rest()
        if writer is not None:
            writer.close()
            sink.close()
            move_shared(draft, final)
            known = [x for x in writer.ids if x is not None]  # in order
            numbers = {"part": part, "n_docs": docs, "n_tokens": tokens, "least": known[0] if known else None, "greatest": known[-1] if known else None, "n_null": docs - len(known)}
            yield pa.RecordBatch.from_pydict({"file": [final], **{k: pa.array([v], pa.int64()) for k, v in numbers.items()}})

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/parts")
    parts = spark.read.schema(MANIFEST).parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    With ``doc_ids`` only the files that may hold those documents are opened, and only their frames are read.
    """
    small_batches(spark)
    wanted = set(doc_ids) if doc_ids is not None else None

    def run(batches):
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open_shared(file, "rb") as f:
                    r = Reader(f)
                    begin = start + np.concatenate(([0], np.cumsum(r.table[:-1, 1] // r.width)))
                    take = list(range(len(r))) if wanted is None else r.find(wanted)
                    for i in range(0, len(take), 250):
                        some = take[i : i + 250]
                        yield pa.RecordBatch.from_arrays([pa.array([r.ids[x] for x in some], pa.int64()), pa.array(begin[some]), pa.array([r.n_tokens(x) for x in some], pa.int64()), pa.array([r.frame(x) for x in some], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    if wanted is not None:
        ids = sorted(x for x in wanted if x is not None)
        asked = spark.createDataFrame([(x,) for x in ids], "id long")
        held = F.broadcast(asked)  # no more than the caller's list
        near = manifest.join(held, F.col("id").between(F.col("least"), F.col("greatest")), "left_semi")
        manifest = near.unionByName(manifest.filter("n_null > 0")).distinct() if None in wanted else near
    return one_each(manifest.select("file", "start")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
