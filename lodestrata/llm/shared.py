"""What several corpus operators use: the shared work folder, Arrow batch slicing and vectorised word hashing.

Work folder: tables and files that outlive a task are written below ``spark.checkpoint.dir``, which
every executor can reach. A lost executor therefore costs only the tasks that ran there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step takes at a time; a longer text is one step by itself.
STEP_BYTES = 1 << 20
#: Bytes of text whose keys are looked up together in a set of several blocks.
GROUP_BYTES = 32 << 20
#: Rows of an Arrow batch: bounds what one batch of long texts holds in a Python worker.
BATCH_ROWS = 1000


# ---- work folder -------------------------------------------------------------------------------


def work_root(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only in local mode with none set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


_scopes: list[list[str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder (not yet made) below the shared one."""
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[None]:
    """Drops the work folders begun within when it ends: for whoever has written an operator's result by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            for end in ("", "-sums"):
                drop_dir(spark, path + end)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Hadoop, wherever it lies."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows in this session, for texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def open_shared(uri: str, mode: str):
    """A file below the shared folder, on any file system Arrow knows; 'rb' is seekable."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    if mode == "rb":
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def move_shared(uri: str, to: str) -> None:
    """Publish a finished file under its final name; a repeated attempt replaces an equal file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.move(path, fs.FileSystem.from_uri(to)[1])


# ---- keys and columns --------------------------------------------------------------------------


def pass_through(df: DataFrame, keep: list[str] | None, added: T.StructType) -> list[str]:
    """The input columns that stay: those asked for (default all), less those that the result names."""
    names = {f.name.lower() for f in added}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in names]


def map_texts(df: DataFrame, text_col: str, keep: list[str] | None, added: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """Apply a per-batch function to a text column, keeping other columns.

    ``make`` runs once a task and gives ``f(texts: pa.StringArray) -> list[pa.Array]``, one array for
    each field of ``added``. Input columns that a result column names are replaced by it.
    """


    def grouped():
        f = make()
        return lambda slices: [f(s[0]) for s in slices]

    return map_groups(df, [df[text_col]], keep, added, grouped, 0)


def map_groups(df: DataFrame, texts: list[Column], keep: list[str] | None, added: T.StructType, make: Callable[[], Callable], most: int) -> DataFrame:
    """``map_texts`` for functions of several slices: ``f`` takes a list of slices (of each, the columns ``texts``, which
    are strings, the text last) of at most about ``most`` bytes of text, or one slice, and gives the result columns of each."""
    small_batches(df.sparkSession)
    kept, n = pass_through(df, keep, added), len(texts)
    schema = T.StructType([df.schema[c] for c in kept] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, names = make(), schema.names

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = f([[plain_strings(x) for x in part.columns[-n:]] for part in held]) if held else []
            for part, cols in zip(held, found, strict=True):
                yield pa.RecordBatch.from_arrays([*part.columns[:-n], *cols], names=names)

        held, size = [], 0
        for b in batches:
            for part in byte_slices(b, b.num_columns - 1):
                held.append(part)
                size += part.column(part.num_columns - 1).nbytes if most else 0
                if size >= most:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    return df.select(*[df[c] for c in kept], *[t.cast("string").alias(f"__text{i}") for i, t in enumerate(texts)]).mapInArrow(run, schema)


def one_each(files: DataFrame) -> DataFrame:
    """The rows of a short table, one a task."""
    return files.coalesce(1).repartition(max(1, files.count()))


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` (unique in ``key``), whatever share of the rows one key has.

    Keys of more than max(1000, total / 500,000) of the ``total`` rows are joined by broadcast: they can't be more than
    500,000. No task of the other join then gets more than so many rows of a key.
    """
    most = max(1000, total // 500_000)
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select(key).join(table, key)
    hot = materialise(hot, "hot-keys")
    often, rest = F.broadcast(hot), F.broadcast(hot.select(key))
    return rows.join(often, key).unionByName(rows.join(rest, key, "left_anti").join(table, key))


def plain_strings(a: pa.Array) -> pa.Array:
    """The column as 32-bit-offset strings."""
    return a if pa.types.is_string(a.type) else a.cast(pa.string())


def byte_slices(b: pa.RecordBatch, text_at: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text; one row at least."""
    n = b.num_rows
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text_at)), 0), dtype=np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield b.slice(at, to - at)
        at = to


def raw_bytes(a: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, row offsets into them), without a copy; null texts have no bytes."""
    if a.null_count:
        a = pc.fill_null(a, "")
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each row has."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


# ---- sets of keys too large to broadcast -------------------------------------------------------

#: Keys of a block: what a task holds of a set at a time (8 bytes each).
BLOCK_KEYS, HELD_BLOCKS = 2_000_000, 4
_blocks: dict[str, np.ndarray] = {}


def key_blocks(keys: DataFrame, name: str) -> list[str]:
    """Store a column of distinct 64-bit keys as files of at most about BLOCK_KEYS keys; their addresses."""
    from pyarrow import fs

    spark = keys.sparkSession
    folder = work_dir(spark, name)
    keys.toDF("k").write.parquet(f"{folder}/all")
    keys = spark.read.schema("k long").parquet(f"{folder}/all")
    n = max(1, -(-keys.count() // BLOCK_KEYS))
    (keys.coalesce(1) if n == 1 else keys.repartition(n, "k")).write.parquet(f"{folder}/blocks")
    drop_dir(spark, f"{folder}/all")
    store, path = fs.FileSystem.from_uri(f"{folder}/blocks")
    return [f"{folder}/blocks/{x.base_name}" for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet")]


def together(uris: list[str]) -> int:
    """Bytes of text whose keys should be looked up at once: a set of several blocks is read anew for each lookup."""
    return GROUP_BYTES if len(uris) > 1 else 0


def in_blocks(uris: list[str], h: np.ndarray) -> np.ndarray:
    """Which hashes are keys of the set. One block is held at a time; a set of one block is read once a process."""
    import pyarrow.parquet as pq

    found = np.zeros(len(h), bool)
    if not len(h):
        return found
    for uri in uris:
        if uri not in _blocks:
            while len(_blocks) >= HELD_BLOCKS:
                _blocks.pop(next(iter(_blocks)))
            with open_shared(uri, "rb") as f:
                _blocks[uri] = np.sort(pq.read_table(f)["k"].to_numpy().astype(np.int64).view(np.uint64))
        held = _blocks[uri]
        if len(held):
            at = np.minimum(np.searchsorted(held, h), len(held) - 1)
            found |= held[at] == h
    return found


# ---- words -------------------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def byte_table(word_bytes: np.ndarray) -> np.ndarray:
    """Byte -> lower-cased byte inside words, 0 outside. All multi-byte UTF-8 is above 0x7F."""
    t = _FOLD.copy()
    t[~word_bytes] = 0
    return t


_b = np.arange(256)
#: Words of letters and digits: everything but ASCII punctuation, space and controls.
ALNUM = byte_table((_b >= 0x80) | ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x41) & (_b <= 0x5A)) | ((_b >= 0x61) & (_b <= 0x7A)))
#: Words between white space: space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = (_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D))
NONSPACE = byte_table(~_SPACE)
NONSPACE[0] = 0x20  # NUL is a word character here; no word holds a space
#: The same words without lower-casing.
CASED = np.where(_SPACE, 0, _b).astype(np.uint8)
CASED[0] = 0x20

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + (STEP_BYTES >> 2))
        with np.errstate(over="ignore"):
            for k, r in enumerate((_R, _RINV)):
                p = np.full(size, r, np.uint64)
                p[0] = 1
                _powers[k] = np.cumprod(p)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (all bits depend on all bits)."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


class Words:
    """The words of a slice of texts: 64-bit hash, byte span, and word range of each row."""

    def __init__(self, a: pa.StringArray, table: np.ndarray) -> None:
        self.data, self.offsets = raw_bytes(a)
        low = self.low = table[self.data]
        n = len(low)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = low != 0
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        begins[edge] |= inside[1:-1][edge]
        ends[edge - 1] |= inside[1:-1][edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.bounds)
        p, pinv = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(low * p[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * pinv[self.start])

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words that begin at each word; whether they lie in one row)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = self.hash[:n].copy()
        for t in range(1, k):
            h *= _M1
            h += self.hash[t : t + n]
            h ^= h >> np.uint64(29)
        fits = np.arange(n) + k <= np.repeat(self.bounds[1:], self.count)[:n]
        return mix(h), fits

    def words(self, i: int, j: int) -> bytes:
        """Words i to j, lower-cased, joined by one space."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
