"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark text is cut into windows of ``size`` consecutive words; a text with fewer words, but not
none, is one window. A window is a set of word shingles. To contain a window whole, a document must
contain every shingle of it, so one necessary prefix token is enough to find candidates: the shingle
that is rarest in the corpus. Candidates pass a length bound (the window fits in the document's words)
and a positional bound (the shingle's place in the window fixes where it would begin and end), and
are then verified word by word.

How many documents hold each shingle of the benchmark is counted in one pass over the documents: tasks pick out the
words that pass a bitmap of the benchmark's shingles, and only those are shuffled and joined. The index of windows is
built in blocks of at most ``block_windows`` windows, kept as files in the shared folder and read by each task,
one block at a time, and where there are several, once for ``GROUP_BYTES`` of text: neither the driver nor a task holds
more than a block, however large the benchmark is. Documents are never shuffled.

Defined results: a null or empty text has no words and no hits. A null benchmark text, or one without
words, gives no window; equal windows of several items count for each of them; a null item id is
written "null". An empty benchmark hits nothing. Repeated rows get equal results, row by row. Input
columns named like a result column are replaced.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ALNUM, Words, byte_slices, drop_dir, map_groups, map_texts, open_shared, plain_strings, small_batches, together, work_dir

#: Words of a shingle of a window, windows of an index block, and bits of a place in the bitmap of shingles (16 MB).
SHINGLE, BLOCK_WINDOWS, BITMAP = 3, 200_000, 27

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def benchmark_windows(benchmark: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item): the distinct windows of each item, words lower-cased and joined by a space."""
    added = T.StructType([T.StructField("windows", T.ArrayType(T.StringType()))])

    def make():
        def f(texts: pa.StringArray) -> list[pa.Array]:
            w, out = Words(texts, ALNUM), []
            for i, j in zip(w.bounds, w.bounds[1:], strict=False):
                n = int(j - i)
                out.append(sorted({w.words(s, min(s + size, j)).decode() for s in range(i, i + max(1, n - size + 1))}) if n else [])
            return [pa.array(out, pa.list_(pa.string()))]

        return f

    renamed = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return map_texts(renamed, "text", ["item"], added, make).select(F.explode("windows").alias("window"), "item").distinct()


class Block:
    """Distinct windows, their items, and the prefix token by which each is found."""

    def __init__(self, windows: list[str], items: list[list[str]]) -> None:
        self.text, self.items = [x.encode() for x in windows], items
        w = Words(pa.array(windows, pa.string()), ALNUM)
        self.length, self.first, self.hash = w.count.astype(np.int64), w.bounds[:-1].astype(np.int64), w.hash
        parts = []
        for k in range(1, SHINGLE + 1):
            h, fits = w.shingles(k)
            row = w.rows()[: len(h)]
            at = np.flatnonzero(fits & (np.minimum(self.length[row], SHINGLE) == k))
            parts.append((np.full(len(at), k), h[at], row[at], at - w.bounds[row[at]]))
        self.kind, self.token, self.owner, self.place = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.tokens = {k: np.unique(self.token[self.kind == k]) for k in range(1, SHINGLE + 1)}

    def order(self, frequency: dict[int, dict[int, int]]) -> None:
        """Choose for each window its rarest shingle; ties go to the smaller hash, then the earlier place."""
        seen = np.array([frequency[int(k)].get(int(t), 0) for k, t in zip(self.kind, self.token, strict=True)], np.int64)
        by = np.lexsort((self.place, self.token, seen, self.owner))
        chosen = by[np.unique(self.owner[by], return_index=True)[1]]
        self.prefix = {}
        for k in range(1, SHINGLE + 1):
            c = chosen[self.kind[chosen] == k]
            c = c[np.argsort(self.token[c], kind="stable")]
            token, start = np.unique(self.token[c], return_index=True)
            self.prefix[k] = (token, np.append(start, len(c)), self.owner[c], self.place[c])


def member(sorted_tokens: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in h whose value is in sorted_tokens, where there); a bitmap of 2^18 bins goes first."""
    none = np.zeros(0, np.int64)
    if not len(sorted_tokens) or not len(h):
        return none, none
    bins = np.zeros(1 << 18, bool)
    bins[(sorted_tokens >> np.uint64(46)).astype(np.int64)] = True
    maybe = np.flatnonzero(bins[(h >> np.uint64(46)).astype(np.int64)])
    at = np.minimum(np.searchsorted(sorted_tokens, h[maybe]), len(sorted_tokens) - 1)
    ok = sorted_tokens[at] == h[maybe]
    return maybe[ok], at[ok]


def occurrences(w: Words, block: Block, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of the block's windows."""
    starts, found = [], []
    for k, (token, first, owner, place) in block.prefix.items():
        if not len(token):
            continue
        h, fits = w.shingles(k)
        at, hit = member(token, h)
        at, hit = at[fits[at]], hit[fits[at]]
        n = first[hit + 1] - first[hit]
        pos = np.repeat(at, n)
        c = np.repeat(first[hit] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n) + np.arange(int(n.sum()))
        win, begin = owner[c], pos - place[c]
        size = block.length[win]
        ok = (size <= w.count[row[pos]]) & (begin >= w.bounds[row[pos]]) & (begin + size <= w.bounds[row[pos] + 1])
        begin, win, size = begin[ok], win[ok], size[ok]
        for t in range(int(size.max()) if len(size) else 0):
            inside = np.minimum(t, size - 1)
            ok = w.hash[begin + inside] == block.hash[block.first[win] + inside]
            begin, win, size = begin[ok], win[ok], size[ok]
        exact = np.fromiter((w.words(b, b + s) == block.text[x] for b, s, x in zip(begin, size, win, strict=True)), bool, len(begin))
        starts.append(begin[exact])
        found.append(win[exact])
    return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def save(uri: str, block: Block) -> None:
    import pickle

    with open_shared(uri, "wb") as f:
        f.write(pickle.dumps(block, protocol=5))


def load(uri: str) -> Block:
    import pickle

    with open_shared(uri, "rb") as f:
        return pickle.load(io.BytesIO(f.read()))


def bitmap(tokens: np.ndarray, into: np.ndarray) -> None:
    at = (tokens >> np.uint64(64 - BITMAP)).astype(np.int64)
    np.bitwise_or.at(into, at >> 3, (1 << (at & 7)).astype(np.uint8))


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that pass the bitmap."""
    at = (h >> np.uint64(64 - BITMAP)).astype(np.int64)
    return np.flatnonzero(bits[at >> 3] & (1 << (at & 7)).astype(np.uint8))


def frequencies(documents: DataFrame, text_col: str, uri: str) -> DataFrame:
    """(k, token, n): in how many documents each shingle of k words occurs, of those that pass the bitmap."""

    def run(batches):
        with open_shared(uri, "rb") as f:
            bits = np.frombuffer(f.read(), np.uint8)
        for b in batches:
            for part in byte_slices(b, 0):
                w = Words(plain_strings(part.column(0)), ALNUM)
                row = w.rows()
                for k in range(1, SHINGLE + 1):
                    h, fits = w.shingles(k)
                    at = may_hold(bits, h + np.uint64(k))
                    at = at[fits[at]]
                    if len(at):
                        pair = np.unique(np.stack([row[at].astype(np.uint64), h[at]], 1), axis=0)
                        token, n = np.unique(pair[:, 1], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), k, np.int32)), pa.array(token.view(np.int64)), pa.array(n)], names=["k", "token", "n"])

    return documents.select(F.col(text_col).cast("string")).mapInArrow(run, "k int, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, size: int = 10, item_id_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Kept columns of ``documents`` and: n_words, n_hit (words inside an occurrence of a window), items (sorted), spans (runs of hit words, end exclusive), contaminated."""
    spark = documents.sparkSession
    small_batches(spark)
    folder = work_dir(spark, "benchmark-index")
    windows = benchmark_windows(benchmark, size, item_id_col, item_text_col)
    windows.write.parquet(f"{folder}/windows")
    windows = spark.read.parquet(f"{folder}/windows")
    n = windows.select("window").distinct().count()
    blocks = -(-n // block_windows)
    uris = []
    bits = np.zeros(1 << (BITMAP - 3), np.uint8)
    for i in range(blocks):
        mine = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).orderBy("window").collect()
        if not mine:
            continue
        block = Block([r.window for r in mine], [list(r["items"]) for r in mine])
        for k, tokens in block.tokens.items():
            bitmap(tokens + np.uint64(k), bits)
        save(uri := f"{folder}/block-{i}.bin", block)
        uris.append(uri)
    if uris:
        with open_shared(f"{folder}/bitmap.bin", "wb") as f:
            f.write(bits.tobytes())
        known = frequencies(documents, text_col, f"{folder}/bitmap.bin")
        known.write.parquet(f"{folder}/frequencies")
        known = spark.read.schema(known.schema).parquet(f"{folder}/frequencies")
    for uri in uris:
        block = load(uri)
        mine = spark.createDataFrame(pd.DataFrame({"k": np.concatenate([np.full(len(t), k, np.int32) for k, t in block.tokens.items()]), "token": np.concatenate(list(block.tokens.values())).view(np.int64)}))
        counts: dict[int, dict[int, int]] = {k: {} for k in block.tokens}
        for r in known.join(F.broadcast(mine), ["k", "token"]).collect():  # a block's shingles at most
            counts[r.k][r.token & 0xFFFFFFFFFFFFFFFF] = r.n
        block.order(counts)
        save(uri, block)
    drop_dir(spark, f"{folder}/windows")

    def make():
        held: dict[str, Block] = {}

        def get(uri: str) -> Block:
            if uri not in held:
                held.clear()
                held[uri] = load(uri)
            return held[uri]

        def f(slices: list[list[pa.Array]]) -> list[list[pa.Array]]:
            cover: list[np.ndarray | None] = [None] * len(slices)
            items: list[dict[int, set[str]]] = [{} for _ in slices]
            held = Words(slices[0][0], ALNUM) if len(slices) == 1 else None
            for uri in uris:  # a block serves all slices before the next is read
                block = get(uri)
                for i, (texts,) in enumerate(slices):
                    w = held or Words(texts, ALNUM)
                    if cover[i] is None:
                        cover[i] = np.zeros(len(w.hash) + 1, np.int32)
                    row = w.rows()
                    begin, win = occurrences(w, block, row)
                    np.add.at(cover[i], begin, 1)
                    np.add.at(cover[i], begin + block.length[win], -1)
                    for r, x in np.unique(np.stack([row[begin], win], 1), axis=0) if len(begin) else ():
                        items[i].setdefault(int(r), set()).update(block.items[x])
            return [result(held or Words(texts, ALNUM), c, found) for (texts,), c, found in zip(slices, cover, items, strict=True)]

        def result(w: Words, cover: np.ndarray | None, items: dict[int, set[str]]) -> list[pa.Array]:
            hit = np.cumsum(cover[:-1]) > 0 if cover is not None else np.zeros(len(w.hash), bool)
            sums = np.concatenate(([0], np.cumsum(hit)))
            n_hit = sums[w.bounds[1:]] - sums[w.bounds[:-1]]
            spans = []
            for r in range(len(w.count)):
                if not n_hit[r]:
                    spans.append([])
                    continue
                edge = np.diff(np.concatenate(([0], hit[w.bounds[r] : w.bounds[r + 1]].astype(np.int8), [0])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            return [
                pa.array(w.count.astype(np.int64)),
                pa.array(n_hit.astype(np.int64)),
                pa.array([sorted(items.get(r, ())) for r in range(len(w.count))], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(n_hit > 0),
            ]

        return f

    return map_groups(documents, [documents[text_col]], keep, RESULT, make, together(uris))
