"""MinHash near-duplicates with sequential Bayesian verification.

1. A text's set is its distinct word shingles (64-bit hashes). Texts with equal sets are one node, so
   that copies cost one row, however many there are. A node has a signature of ``bands * rows``
   MinHash values, of which 8 bits each are kept.
2. Nodes that agree in all rows of a band share a bucket. A pair at the threshold shares none with
   probability (1 - t^rows)^bands: 2.8e-6 for t = 0.8, 42 bands of 6 rows.
3. Pairs are compared a batch of signature values at a time. After each batch the posterior
   probability that their similarity reaches the threshold follows from the matches so far (uniform
   prior, 8-bit collisions included); a pair below the chosen miss probability is dropped.
4. Survivors are verified exactly on the full sets of the two texts, and only verified links count.

A bucket may hold a third of all rows, so its pairs are never all made. Each member is paired with the
bucket's hub, the member that shares most buckets with most nodes: where texts vary one original, that is
the original. Members already connected need no further comparison, and buckets that still span
several components of the links found so far go through ``STARS`` such rounds. For what then is still
apart, members of the largest component in the bucket are dealt into blocks of ``BLOCK`` by hash and
compared in blocks with the members outside it; no pair that could join two components is left out.

Defined results: a null or empty text, or one without words, has an empty set and links with
nothing. A text with fewer words than a shingle has one shingle, the whole sequence. Rows of equal id
share the component; a null id comes after all others, and a component of null ids alone has a null
component_id. Repeated rows are one node; ``first`` marks exactly one row of each component. An empty
table gives no rows. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import NONSPACE, Words, byte_slices, join_hot, pass_through, plain_strings, small_batches, work_dir

BANDS, ROWS = 42, 6
#: Signature values of a comparison step, the miss probability of pruning, and rows of a block.
STEP, MISS, BLOCK = 28, 1e-6, 512
#: Rounds of pairing with hubs before the blocks.
STARS = 2

RESULT = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("component_id", T.LongType()), T.StructField("kept", T.BooleanType()), T.StructField("first", T.BooleanType())])


def row_sets(w: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    whole = {s: w.shingles(s)[0] for s in {k, *np.unique(w.count[(w.count > 0) & (w.count < k)]).tolist()}}
    none = np.zeros(0, np.uint64)
    out = []
    for i, n in zip(w.bounds.tolist(), w.count.tolist(), strict=False):
        if not n:
            out.append(none)
            continue
        h = np.sort(whole[min(n, k)][i : i + max(1, n - k + 1)])
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
    return out


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 32, count, np.uint32), r.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """count 8-bit MinHash values of each set (none may be empty)."""
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), count), np.uint8)
    for k, (c, a) in enumerate(zip(*seeds(count), strict=True)):
        low = np.minimum.reduceat((x ^ c) * a, at)
        low *= np.uint32(0x9E3779B1)
        out[:, k] = low >> np.uint32(24)
    return out


def bounds(threshold: float, count: int, step: int = STEP, miss: float = MISS) -> list[tuple[int, int]]:
    """[(values compared, fewest matches that stay)]: below, P(similarity >= threshold | matches) < miss."""
    s = np.linspace(0, 1, 4001)
    c = np.clip(s + (1 - s) / 256, 1e-12, 1 - 1e-12)
    high, out = s >= threshold - 1e-9, []
    for n in [*range(step, count, step), count]:
        for m in range(n + 1):
            ll = m * np.log(c) + (n - m) * np.log1p(-c)
            p = np.exp(ll - ll.max())
            if p[high].sum() >= miss * p.sum():
                break
        out.append((n, m))
    return out


def survive(a: np.ndarray, b: np.ndarray, stops: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs of signatures (rows of a and b) that no step prunes."""
    live, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in stops:
        matches = matches + (a[live, done:n] == b[live, done:n]).sum(axis=1)
        ok = matches >= least
        live, matches, done = live[ok], matches[ok], n
        if not len(live):
            break
    return live


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold: 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(both) - inter)


def by_cell(f):
    """A mapInArrow function that gives f each run of rows with equal first three columns, as a table, over batch borders."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(final: bool):
            t = pa.Table.from_batches(held)
            key = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            whole = len(cut) - 1 if final else len(cut) - 2
            for i in range(whole):
                yield from f(tuple(key[cut[i]].tolist()), t.slice(cut[i], cut[i + 1] - cut[i]))
            held[:] = [] if final else t.slice(cut[whole]).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def features(documents: DataFrame, *, id_col: str, text_col: str, keep: list[str], shingle: int, count: int) -> DataFrame:
    """Kept columns and __id, __text, __row (a number for each row), n_shingles, __node (of equal sets), __sig."""
    small_batches(documents.sparkSession)
    added = [T.StructField("n_shingles", T.LongType()), T.StructField("__row", T.LongType()), T.StructField("__node", T.BinaryType()), T.StructField("__sig", T.BinaryType())]
    schema = T.StructType([*[documents.schema[c] for c in keep], T.StructField("__id", T.LongType()), T.StructField("__text", T.StringType()), *added])

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for s in byte_slices(b, b.num_columns - 1):
                sets = row_sets(Words(plain_strings(s.column(s.num_columns - 1)), NONSPACE), shingle)
                some = [i for i, x in enumerate(sets) if len(x)]
                node, sig = [None] * len(sets), [None] * len(sets)
                if some:
                    for i, row in zip(some, signatures([sets[i] for i in some], count), strict=True):
                        node[i], sig[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), row.tobytes()
                n = pa.array([len(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*s.columns, n, pa.array(np.arange(number, number + len(sets))), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=schema.names)
                number += len(sets)

    return documents.select(*[documents[c] for c in keep], documents[id_col].cast("long").alias("__id"), documents[text_col].cast("string").alias("__text")).mapInArrow(run, schema)


def _sig(column: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, count)


class Search:
    """The tables of one run, in a folder of the shared store."""

    def __init__(self, rows: DataFrame, folder: str, shingle: int, percent: int, bands: int, band_rows: int) -> None:
        self.spark, self.folder, self.shingle, self.percent = rows.sparkSession, folder, shingle, percent
        self.bands, self.band_rows, self.count = bands, band_rows, bands * band_rows
        self.stops = bounds(percent / 100, self.count)
        self.rows = self.put(rows, "rows", small=False)
        first = F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__row").alias("row"))
        nodes = self.rows.filter("__node is not null").groupBy("__node").agg(F.min(first).alias("rep"), F.first("__sig").alias("sig"))
        self.nodes = self.put(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes", small=False)
        # the band's number in the low 6 bits
        key = lambda i: F.xxhash64(F.substring("sig", i * band_rows + 1, band_rows)).bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(i))
        every = self.nodes.select("nid", F.explode(F.array(*[key(i) for i in range(bands)])).alias("bucket"))
        shared = every.groupBy("bucket").agg(F.min("nid").alias("low"), F.max("nid").alias("high")).filter("low < high").select("bucket")
        members = self.put(every.join(shared, "bucket"), "shared")
        self.members = members.withColumn("label", F.col("nid"))

    def hubs(self, members: DataFrame) -> DataFrame:
        """(bucket, pivot, its label): the member that shares most buckets with most nodes, so the text that others vary."""
        sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
        weight = members.join(sizes, "bucket").groupBy("nid").agg(F.sum("n").alias("w"))
        best = members.join(weight, "nid").groupBy("bucket").agg(F.max(F.struct("w", "nid", "label")).alias("p"))
        return best.select("bucket", F.col("p.nid").alias("pivot"), F.col("p.label").alias("pivot_label"))

    def star(self, members: DataFrame) -> DataFrame:
        """Each member of a bucket with the bucket's hub, where their labels differ."""
        pairs = members.join(self.hubs(members), "bucket").filter("label != pivot_label")
        return pairs.select(F.least("nid", "pivot").alias("a"), F.greatest("nid", "pivot").alias("b")).distinct()

    def put(self, df: DataFrame, name: str, small: bool = True) -> DataFrame:
        """Write a table and read it back; a small one first into as few files as its size asks for."""
        (df.hint("rebalance") if small else df).write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def prune(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) that the Bayesian comparison leaves."""
        count, stops = self.count, self.stops

        def run(batches):
            for b in batches:
                if b.num_rows:
                    live = pa.array(survive(_sig(b.column(2), count), _sig(b.column(3), count), stops))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(live), b.column(1).take(live)], names=["a", "b"])

        sig = self.nodes.select("nid", "sig")
        with_sigs = pairs.join(sig.withColumnsRenamed({"nid": "b", "sig": "sb"}), "b").join(sig.withColumnsRenamed({"nid": "a", "sig": "sa"}), "a").select("a", "b", "sa", "sb")
        return self.put(with_sigs.mapInArrow(run, "a long, b long"), name)

    def texts(self, nids: DataFrame, name: str) -> DataFrame:
        """(nid, text) of the nodes asked for: of each node, one of the texts that have its set."""
        reps = self.nodes.join(nids.distinct(), "nid").select("nid", F.col("rep.row").alias("__row"))
        return self.put(self.rows.select("__row", "__text").join(reps, "__row").select("nid", F.col("__text").alias("text")), f"{name}-texts", small=False)

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full sets reach the threshold."""
        shingle, percent = self.shingle, self.percent

        def run(batches):
            for b in batches:
                for s in byte_slices(b, 2, 1 << 19):
                    one = row_sets(Words(plain_strings(s.column(2)), NONSPACE), shingle)
                    texts, back = np.unique(np.array(s.column(3).to_pylist(), object), return_inverse=True)
                    two = row_sets(Words(pa.array(texts.tolist(), pa.string()), NONSPACE), shingle)
                    at = pa.array([i for i, x in enumerate(one) if alike(x, two[back[i]], percent)], pa.int64())
                    yield pa.RecordBatch.from_arrays([s.column(0).take(at), s.column(1).take(at)], names=["a", "b"])

        texts = self.texts(pairs.select(F.explode(F.array("a", "b")).alias("nid")), name)
        both = pairs.join(texts.withColumnsRenamed({"nid": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"nid": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")
        return self.put(both.mapInArrow(run, "a long, b long"), name)

    def labelled(self, links: DataFrame, members: DataFrame, name: str) -> DataFrame:
        """Members of the buckets that still span several components, with their label."""
        labels = components(links).select(F.col("node").alias("nid"), "label")
        now = members.drop("label").join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
        now = self.put(now, f"{name}-all")
        apart = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("bucket")
        return self.put(now.join(apart, "bucket"), name)

    def blocks(self, members: DataFrame) -> DataFrame:
        """Links across labels within a bucket, found cell by cell: first by signature, then on full sets."""
        count, stops, bands, band_rows, shingle, percent = self.count, self.stops, self.bands, self.band_rows, self.shingle, self.percent
        sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"))
        main = main.select("bucket", F.col("main.label").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("gm"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("go"))
        m = members.join(main, "bucket").join(self.nodes.select("nid", "sig"), "nid")
        m = m.withColumn("is_main", F.col("label") == F.col("main")).withColumn("own", F.pmod(F.xxhash64("nid"), F.when(F.col("is_main"), F.col("gm")).otherwise(F.col("go"))).cast("int"))
        cell = lambda n, i, j: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(i(k).cast("int").alias("i"), j(k).cast("int").alias("j")))
        own = F.col("own")
        inside = cell(F.col("go"), lambda k: own, lambda k: k)
        across = cell(F.col("gm"), lambda k: k, lambda k: own)
        others = cell(F.col("go"), lambda k: -1 - F.least(own, k), lambda k: F.greatest(own, k))
        cells = m.select("bucket", F.explode(F.when(F.col("is_main"), inside).otherwise(F.concat(across, others))).alias("at"), "nid", "label", "sig")
        by = ["bucket", "i", "j"]
        cells = cells.select("bucket", "at.i", "at.j", "nid", "label", "sig").repartition(*by).sortWithinPartitions(*by)

        def compare(key: tuple, t: pa.Table):
            """(cell, node, partners with a greater place) of the nodes of a cell that are in a pair which pruning leaves."""
            nid, label, sig = t.column(3).to_numpy(), t.column(4).to_numpy(), _sig(t.column(5), count)
            partners: dict[int, list[int]] = {}

            for x in range(len(nid) - 1):
                y = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
                if len(y):
                    ok = y[survive(np.broadcast_to(sig[x], (len(y), count)), sig[y], stops)]
                    if len(ok):  # a pair is told of in the first band that it shares only
                        same = (sig[ok] == sig[x]).reshape(len(ok), bands, band_rows).all(axis=2)
                        ok = ok[same.argmax(axis=1) == int(key[0]) & 63]
                    if len(ok):
                        partners.setdefault(x, []).extend(nid[ok].tolist())
                        for i in ok.tolist():
                            partners.setdefault(i, [])
            if partners:
                n = len(partners)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int32()), pa.array([key[2]] * n, pa.int32()), pa.array(nid[list(partners)]), pa.array(list(partners.values()), pa.list_(pa.int64()))], names=[*by, "nid", "partners"])

        def confirm(key: tuple, t: pa.Table):
            nid, partners = t.column(3).to_pylist(), t.column(4).to_pylist()
            sets = dict(zip(nid, row_sets(Words(plain_strings(t.column(5).combine_chunks()), NONSPACE), shingle), strict=True))
            found = [(min(x, y), max(x, y)) for x, ys in zip(nid, partners, strict=True) for y in ys if alike(sets[x], sets[y], percent)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        left = self.put(cells.mapInArrow(by_cell(compare), "bucket long, i int, j int, nid long, partners array<long>"), "cells")
        texts = self.texts(left.select("nid"), "cells")
        whole = left.join(texts, "nid").select(*by, "nid", "partners", "text").repartition(*by).sortWithinPartitions(*by)
        return self.put(whole.mapInArrow(by_cell(confirm), "a long, b long").distinct(), "links-cells")

    def run(self) -> DataFrame:
        """(nid, label) of every linked node."""
        found = done = None
        rest = self.members
        for step in range(STARS):
            pairs = self.star(rest)
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = self.put(pairs, f"pairs-{step}")
            links = self.verify(self.prune(pairs, f"left-{step}"), f"links-{step}")
            found = links if found is None else found.unionByName(links)
            done = pairs if done is None else done.unionByName(pairs)
            rest = self.labelled(found, rest, f"apart-{step}")
        return components(found.unionByName(self.blocks(rest)))


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, shingle: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """Kept columns and n_shingles, component_id (smallest id linked by a chain of texts with 100 * intersection >= percent * union), kept (the id is component_id), first (one row of each component)."""
    kept = pass_through(documents, keep, RESULT)
    rows = features(documents, id_col=id_col, text_col=text_col, keep=kept, shingle=shingle, count=bands * band_rows)
    s = Search(rows, work_dir(documents.sparkSession, "neardup"), shingle, percent, bands, band_rows)
    labels = s.put(s.run(), "labels")
    nodes = s.nodes.select("__node", "nid", "rep").join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    reps = nodes.groupBy("label").agg(F.min("rep").alias("rep"))
    of_node = s.put(join_hot(nodes.select("__node", "label"), reps, "label", s.nodes.count()).select("__node", F.col("rep.id").alias("__cid"), F.col("rep.row").alias("__crow")), "result")
    out = s.rows.join(of_node, "__node", "left")
    alone = F.col("__node").isNull()
    cid = F.when(alone, F.col("__id")).otherwise(F.col("__cid"))
    return out.select(*kept, "n_shingles", cid.alias("component_id"), F.coalesce(F.col("__id") == cid, F.lit(False)).alias("kept"), (alone | (F.col("__row") == F.col("__crow"))).alias("first"))
