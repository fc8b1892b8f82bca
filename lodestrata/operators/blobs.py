"""A blob catalogue: metadata, chunks, tags, namespaces and time index as tables.

Blobs are stored in batches. A sequence number orders them; content is known by its SHA-256, and with dedup on,
a blob of at least ``dedup_min`` bytes whose content is already there owns no chunks but names the
blob that does (the smallest sequence of that content). Limits are those of the data model: labels
63 bytes, tags 32 bytes and 8 a blob, namespaces 63 bytes, chunks 64 KiB, cut at bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, DEDUP_MIN, LABEL, TAG, TAGS, NAMESPACE, CONTEXT = 65536, 4096, 63, 32, 8, 63, 62
#: Content types and relations by code; unknown codes become the first and "derived".
CONTENT_TYPES = ("application/octet-stream", "image/png", "image/jpeg", "audio/wav", "audio/ogg", "video/mp4", "application/vnd.las", "application/x-imu", "application/x-embedding", "application/json")
RELATIONS = ("derived", "similar", "contradicts", "supports", "supersedes")


class BlobRangeOutOfBounds(ValueError):
    pass


@dataclass(frozen=True)
class Store:
    meta: DataFrame  # seq, label, content_type, length, sha256, owner, wall_ns, hlc, parent
    chunks: DataFrame  # seq, idx, data
    tags: DataFrame  # seq, tag
    namespaces: DataFrame  # seq, namespace


def cut(c: Column, most: int) -> Column:
    """Text held to a number of bytes; a character that the limit would cut in two is dropped."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: F.octet_length(F.left(c, k)) <= most)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.left(c, F.array_max(fits)))


def content_type(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in CONTENT_TYPES]), code), F.lit(CONTENT_TYPES[0]))


def relation(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in RELATIONS]), code), F.lit(RELATIONS[0]))


def ingest(rows: DataFrame, *, seq: str, data: str, label: str | None = None, ctype: Column | None = None, wall_ns: Column | None = None, parent: Column | None = None, namespace: Column | None = None, tags: Column | None = None, dedup: bool = False, dedup_min: int = DEDUP_MIN, chunk: int = CHUNK) -> Store:
    """Store a batch; ``tags`` is an array column. Extra tags beyond eight are dropped, in order."""
    raw = F.coalesce(F.col(data).cast("binary"), F.lit(b""))
    base = rows.select(
        F.col(seq).cast("long").alias("seq"),
        (cut(F.col(label), LABEL) if label else F.lit("")).alias("label"),
        (ctype if ctype is not None else F.lit(CONTENT_TYPES[0])).alias("content_type"),
        F.octet_length(raw).cast("long").alias("length"),
        F.sha2(raw, 256).alias("sha256"),
        (wall_ns if wall_ns is not None else F.lit(0)).cast("long").alias("wall_ns"),
        (parent if parent is not None else F.lit(None)).cast("long").alias("parent"),
        raw.alias("data"),
        (namespace if namespace is not None else F.lit(None)).cast("string").alias("namespace"),
        (F.slice(F.array_distinct(F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: cut(t, TAG))), 1, TAGS) if tags is not None else F.array().cast("array<string>")).alias("tags"),
    )
    light = base.drop("data", "namespace", "tags")
    if dedup:
        owners = light.filter(F.col("length") >= dedup_min).groupBy("sha256").agg(F.min("seq").alias("owner"))
        meta = light.join(owners, "sha256", "left").withColumn("owner", F.when(F.col("length") >= dedup_min, F.col("owner")).otherwise(F.col("seq")))
    else:
        meta = light.withColumn("owner", F.col("seq"))
    owned = base if not dedup else base.join(meta.filter("seq = owner").select("seq"), "seq", "left_semi")
    n = F.ceil(F.col("length") / chunk).cast("int")
    chunks = owned.filter("length > 0").select("seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"), "data").select("seq", "idx", F.substring("data", F.col("idx") * chunk + 1, F.lit(chunk)).alias("data"))
    return Store(meta, chunks, base.select("seq", F.explode("tags").alias("tag")), base.filter("namespace is not null").select("seq", cut(F.col("namespace"), NAMESPACE).alias("namespace")))


class SequenceTaken(ValueError):
    pass


def append(store: Store, rows: DataFrame, *, dedup: bool = False, dedup_min: int = DEDUP_MIN, **columns) -> Store:
    """The store with another batch (``columns`` as for ``ingest``). With dedup, content that the store has already
    is owned by the blob that owns it there. A sequence number that the store has is refused."""
    new = ingest(rows, dedup=dedup, dedup_min=dedup_min, **columns)
    taken = new.meta.join(store.meta.select("seq"), "seq", "left_semi").select("seq").take(1)
    if taken:
        raise SequenceTaken(taken[0].seq)
    meta, chunks = new.meta, new.chunks
    if dedup:
        there = store.meta.filter(F.col("length") >= dedup_min).groupBy("sha256").agg(F.min("owner").alias("__there"))
        meta = meta.join(there, "sha256", "left").withColumn("owner", F.when(F.col("length") >= dedup_min, F.coalesce("__there", "owner")).otherwise(F.col("owner"))).drop("__there")
        chunks = chunks.join(meta.filter("seq = owner").select("seq"), "seq", "left_semi")
    both = lambda a, b: a.unionByName(b.select(*a.columns))
    return Store(both(store.meta, meta), both(store.chunks, chunks), both(store.tags, new.tags), both(store.namespaces, new.namespaces))


def namespace_of(store: Store, seq: int) -> DataFrame:
    return store.namespaces.filter(F.col("seq") == seq).select("namespace")


def read(store: Store, seqs: DataFrame | None = None) -> DataFrame:
    """(seq, data, intact): chunks joined in order; intact says that length and SHA-256 agree."""
    meta = store.meta if seqs is None else store.meta.join(seqs.select("seq").distinct(), "seq", "left_semi")
    parts = meta.select("seq", "owner", "length", "sha256").join(store.chunks.select(F.col("seq").alias("owner"), "idx", "data"), "owner", "left")
    whole = F.coalesce(F.expr("listagg(data) WITHIN GROUP (ORDER BY idx)"), F.lit(b""))
    out = parts.groupBy("seq", "length", "sha256").agg(whole.alias("data"))
    return out.select("seq", "data", ((F.octet_length("data") == F.col("length")) & (F.sha2("data", 256) == F.col("sha256"))).alias("intact"))


def read_range(store: Store, seq: int, offset: int, length: int, *, chunk: int = CHUNK, clip: bool = False) -> DataFrame:
    """(seq, data): bytes [offset, offset + length) of one blob; only the chunks concerned are read.

    A range that ends after the blob, or a blob that isn't there, is refused; with ``clip`` it gives the bytes
    that there are, or no row.
    """
    found = store.meta.filter(F.col("seq") == seq).select("owner", "length").take(1)
    spark = store.meta.sparkSession
    if not found:
        if clip:
            return spark.createDataFrame([], "seq long, data binary")
        raise KeyError(seq)
    if clip and offset >= 0:
        length = min(length, max(0, found[0]["length"] - offset))
    if offset < 0 or length < 0 or not clip and offset + length > found[0]["length"]:
        raise BlobRangeOutOfBounds(f"{offset} + {length} of {found[0]['length']}")
    if not length:
        return spark.createDataFrame([(seq, bytearray())], "seq long, data binary")
    a, b = offset // chunk, (offset + length - 1) // chunk
    some = store.chunks.filter((F.col("seq") == found[0]["owner"]) & F.col("idx").between(a, b))
    return some.agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY idx)").alias("d")).select(F.lit(seq).cast("long").alias("seq"), F.substring("d", offset - a * chunk + 1, length).alias("data"))


def by_sequence(store: Store, seqs: DataFrame) -> DataFrame:
    return store.meta.join(seqs.select("seq").distinct(), "seq")


def stats(store: Store) -> DataFrame:
    """Blobs, and the bytes of those that own their chunks."""
    own = F.col("seq") == F.col("owner")
    live = F.coalesce(F.sum(F.when(own, F.col("length"))), F.lit(0))
    return store.meta.agg(F.count("*").alias("blob_count"), live.alias("live_bytes"), F.lit(0).cast("long").alias("dead_bytes"), F.lit(0.0).alias("fragmentation"))


def dedup_stats(store: Store, dedup_min: int = DEDUP_MIN) -> DataFrame:
    """Contents, references to them, and bytes saved."""
    per = store.meta.filter(F.col("length") >= dedup_min).groupBy("sha256").agg(F.count("*").alias("refs"), F.max("length").alias("length"))
    saved = F.coalesce(F.sum(F.when(F.col("refs") > 1, F.col("length") * (F.col("refs") - 1))), F.lit(0))
    return per.agg(F.count("*").alias("entries"), F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"), saved.alias("bytes_saved"))


# ---- filters -----------------------------------------------------------------------------------


def in_namespace(store: Store, namespace: str) -> DataFrame:
    return store.meta.join(store.namespaces.filter(F.col("namespace") == namespace).select("seq"), "seq", "left_semi")


def with_tag(store: Store, tag: str) -> DataFrame:
    return store.tags.filter(F.col("tag") == tag).select("seq")


def with_tags(store: Store, tags: list[str]) -> DataFrame:
    """Blobs that have every tag."""
    out = store.meta
    for t in tags:
        out = out.join(with_tag(store, t), "seq", "left_semi")
    return out


def in_time(store: Store, start_ns: int, end_ns: int, namespace: str | None = None) -> DataFrame:
    """Both ends included, ordered by time and sequence; an inverted range is empty."""
    out = store.meta if namespace is None else in_namespace(store, namespace)
    return out.filter(F.col("wall_ns").between(start_ns, end_ns)).orderBy("wall_ns", "seq")


def near(store: Store, reference: int, window_ns: int) -> DataFrame:
    """Blobs within half the window of a blob's time, that blob included."""
    half = window_ns // 2
    at = store.meta.filter(F.col("seq") == reference).select(F.col("wall_ns").alias("at"))
    # one row at most: a broadcast of proven size
    return store.meta.join(F.broadcast(at), F.col("wall_ns").between(F.col("at") - half, F.col("at") + half)).drop("at").orderBy("wall_ns", "seq")


def tags_of(store: Store, seq: int) -> DataFrame:
    return store.tags.filter(F.col("seq") == seq).select("tag").orderBy("tag")


def delete(store: Store, edges: DataFrame, seqs: DataFrame) -> tuple[Store, DataFrame]:
    """(store, edges) without the blobs: indexes, edges either way, and chunks no other blob refers to.

    Children keep naming a deleted parent. Where others refer to a deleted owner's chunks, ownership stays
    with the content, so they can still be read.
    """
    gone = seqs.select("seq").distinct()
    meta = store.meta.join(gone, "seq", "left_anti")
    needed = meta.select(F.col("owner").alias("seq")).distinct()
    anti = lambda df, c: df.join(gone.withColumnRenamed("seq", c), c, "left_anti")
    return Store(meta, store.chunks.join(needed, "seq", "left_semi"), anti(store.tags, "seq"), anti(store.namespaces, "seq")), anti(anti(edges, "parent"), "child")
