"""The query catalogue: for each operator a query over the test tables, and where SQL can express it,
the same in SQL (:mod:`lodestrata.plans.catalog_sql`).

Times of reads, keys and query vectors are fixed, orderings end with a key, and derived doubles are rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hlc, metadata
from ..functions import vectors as V
from ..operators import blobs, changes, graph, ivfpq, knn, merge, multimap, ordered, ttl
from ..operators.ordered import Bounds
from ..sources import store as S
from ..sources.tables import open_untyped, salvage, table, table_stats
from ..streaming import changefeed
from .composite import CompositeQuery
from .engine import Engine, EngineConfig

AS_OF_MS = 1_705_276_800_000  # 2024-01-15
QUERY_ID = 0
DAY_NS = 86_400_000_000_000




# ---- ordered tables ----------------------------------------------------------------------------


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def kv_get(spark, d):
    return ordered.get(orders(spark, d), "o_orderkey", 7)


def kv_range(spark, d):
    return ordered.scan(orders(spark, d), "o_orderkey", Bounds(100, 900))


def kv_range_reverse(spark, d):
    return ordered.scan(orders(spark, d), "o_orderkey", Bounds(100, 900, include_low=False, include_high=True), reverse=True)


def kv_range_unbounded(spark, d):
    return ordered.scan(orders(spark, d), "o_orderkey", Bounds(low=500))


def kv_iter(spark, d):
    return ordered.scan(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


def kv_first(spark, d):
    return ordered.first(orders(spark, d), "o_orderkey")


def kv_last_composite(spark, d):
    return ordered.last(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


def kv_len(spark, d):
    return ordered.length(orders(spark, d))


def _changes(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("ord"))


def kv_upsert(spark, d):
    return ordered.upsert(table(spark, d, "customer").select("c_custkey", "c_acctbal"), _changes(spark, d), ["c_custkey"], "ord")


def kv_insert_returns(spark, d):
    return ordered.replaced(table(spark, d, "customer").select("c_custkey", "c_acctbal"), _changes(spark, d), ["c_custkey"])


def kv_remove(spark, d):
    return ordered.remove(table(spark, d, "customer").select("c_custkey", "c_name"), _changes(spark, d).filter("c_custkey % 3 = 0"), ["c_custkey"])


def kv_pop_first(spark, d):
    top, rest = ordered.pop_first(orders(spark, d), "o_orderkey")
    return top.select("o_orderkey", F.lit("popped").alias("part")).unionByName(rest.select("o_orderkey", F.lit("rest").alias("part")))


def kv_pop_last(spark, d):
    top, rest = ordered.pop_last(orders(spark, d), "o_orderkey")
    return top.select("o_orderkey", F.lit("popped").alias("part")).unionByName(rest.select("o_orderkey", F.lit("rest").alias("part")))


def kv_extract_if(spark, d):
    out, rest = ordered.extract_if(orders(spark, d), F.col("o_totalprice") > 200000)
    return out.withColumn("part", F.lit("out")).unionByName(rest.withColumn("part", F.lit("rest")))


def kv_extract_from_if(spark, d):
    return ordered.extract_if(orders(spark, d), F.col("o_orderstatus") == "F", Bounds(100, 5000).predicate("o_orderkey"))[0]


def kv_retain(spark, d):
    return ordered.retain(orders(spark, d), F.col("o_orderstatus") == "O")


def kv_retain_in(spark, d):
    return ordered.retain(orders(spark, d), F.col("o_orderstatus") == "O", Bounds(100, 1000).predicate("o_orderkey"))


def kv_drain(spark, d):
    return ordered.drain(orders(spark, d), "o_orderkey", Bounds(100, 1000))[0]


def kv_drain_rest(spark, d):
    return ordered.drain(orders(spark, d), "o_orderkey", Bounds(100, 1000))[1]


def kv_raw(spark, d):
    return open_untyped(spark, f"{d}/nation.parquet", ["n_nationkey"], ["n_name", "n_regionkey"]).select(F.decode("key", "utf-8").alias("key"), F.hex("value").alias("value"))


# ---- multimaps ---------------------------------------------------------------------------------


def _mm(spark, d):
    return multimap.of(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


def mm_get(spark, d):
    return multimap.get(_mm(spark, d), 7)


def mm_range(spark, d):
    return multimap.scan(_mm(spark, d), Bounds(10, 500))


def mm_grouped(spark, d):
    return multimap.grouped(_mm(spark, d), Bounds(10, 500)).select("k", F.array_join("values", ",").alias("vals"))


def mm_grouped_whole(spark, d):
    return multimap.grouped(_mm(spark, d), Bounds()).select("k", F.array_join("values", ",").alias("vals"))


def mm_len(spark, d):
    return multimap.length(_mm(spark, d))


def mm_value_count(spark, d):
    return multimap.value_count(_mm(spark, d))


def _pairs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).alias("v"))


def mm_insert(spark, d):
    return multimap.insert(_mm(spark, d), _pairs(spark, d))


def mm_insert_returns(spark, d):
    return multimap.existed(_mm(spark, d), _pairs(spark, d))


def mm_remove(spark, d):
    return multimap.remove(_mm(spark, d), _pairs(spark, d))


def mm_remove_all(spark, d):
    return multimap.remove_all(_mm(spark, d), table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")))[1]


def mm_drain(spark, d):
    return multimap.drain(_mm(spark, d), Bounds(10, 500))[0]


# ---- merge -------------------------------------------------------------------------------------


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("n"), ttl.epoch_ms(F.col("ts")).alias("ts_ms"))


def _merged(spark, d, key, **aggs):
    return _events(spark, d).groupBy(key).agg(*[v.cast("long").alias(k) for k, v in aggs.items()])


def merge_numeric_add(spark, d):
    return _merged(spark, d, "user_id", w1=merge.numeric_add(F.col("n"), 1), w2=merge.numeric_add(F.col("n"), 2), w4=merge.numeric_add(F.col("n") * 100000, 4), w8=merge.numeric_add(F.col("n"), 8))


def merge_saturating_add(spark, d):
    return _merged(spark, d, "event_type", w1=merge.saturating_add(F.col("n") % 7, 1), w2=merge.saturating_add(F.col("n") % 100, 2), w4=merge.saturating_add(F.col("n"), 4))


def merge_max_min(spark, d):
    return _merged(spark, d, "user_id", high=merge.numeric_max(F.col("n"), 2), low=merge.numeric_min(F.col("n"), 2))


def merge_bitwise_or(spark, d):
    return _merged(spark, d, "user_id", bits=merge.bitwise_or(F.col("n")))


def merge_float_add(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.round(merge.float_add(F.col("value")), 4).alias("total"))


def merge_bitwise_or_bytes(spark, d):
    """Two-byte operands, and some of three bytes that change nothing after the first."""
    e = _events(spark, d).withColumn("b", F.unhex(F.lpad(F.hex(F.col("n") % 65536), 4, "0")))
    return merge.bitwise_or_bytes(e, ["user_id"], "b", "event_id", "bits").select("user_id", F.hex("bits").alias("bits"))


def merge_bytes_append(spark, d):
    e = _events(spark, d).withColumn("b", F.concat(F.substring("event_type", 1, 1), F.lit("|")))
    return merge.bytes_append(e, ["user_id"], "b", "event_id", "log").select("user_id", F.decode("log", "utf-8").alias("log"))


def merge_bytes_append_whole(spark, d):
    e = _events(spark, d).withColumn("b", F.concat("event_type", F.lit("|")))
    return merge.bytes_append(e, ["user_id"], "b", "event_id", "log").select("user_id", F.decode("log", "utf-8").alias("log"))


def merge_fn(spark, d):
    """Keep the larger of existing + 1 and the operand modulo 1000; a key that ends below 900 is deleted."""
    step = lambda a, x: F.greatest(a + 1, x % 1000)
    return merge.fold(_events(spark, d), ["user_id"], "n", "event_id", "v", F.lit(0).cast("long"), step, lambda a: F.when(a >= 900, a))


def merge_fn_python(spark, d):
    """The same fold in Python."""

    def step(key, old, new):
        return max((old or 0) + 1, new % 1000)

    out = merge.fold_python(_events(spark, d), ["user_id"], "n", "event_id", T.StructField("v", T.LongType()), step)
    return out.filter("v >= 900")


# ---- TTL ---------------------------------------------------------------------------------------


def _ttl(spark, d):
    days = F.create_map(*[F.lit(x) for x in ("click", 2, "view", 5, "purchase", 20, "signup", 1)])
    ms = F.get(F.array(days[F.col("event_type")]), F.lit(0)).cast("long") * 86_400_000
    e = _events(spark, d)
    return e.select("event_id", "event_type", ttl.expiry(F.col("ts_ms"), ms).alias("expires_at_ms"))


def ttl_live(spark, d):
    return ttl.scan(_ttl(spark, d), "event_id", AS_OF_MS)


def ttl_get(spark, d):
    return ttl.get(_ttl(spark, d), "event_id", 0, AS_OF_MS)


def ttl_range(spark, d):
    return ttl.scan(_ttl(spark, d), "event_id", AS_OF_MS, Bounds(50, 800))


def ttl_len_with_expired(spark, d):
    return ttl.len_with_expired(_ttl(spark, d))


def ttl_purge(spark, d):
    return ttl.purge(_ttl(spark, d), AS_OF_MS)[0]


def ttl_remove_returns(spark, d):
    return ttl.remove(_ttl(spark, d), table(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("event_id")), "event_id")[0]


# ---- vectors -----------------------------------------------------------------------------------


def _vectors(spark, d):
    """The unit vectors, stretched by (label + 1) so that metrics differ."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: (x * (F.col("label") + 1)).cast("float")).alias("embedding"))


def _query(spark, d) -> list[float]:
    return [float(x) for x in _vectors(spark, d).filter(F.col("vec_id") == QUERY_ID).first().embedding]


def vector_distances(spark, d):
    v, q = _vectors(spark, d), V.literal(_query(spark, d))
    e = F.col("embedding")
    return v.select("vec_id", *[F.round(V.distance(m, e, q), 5).alias(m) for m in V.METRICS], F.round(V.norm(e), 5).alias("norm"), F.round(F.element_at(V.normalize(e), 1), 6).alias("unit_1"))


def vector_quantize_binary(spark, d):
    return _vectors(spark, d).select("vec_id", F.hex(V.quantize_binary(F.col("embedding"))).alias("bits"))


def vector_hamming(spark, d):
    q = V.quantize_binary(V.literal(_query(spark, d)))
    return _vectors(spark, d).select("vec_id", V.hamming(V.quantize_binary(F.col("embedding")), q).alias("hamming"))


def vector_quantize_scalar(spark, d):
    q = _vectors(spark, d).select("vec_id", V.quantize_scalar(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.min", 6).alias("lo"), F.round("q.max", 6).alias("hi"), F.array_join("q.codes", ",").alias("codes"))


def vector_sq_distances(spark, d):
    q, v = V.literal(_query(spark, d)), _vectors(spark, d).select("vec_id", V.quantize_scalar(F.col("embedding")).alias("q"))
    return v.select("vec_id", F.round(V.sq_euclidean_sq(F.col("q"), q), 4).alias("l2"), F.round(V.sq_dot(F.col("q"), q), 4).alias("dot"), F.round(F.element_at(V.dequantize_scalar(F.col("q")), 1), 5).alias("first"))


def vector_f32_codec(spark, d):
    raw = _vectors(spark, d).select("vec_id", "embedding", V.write_f32_le(F.col("embedding")).alias("raw"))
    return raw.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), (V.read_f32_le(F.col("raw")) == F.col("embedding")).alias("same"))


def vector_nan_bits(spark, d):
    """Bits of vectors some elements of which are NaN: these are 0."""
    e = F.transform("embedding", lambda x, i: F.when((i % 3) == 0, F.lit(float("nan")).cast("float")).otherwise(x))
    return _vectors(spark, d).select("vec_id", F.hex(V.quantize_binary(e)).alias("bits"))


def knn_custom(spark, d):
    """The largest difference of an element as the distance."""
    largest = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))
    return knn.nearest(_vectors(spark, d), _query(spark, d), 10, metric=largest, digits=5)


def _knn(metric):
    def query(spark, d):
        return knn.nearest(_vectors(spark, d), _query(spark, d), 10, metric=metric, digits=5)

    return query


knn_cosine, knn_euclidean, knn_dot, knn_manhattan = (_knn(m) for m in ("cosine", "euclidean_sq", "dot", "manhattan"))


def knn_many(spark, d):
    v = _vectors(spark, d)
    found = knn.nearest_many(v, v.filter("vec_id % 20 = 0"), 5, metric="euclidean_sq", exclude_self=True)
    return found.select("query_id", "id", F.round("distance", 4).alias("distance"), "rank")


def metadata_predicates(spark, d):
    """Vectors joined to labels by id: which pass each filter; one without labels passes all."""
    v = table(spark, d, "embeddings").select("vec_id")
    m = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic", F.lit(True).alias("has"))
    q, t = F.col("quality"), F.col("toxic")
    j = v.join(m, "vec_id", "left")
    filters = {"eq": metadata.eq(q, 1), "ne": metadata.ne(q, 1), "lt": metadata.lt(q, 1), "ge": metadata.ge(q, 0.5), "both": metadata.all_of(metadata.eq(q, 1), metadata.eq(t, 0)), "either": metadata.any_of(metadata.eq(q, 0), metadata.eq(t, 1))}
    return j.select("vec_id", *[metadata.passes(p, F.col("has")).alias(f"p_{k}") for k, p in filters.items()])


def metadata_types(spark, d):
    """Equality across types is false, order across numbers is by value."""
    q, f = F.col("quality"), F.col("quality").cast("double")
    found = {"int_int": metadata.eq(q, 1), "int_float": metadata.eq(q, 1.0), "float_int": metadata.eq(f, 1), "float_float": metadata.eq(f, 1.0), "text_int": metadata.eq(q.cast("string"), 1), "ne_float": metadata.ne(q, 1.0), "ge_float": metadata.ge(q, 0.5)}
    return table(spark, d, "labels").select("doc_id", *[c.alias(k) for k, c in found.items()])


# ---- index -------------------------------------------------------------------------------------


def _index(spark, d, metric="euclidean_sq", clusters=8, subvectors=16):
    v = _vectors(spark, d)
    index = ivfpq.train(v, ivfpq.IndexConfig(64, clusters, subvectors, metric))
    return ivfpq.build(index, v, S.scratch(spark, "ivfpq"))


def _labels(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic")


def _asked(spark, d):
    """The queries of a search: every row whose id is divisible by 20."""
    return _vectors(spark, d).filter("vec_id % 20 = 0")


def _search(spark, d, params, metric="euclidean_sq", labels=None, index=None):
    return ivfpq.search_many(spark, index or _index(spark, d, metric), _asked(spark, d), params, f"{S.scratch(spark, 'ann')}/found", labels)


def _every(spark, d, **more):
    """All clusters probed, and every vector a candidate."""
    return ivfpq.SearchParams(10, nprobe=8, candidates=_vectors(spark, d).count(), **more)


def ann_exact(spark, d):
    """All clusters probed, every vector a candidate, re-ranked: equal to the exact search."""
    return ivfpq.search(spark, _index(spark, d), {QUERY_ID: _query(spark, d)}, _every(spark, d)).select("vec_id", F.round("distance", 5).alias("distance"))


def ann_exact_many(spark, d):
    return _search(spark, d, _every(spark, d)).select("query_id", "vec_id", F.round("distance", 4).alias("distance"), "rank")


def ann_filtered(spark, d):
    p = _every(spark, d, predicate=metadata.eq(F.col("quality"), 1))
    return ivfpq.search(spark, _index(spark, d), {QUERY_ID: _query(spark, d)}, p, _labels(spark, d)).select("vec_id", F.round("distance", 5).alias("distance"))


def ann_filtered_many(spark, d):
    p = _every(spark, d, predicate=metadata.eq(F.col("quality"), 1))
    return _search(spark, d, p, labels=_labels(spark, d)).select("query_id", "vec_id", F.round("distance", 4).alias("distance"), "rank")


def ann_reranked(spark, d, index=None):
    return _search(spark, d, ivfpq.SearchParams(10, nprobe=3), "cosine", index=index)


def ann_pq_only(spark, d, index=None):
    return _search(spark, d, ivfpq.SearchParams(10, nprobe=4, rerank=False), "dot", index=index)


def ann_diverse(spark, d, index=None):
    return _search(spark, d, ivfpq.SearchParams(10, nprobe=4, diversity=0.5), "manhattan", index=index)


def ann_recall(spark, d):
    """The share of the ten nearest by brute force that the searches above find over all queries, and that
    re-ranked searches find which probe more clusters."""
    probed = lambda n: lambda s, d, index: _search(s, d, ivfpq.SearchParams(10, nprobe=n), "cosine", index=index)
    searches = {"reranked": ("cosine", ann_reranked), "pq_only": ("dot", ann_pq_only), "diverse": ("manhattan", ann_diverse), "reranked_6": ("cosine", probed(6)), "reranked_8": ("cosine", probed(8))}
    out, known = None, {}
    for name, (metric, found) in searches.items():
        if metric not in known:
            path = f"{S.scratch(spark, 'truth')}/found"
            knn.nearest_many(_vectors(spark, d), _asked(spark, d), 10, metric=metric).select("query_id", F.col("id").alias("vec_id")).write.parquet(path)
            known[metric] = _index(spark, d, metric), spark.read.schema("query_id long, vec_id long").parquet(path)
        index, truth = known[metric]
        hits = found(spark, d, index).select("query_id", "vec_id", F.lit(1).alias("hit"))
        one = truth.join(hits, ["query_id", "vec_id"], "left").agg(F.lit(name).alias("search"), F.count_distinct("query_id").alias("queries"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


def ann_recall_gate(spark, d):
    """For searches that probe six of eight clusters: how many queries, and whether at least 0.9 of the ten nearest by brute force are found."""
    out = None
    for metric in ("euclidean_sq", "cosine"):
        truth = knn.nearest_many(_vectors(spark, d), _asked(spark, d), 10, metric=metric).select("query_id", F.col("id").alias("vec_id"))
        hits = _search(spark, d, ivfpq.SearchParams(10, nprobe=6), metric).select("query_id", "vec_id", F.lit(1).alias("hit"))
        one = truth.join(hits, ["query_id", "vec_id"], "left").agg(F.lit(metric).alias("metric"), F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


def ann_upsert_remove(spark, d):
    """Ids in the index after inserting moved vectors and removing some."""
    index = _index(spark, d)
    v = _vectors(spark, d)
    moved = v.filter("vec_id % 7 = 0").select((F.col("vec_id") + F.when(F.col("vec_id") % 2 == 0, 0).otherwise(100000)).alias("vec_id"), "embedding")
    stored = ivfpq.insert(index, ivfpq.codes(index, spark), moved)
    return ivfpq.remove(stored, v.filter("vec_id % 5 = 0")).select("vec_id", F.octet_length("code").cast("long").alias("code_bytes"))


# ---- blobs and graph ---------------------------------------------------------------------------


def _blobs(spark, d, dedup=True, chunk=1024):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    tags = F.array(F.col("source"), F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality"))))
    return blobs.ingest(docs, seq="doc_id", data="text", label="text", wall_ns=F.col("doc_id") * 3_600_000_000_000, namespace=F.col("lang"), tags=tags, dedup=dedup, dedup_min=1000, chunk=chunk)


def blob_read(spark, d):
    return blobs.read(_blobs(spark, d)).select("seq", F.sha2("data", 256).alias("sha256"), F.octet_length("data").cast("long").alias("n_bytes"), "intact")


def blob_range_read(spark, d):
    return blobs.read_range(_blobs(spark, d), 3, 1000, 1200, chunk=1024, clip=True).select("seq", F.hex("data").alias("data"))


def blob_meta(spark, d):
    return _blobs(spark, d).meta.select("seq", "label", "length", "sha256", "owner")


def blob_content_types(spark, d):
    code = (F.col("doc_id") % 12).cast("int")
    return table(spark, d, "documents").select("doc_id", blobs.content_type(code).alias("content_type"))


def blob_append(spark, d):
    """Two batches; the second's copies of content in the first are owned there."""
    docs = table(spark, d, "documents")
    columns = {"seq": "doc_id", "data": "text", "dedup": True, "dedup_min": 1000, "chunk": 1024}
    s = blobs.append(blobs.ingest(docs.filter("doc_id % 2 = 1"), **columns), docs.filter("doc_id % 2 = 0"), **columns)
    return blobs.read(s).join(s.meta.select("seq", "owner", "sha256"), "seq").select("seq", "owner", "sha256", "intact")


def blob_namespace_of(spark, d):
    return blobs.namespace_of(_blobs(spark, d), 2)


def blob_by_sequence(spark, d):
    s = _blobs(spark, d)
    return blobs.by_sequence(s, table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"))).select("seq", "length")


def blob_stats(spark, d):
    return blobs.stats(_blobs(spark, d))


def blob_dedup_stats(spark, d):
    return blobs.dedup_stats(_blobs(spark, d), 1000)


def blob_namespace(spark, d):
    return blobs.in_namespace(_blobs(spark, d), "de").select("seq", "length")


def blob_tags_all(spark, d):
    return blobs.with_tags(_blobs(spark, d), ["src0", "q1"]).select("seq", "length")


def blob_tags_of(spark, d):
    return blobs.tags_of(_blobs(spark, d), 2)


def blob_time_range(spark, d):
    return blobs.in_time(_blobs(spark, d), DAY_NS, 5 * DAY_NS).select("seq", "wall_ns")


def blob_time_range_namespace(spark, d):
    return blobs.in_time(_blobs(spark, d), DAY_NS, 20 * DAY_NS, "fr").select("seq", "wall_ns")


def blob_near(spark, d):
    return blobs.near(_blobs(spark, d), 50, DAY_NS).select("seq", "wall_ns")


def _graph(spark, d):
    """Nodes conv_id * 1000 + turn; each names the turn before, but every third names turn 0."""
    c = table(spark, d, "conversations").select("conv_id", "turn")
    node = F.col("conv_id") * 1000 + F.col("turn")
    parent = F.when(F.col("turn") == 0, F.lit(None)).when(F.col("turn") % 3 == 0, F.col("conv_id") * 1000).otherwise(node - 1)
    nodes = c.select(node.cast("long").alias("node"), parent.cast("long").alias("parent"))
    edges = nodes.filter("parent is not null").select("parent", F.col("node").alias("child"), blobs.relation((F.col("node") % 7).cast("int")).alias("relation"))
    return nodes, edges


def blob_delete(spark, d):
    """What is left of chunks, edges and tags after deleting every fifth blob."""
    s = _blobs(spark, d)
    seqs = s.meta.filter("seq % 5 = 0").select("seq")
    edges = s.meta.select((F.col("seq") - 1).alias("parent"), F.col("seq").alias("child"))
    left, rest = blobs.delete(s, edges, seqs)
    read = blobs.read(left)
    return read.groupBy().agg(F.count("*").alias("blobs"), F.count_if("intact").alias("intact")).join(F.broadcast(rest.agg(F.count("*").alias("edges")))).join(F.broadcast(left.tags.agg(F.count("*").alias("tags"))))


def graph_children(spark, d):
    return graph.children(_graph(spark, d)[1], 5000)


def graph_chain(spark, d):
    nodes, _ = _graph(spark, d)
    return graph.chain(nodes, 5005, 10)


def graph_path(spark, d):
    nodes, _ = _graph(spark, d)
    return graph.path(nodes, 5005, 5000, 10)


def graph_bfs(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.hops(edges, nodes, 5002, 2)


# ---- changes and history -----------------------------------------------------------------------


def _writes(spark, d):
    e = _events(spark, d)
    return e.select(F.col("event_type").alias("tab"), F.col("user_id").alias("key"), F.call_function("div", F.col("ts_ms"), F.lit(3_600_000)).alias("txn"), F.col("event_id").alias("seq"), F.col("n").alias("value"), (F.col("event_id") % 10 == 0).alias("deleted"))


def _log(spark, d):
    return changes.capture(_writes(spark, d), keys=["tab", "key"], order=["txn", "seq"], value="value", deleted="deleted")


MIDDLE_TXN = AS_OF_MS // 3_600_000


def cdc_capture(spark, d):
    return _log(spark, d)


def cdc_since(spark, d):
    return changes.since(_log(spark, d), MIDDLE_TXN)


def cdc_range(spark, d):
    return changes.between(_log(spark, d), MIDDLE_TXN - 24, MIDDLE_TXN)


def cdc_latest(spark, d):
    return changes.latest(_log(spark, d))


def cdc_retention(spark, d):
    cursors = spark.createDataFrame([("a", MIDDLE_TXN - 30), ("b", MIDDLE_TXN + 30)], "name string, position long")
    return changes.retained(_log(spark, d), MIDDLE_TXN + 20, 10, changes.advance_cursor(cursors, "b", MIDDLE_TXN - 100))


def _history(spark, d):
    o = table(spark, d, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return o.select(F.col("o_custkey").alias("k"), month.cast("long").alias("version"), F.col("o_orderkey").alias("v")).groupBy("k", "version").agg(F.max("v").alias("v"))


def _middle(spark, d):
    return 1996 * 12 + 6


def history_state(spark, d):
    return changes.state_at(_history(spark, d), _middle(spark, d), ["k"])


def history_as_of(spark, d):
    commits = _history(spark, d).select("version", (F.col("version") * 1000).alias("ts_ms")).distinct()
    return changes.as_of(commits, _middle(spark, d) * 1000 + 500)


def _diff(spark, d):
    h = _history(spark, d)
    a, b = (changes.state_at(h, _middle(spark, d) + x, ["k"]).filter(f"k % 11 != {y}").select("k", "v") for x, y in ((0, 3), (6, 5)))
    return a, b, changes.diff(a, b, ["k"])


def diff_upserts(spark, d):
    return _diff(spark, d)[2].upserts


def diff_deletes(spark, d):
    return _diff(spark, d)[2].deletes


def diff_counts(spark, d):
    return _diff(spark, d)[2].counts()


def diff_apply(spark, d):
    a, _, x = _diff(spark, d)
    return changes.apply_diff(a, x, ["k"])


def store_time_travel(spark, d):
    """Three commits of a versioned table; the state at the second, by time."""
    s = S.TableStore(spark, S.scratch(spark, "store"))
    o = orders(spark, d)
    for i in (1, 2, 3):
        t = s.begin(i * 1000)
        t.write("orders", o.filter(F.col("o_orderkey") % 4 < i))
        t.commit()
    return s.read("orders", s.version_at(2500))


def store_savepoint_kept(spark, d):
    """A savepoint pins its version against retention, for any session."""
    s = S.TableStore(spark, root := S.scratch(spark, "store"), keep=1)
    o = orders(spark, d)
    for i in (1, 2, 3):
        t = s.begin(i)
        t.write("orders", o.filter(F.col("o_orderkey") % 4 < i))
        t.commit()
        if i == 1:
            s.savepoint("first")
    other = S.TableStore(spark, root, keep=1)
    return other.read("orders", other.savepoints()["first"]).withColumn("versions", F.lit(",".join(map(str, other.versions()))))


def store_savepoint(spark, d):
    s = S.TableStore(spark, S.scratch(spark, "store"))
    o = orders(spark, d)
    t = s.begin(1)
    t.write("orders", o.filter("o_orderkey % 2 = 0"))
    t.commit()
    s.savepoint("a")
    t = s.begin(2)
    t.write("orders", o)
    t.commit()
    s.restore("a", 3)
    return s.read("orders")


def store_backup(spark, d):
    s = S.TableStore(spark, S.scratch(spark, "store"))
    t = s.begin(1)
    t.write("nation", table(spark, d, "nation"))
    t.write("region", table(spark, d, "region"))
    t.commit()
    target = S.scratch(spark, "backup")
    s.backup(target)
    return s.verify(target)


def stream_changefeed(spark, d):
    """A change folder followed by a stream, folded into a versioned table commit by commit."""
    w = _writes(spark, d).filter("not deleted").select(F.col("key"), "seq", "value")
    folder = S.scratch(spark, "feed")
    w.repartitionByRange(4, "seq").write.parquet(folder)
    s = S.TableStore(spark, S.scratch(spark, "store"))
    stream = changefeed.tail(spark, folder, w.schema, 2)
    changefeed.apply_batches(stream, s, "latest", ["key"], "seq", S.scratch(spark, "cursor")).start().awaitTermination()
    return s.read("latest")


def diff_export_import(spark, d):
    a, _, x = _diff(spark, d)
    changes.export_diff(x, folder := S.scratch(spark, "delta"))
    return changes.apply_diff(a, changes.import_diff(spark, folder), ["k"])


def _engine(spark, d, **switches):
    """Two group commits on a table of customers with change capture."""
    e = Engine(spark, S.scratch(spark, "engine"), EngineConfig(cdc=True, **switches))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    e.commit(1, lambda t: e.apply(t, "customer", ["c_custkey"], c.filter("c_custkey % 3 <> 0")))
    moved = c.filter("c_custkey % 5 = 0").select("c_custkey", (F.col("c_nationkey") + 100).alias("c_nationkey"))
    e.commit(2, lambda t: e.apply(t, "customer", ["c_custkey"], moved), lambda t: e.apply(t, "customer", ["c_custkey"], None, c.filter("c_custkey % 7 = 0")))
    return e


def store_engine_table(spark, d):
    return _engine(spark, d).read("customer")


def cdc_engine_log(spark, d):
    log = _engine(spark, d).changes_since(1)
    return log.select(F.get_json_object("key", "$.c_custkey").cast("long").alias("k"), "op", F.get_json_object("old_value", "$.c_nationkey").cast("long").alias("old"), F.get_json_object("new_value", "$.c_nationkey").cast("long").alias("new"))


def cdc_engine_retention(spark, d):
    e = _engine(spark, d, cdc_retention=1)
    return e.log().groupBy("txn").agg(F.count("*").alias("n"))


def _mutated(spark, d):
    """An engine after retain, extract, drain and changes of a multimap."""
    e = Engine(spark, S.scratch(spark, "engine"), EngineConfig(cdc=True))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    k, pairs = F.col("c_custkey"), c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"))
    e.commit(1, lambda t: e.apply(t, "customer", ["c_custkey"], c.unionByName(c)), lambda t: e.insert_pairs(t, "of_nation", pairs.filter("v % 2 = 0")))
    e.commit(2, lambda t: e.retain(t, "customer", ["c_custkey"], k % 5 != 0), lambda t: e.insert_pairs(t, "of_nation", pairs.filter("v % 3 = 0")))
    e.commit(3, lambda t: e.extract(t, "customer", ["c_custkey"], k % 7 == 0), lambda t: e.remove_pairs(t, "of_nation", pairs.filter("v % 4 = 0")))
    e.commit(4, lambda t: e.drain(t, "customer", "c_custkey", Bounds(10, 50)), lambda t: e.drain_pairs(t, "of_nation", Bounds(3, 6)))
    return e


def cdc_mutations(spark, d):
    """Every mutation's events: of ordered tables and multimaps."""
    log = _mutated(spark, d).log()
    number = lambda c, path: F.get_json_object(c, path).cast("long")
    value = lambda c: F.coalesce(number(c, "$.c_nationkey"), number(c, "$.v"))
    return log.select("txn", "tab", "op", F.coalesce(number("key", "$.c_custkey"), number("key", "$.k")).alias("k"), value("old_value").alias("old"), value("new_value").alias("new"))


def kv_salvage(spark, d):
    """A copy of a table beside a file that is no parquet."""
    folder = S.scratch(spark, "salvage")
    n = table(spark, d, "nation")
    n.repartition(2).write.parquet(folder)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/part-broken.parquet")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(b"PAR1 this is no parquet file PAR1")
    out.close()
    return salvage(spark, folder, n.schema)


def list_table_stats(spark, d):
    names = ("region", "nation", "customer", "orders")
    return table_stats(spark, {t: f"{d}/{t}.parquet" for t in names})


def stream_windows(spark, d):
    """Events counted in tumbling windows of six hours."""
    w = changefeed.windows(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "6 hours", "1 day", "event_type")
    return w.select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n")


def graph_edge_context(spark, d):
    """Edges with a context held to 62 bytes."""
    c = table(spark, d, "conversations").filter("turn > 0")
    return c.select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"), (F.col("conv_id") * 1000 + F.col("turn")).alias("child"), blobs.cut(F.concat(F.lit("turn by "), "role", F.lit(" "), F.repeat(F.lit("x"), 60)), blobs.CONTEXT).alias("context"))


def ann_codebooks(spark, d):
    """(subvector, number, codeword) of a trained index."""
    index = ivfpq.train(_vectors(spark, d), ivfpq.IndexConfig(64, 8, 16))
    rows = [(m, k, [float(x) for x in word]) for m, book in enumerate(index.codebooks) for k, word in enumerate(book)]
    return spark.createDataFrame(rows, "m int, k int, codeword array<double>")


def hlc_clock(spark, d):
    e = _events(spark, d)
    h = hlc.from_parts(F.col("ts_ms"), F.col("event_id") % 65536)
    other = hlc.from_parts(F.col("ts_ms") - 5 + F.col("event_id") % 11, F.lit(65535))
    now = F.col("ts_ms") + F.col("event_id") % 3 - 1
    return e.select("event_id", h.alias("h"), hlc.physical(h).alias("p"), hlc.logical(h).alias("l"), hlc.tick(h, now).alias("ticked"), hlc.merge(h, other, now).alias("merged"), hlc.from_wall_ns(F.col("ts_ms") * 1_000_000 + 999_999).alias("wall"))


# ---- composite ---------------------------------------------------------------------------------


def _composite(spark, d):
    docs = table(spark, d, "documents")
    b = docs.select(F.col("doc_id").alias("seq"), (F.col("doc_id") * 3_600_000_000_000).alias("wall_ns"), "lang", "source")
    near = knn.nearest(_vectors(spark, d), _query(spark, d), 50, metric="cosine", digits=6).select(F.col("vec_id").alias("seq"), "distance")
    nodes = docs.select(F.col("doc_id").alias("node"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") - F.col("doc_id") % 4).otherwise(F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 8) * 4)).cast("long").alias("parent"))
    edges = nodes.filter("parent is not null").select("parent", F.col("node").alias("child"))
    reach = lambda: graph.hops(edges, nodes, 8, 3).select(F.col("node").alias("seq"), "hops")
    return b, near, reach


def _scored(df):
    return df.select("seq", *[F.round(c, 5).alias(c) for c in ("score", "semantic", "temporal", "causal")])


def composite_semantic(spark, d):
    b, near, _ = _composite(spark, d)
    return _scored(CompositeQuery(b).semantic(near, 1.0).top_k(10).run())


def composite_temporal(spark, d):
    b, _, _ = _composite(spark, d)
    return _scored(CompositeQuery(b).temporal(2.0).time_range(DAY_NS, 4 * DAY_NS).top_k(10).run())


def composite_causal(spark, d):
    b, _, reach = _composite(spark, d)
    return _scored(CompositeQuery(b).causal(reach(), 1.0).top_k(15).run())


def composite_fused(spark, d):
    b, near, reach = _composite(spark, d)
    q = CompositeQuery(b).semantic(near, 0.6).temporal(0.3).time_range(DAY_NS, 4 * DAY_NS).causal(reach(), 0.1)
    return _scored(q.only(b.filter("lang = 'en'")).only(b.filter("source <> 'src1'")).top_k(10).run())


def composite_ann(spark, d):
    """The semantic signal from the index."""
    b, _, _ = _composite(spark, d)
    index = _index(spark, d, "cosine")
    hits = ivfpq.search(spark, index, {QUERY_ID: _query(spark, d)}, ivfpq.SearchParams(50, nprobe=16, candidates=100)).select(F.col("vec_id").alias("seq"), "distance")
    return _scored(CompositeQuery(b).semantic(hits, 1.0).temporal(0.5).top_k(10).run())


def list_tables(spark, d):
    s = S.TableStore(spark, S.scratch(spark, "store"))
    t = s.begin(1)
    for name in ("nation", "region", "old"):
        t.write(name, table(spark, d, "region"))
    t.rename("old", "new")
    t.drop("region")
    t.commit()
    return spark.createDataFrame([(x,) for x in s.tables()], "name string")


FAMILIES = ("kv_", "mm_", "merge_", "ttl_", "vector_", "knn_", "metadata_", "ann_", "blob_", "graph_", "cdc_", "history_", "diff_", "store_", "stream_", "hlc_", "composite_", "list_")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith(FAMILIES) and callable(v)}
