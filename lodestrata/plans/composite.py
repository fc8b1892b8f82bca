"""Composite retrieval: semantic, temporal and causal signals fused into one ranked result.

A builder like

    CompositeQuery.of(store).semantic(neighbours, 0.6).temporal(0.3).time_range(a, b).causal(hops, 0.1).tag("x").top_k(10)

gives one DataFrame plan (``nearest_to`` and ``causal_from`` find the neighbours and the hops themselves). Candidates are the union of what each signal brings; namespace and tags filter
them after that, so fewer than top_k may be left; scores are normalised over the filtered candidates, but
hop counts over the whole causal set.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blobs import Store, in_namespace, with_tags
from ..operators.graph import hops
from ..operators.knn import nearest
from ..sources.store import put, scratch


class InvalidQuery(ValueError):
    pass


@dataclass(frozen=True)
class CompositeQuery:
    """``blobs``: seq, wall_ns (and whatever else)."""

    blobs: DataFrame
    near: DataFrame | None = None  # seq, distance
    reach: DataFrame | None = None  # seq, hops
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    span: tuple[int, int] | None = None
    filters: tuple[DataFrame, ...] = ()
    k: int = 10
    store: Store | None = None

    @staticmethod
    def of(store: Store) -> CompositeQuery:
        """A query over a blob store, which ``tag`` and ``namespace`` need."""
        return CompositeQuery(store.meta.select("seq", "wall_ns"), store=store)

    def tag(self, *tags: str) -> CompositeQuery:
        """Keep candidates that have all these tags."""
        return self.only(with_tags(self._store(), list(tags)))

    def namespace(self, name: str) -> CompositeQuery:
        return self.only(in_namespace(self._store(), name))

    def _store(self) -> Store:
        if self.store is None:
            raise InvalidQuery("tags and namespaces need a blob store")
        return self.store

    def nearest_to(self, vectors: DataFrame, query: list[float], weight: float, *, metric: str = "cosine", n: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> CompositeQuery:
        """The semantic signal of an exact search for ``n`` vectors (five times top_k, which is to be set before)."""
        found = nearest(vectors, query, 5 * self.k if n is None else n, id_col=id_col, vec_col=vec_col, metric=metric)
        return self.semantic(found.select(F.col(id_col).alias("seq"), "distance"), weight)

    def causal_from(self, edges: DataFrame, nodes: DataFrame, root: int, max_hops: int, weight: float) -> CompositeQuery:
        """The causal signal of all that is within some hops of a root."""
        return self.causal(hops(edges, nodes, root, max_hops).select(F.col("node").alias("seq"), "hops"), weight)

    def semantic(self, neighbours: DataFrame, weight: float) -> CompositeQuery:
        """(seq, distance) of an exact or indexed search, for about five times top_k."""
        return replace(self, near=neighbours, weights=(weight, *self.weights[1:]))

    def temporal(self, weight: float) -> CompositeQuery:
        return replace(self, weights=(self.weights[0], weight, self.weights[2]))

    def time_range(self, start_ns: int, end_ns: int) -> CompositeQuery:
        """Brings candidates; it filters none that other signals bring."""
        return replace(self, span=(start_ns, end_ns))

    def causal(self, hops: DataFrame, weight: float) -> CompositeQuery:
        """(seq, hops) from the root within the hop limit."""
        return replace(self, reach=hops, weights=(*self.weights[:2], weight))

    def only(self, seqs: DataFrame) -> CompositeQuery:
        """Keep candidates whose seq is in the table (a namespace, a tag); repeatable, all must hold."""
        return replace(self, filters=(*self.filters, seqs.select("seq")))

    def top_k(self, k: int) -> CompositeQuery:
        return replace(self, k=k)

    def normal_weights(self) -> tuple[float, float, float]:
        w = [max(0.0, x) for x in self.weights]
        if not sum(w):
            raise InvalidQuery("some weight must be above 0")
        if (w[0] and self.near is None) or (w[2] and self.reach is None):
            raise InvalidQuery("a weighted signal has no source")
        if w[1] and not w[0] and not w[2] and self.span is None:
            raise InvalidQuery("a temporal query needs a time range")
        if self.k < 1:
            raise InvalidQuery("top_k must be at least 1")
        return tuple(x / sum(w) for x in w)

    def run(self) -> DataFrame:
        """seq, score, semantic, temporal, causal (null for a signal that is off), best first, ties by seq."""
        w = self.normal_weights()
        parts = []
        blank = lambda kind: F.lit(None).cast(kind)
        if w[0]:
            parts.append(self.near.select("seq", F.col("distance").cast("double").alias("distance"), blank("int").alias("hops")))
        if self.span is not None:
            parts.append(self.blobs.filter(F.col("wall_ns").between(*self.span)).select("seq", blank("double").alias("distance"), blank("int").alias("hops")))
        if w[2]:
            parts.append(self.reach.select("seq", blank("double").alias("distance"), F.col("hops").cast("int").alias("hops")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        found = every.groupBy("seq").agg(F.min("distance").alias("distance"), F.min("hops").alias("hops")).join(self.blobs.select("seq", "wall_ns"), "seq")
        for f in self.filters:
            found = found.join(f, "seq", "left_semi")
        if w[2]:
            furthest = self.reach.agg(F.coalesce(F.max("hops"), F.lit(0)).alias("max_hops"))
            found = found.join(F.broadcast(furthest))
        else:
            found = found.withColumn("max_hops", F.lit(0))
        found = put(found, scratch(self.blobs.sparkSession, "candidates"))  # read twice: once for the ends of the scales
        good = F.col("distance").isNotNull() & ~F.isnan("distance") & (F.abs("distance") < F.lit(3.4028234663852886e38))
        ends = found.agg(F.min(F.when(good, F.col("distance"))).alias("d0"), F.max(F.when(good, F.col("distance"))).alias("d1"), F.min("wall_ns").alias("t0"), F.max("wall_ns").alias("t1"))
        found = found.join(F.broadcast(ends))  # one row
        semantic = F.when(~good, F.lit(0.0)).when(F.col("d1") - F.col("d0") <= 1.1920929e-07, F.lit(1.0)).otherwise(1 - (F.col("distance") - F.col("d0")) / F.nullif(F.col("d1") - F.col("d0"), F.lit(0.0)))
        span = (F.col("t1") - F.col("t0")).cast("double")
        temporal = F.when(span == 0, F.lit(1.0)).otherwise((F.col("wall_ns") - F.col("t0")).cast("double") / F.nullif(span, F.lit(0.0)))
        causal = F.when(F.col("hops").isNull(), F.lit(0.0)).when(F.col("max_hops") == 0, F.lit(1.0)).otherwise(1 - F.col("hops") / F.nullif(F.col("max_hops"), F.lit(0)))
        signals = [F.when(F.lit(x > 0), s).alias(n) for x, s, n in zip(w, (semantic, temporal, causal), ("semantic", "temporal", "causal"), strict=True)]
        scored = found.select("seq", *signals)
        total = sum((F.coalesce(F.col(n), F.lit(0.0)) * F.lit(x) for n, x in zip(("semantic", "temporal", "causal"), w, strict=True)), F.lit(0.0))
        return scored.select("seq", total.alias("score"), "semantic", "temporal", "causal").orderBy(F.col("score").desc(), "seq").limit(self.k)
