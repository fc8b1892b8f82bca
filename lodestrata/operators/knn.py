"""Exact nearest neighbours.

``nearest`` serves one query vector with column expressions and a top-k that each partition applies first.
``nearest_many`` serves a stated set of queries, in blocks of bounded size: a task keeps k rows for
each query of the block, and only those are shuffled. It compares tile by tile: a matrix product says which rows may
be near enough, within its rounding, and those are compared element by element, summed in order as SQL does, so that
equal vectors are equally far and ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V


def nearest(table: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", metric: str | Callable[[Column, Column], Column] = "cosine", digits: int | None = None) -> DataFrame:
    """(id, distance) of the k nearest; ties by id. k = 0 gives no rows. ``metric`` is a name or a function of two vector
    columns; ``digits`` rounds what is shown, not what is compared."""
    a, b = F.col(vec_col), V.literal(query)
    d = metric(a, b) if callable(metric) else V.distance(metric, a, b)
    best = table.select(id_col, d.alias("distance")).orderBy("distance", id_col).limit(k)
    return best if digits is None else best.select(id_col, F.round("distance", digits).alias("distance"))


def _distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """queries x rows, in double precision."""
    if metric == "dot":
        d = -(q @ x.T)
    elif metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        d = 1 - np.clip(np.divide(q @ x.T, size, out=np.zeros_like(size), where=size != 0), -1, 1)
    elif metric == "euclidean_sq":
        d = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T), 0)
    else:
        if len(x) < len(q):
            return _distances(metric, x, q).T
        d = np.stack([np.abs(x - row).sum(1) for row in q]) if len(q) else np.zeros((0, len(x)))
    return np.where(np.isnan(d), V.FAR, d)


NONE = np.iinfo(np.int64).max  # the id of a place that is free


def direct(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of vectors (last axis), their elements summed in order."""
    total = lambda v: np.cumsum(v, -1)[..., -1] if v.shape[-1] else np.zeros(v.shape[:-1])
    with np.errstate(all="ignore"):
        if metric == "dot":
            d = -total(a * b)
        elif metric == "cosine":
            size = np.sqrt(total(a * a)) * np.sqrt(total(b * b))
            d = 1 - np.clip(np.where(size == 0, 0.0, total(a * b) / np.where(size == 0, 1.0, size)), -1, 1)
        elif metric == "euclidean_sq":
            v = a - b
            v *= v
            d = total(v)
        else:
            d = total(np.abs(a - b))
    return np.where(np.isnan(d), V.FAR, d)


class Best:
    """The k nearest of each query so far, by distance and id."""

    def __init__(self, queries: int, k: int) -> None:
        self.d, self.i = np.full((queries, k), np.inf), np.full((queries, k), NONE)

    def add(self, at: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Rows ``ids`` at distance ``d`` of the queries numbered ``at``."""
        k = self.d.shape[1]
        near = d <= self.d[at, -1]
        at, d, ids = at[near], d[near], ids[near]
        if not len(at):
            return
        of = np.unique(at)
        q, d, ids = np.concatenate((np.repeat(of, k), at)), np.concatenate((self.d[of].ravel(), d)), np.concatenate((self.i[of].ravel(), ids))
        order = np.lexsort((ids, d, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, rank = order[rank < k], q[rank < k], rank[rank < k]
        self.d[q, rank], self.i[q, rank] = d[order], ids[order]

    def found(self, qid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the places that are taken."""
        at = self.i != NONE
        return np.repeat(qid, at.sum(1)), self.i[at], self.d[at]


def _first_of_equals(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that may be among k nearest: of equal vectors the k smallest ids."""
    _, group = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    g = group[order]
    return np.sort(order[np.arange(len(g)) - np.searchsorted(g, g) < k])


def offer(best: Best, metric: str, q: np.ndarray, x: np.ndarray, ids: np.ndarray, *, exclude: np.ndarray | None = None, allowed=None, wide: int = 256, high: int = 2048) -> None:
    """Compare each row of ``q`` with each of ``x``. ``exclude``: an id for each query that it doesn't find;
    ``allowed``: a function of (places in q, places in x) to a matrix of the pairs that count."""
    k = best.d.shape[1]
    if len(x) > k + 1 and x.shape[1]:
        at = _first_of_equals(x, ids, k + (exclude is not None))
        x, ids, of = x[at], ids[at], at
    else:
        of = np.arange(len(x))
    flat = metric == "manhattan"
    wide, high = (min(wide, 64), min(high, 1024)) if flat else (wide, high)
    size = (lambda v: np.abs(v).sum(1)) if flat else (lambda v: (v * v).sum(1))
    with np.errstate(all="ignore"):
        qn, xn = size(q), size(x)
        # what isn't finite, or so large or small that its square isn't, is always compared element by element
        plain_q, plain_x = np.isfinite(qn) & (qn < 1e30), np.isfinite(xn) & (xn < 1e30)
        if metric == "cosine":
            plain_q, plain_x = plain_q & (qn > 1e-30), plain_x & (xn > 1e-30)
    for i in range(0, len(q), wide):
        qs = slice(i, i + wide)
        a = q[qs] / np.sqrt(qn[qs])[:, None].clip(1e-200) if metric == "cosine" else q[qs]
        for j in range(0, len(x), high):
            xs = slice(j, j + high)
            b = x[xs]
            with np.errstate(all="ignore"):
                if flat:
                    a4, b4 = a.T.astype(np.float32, order="C"), b.T.astype(np.float32, order="C")
                    d, part = np.zeros((a4.shape[1], b4.shape[1]), np.float32), np.empty((a4.shape[1], b4.shape[1]), np.float32)
                    for u, v in zip(a4, b4, strict=True):
                        np.subtract(u[:, None], v[None], out=part)
                        np.abs(part, out=part)
                        d += part
                    slack = 1e-5 * (qn[qs] + xn[xs][plain_x[xs]].max(initial=0)) + 1e-30
                elif metric == "cosine":
                    d = 1 - a @ (b / np.sqrt(xn[xs])[:, None].clip(1e-200)).T
                    slack = np.full(len(a), 1e-11)
                else:
                    d = a @ b.T
                    if metric == "dot":
                        np.negative(d, out=d)
                    else:
                        d *= -2
                        d += qn[qs][:, None]
                        d += xn[xs][None]
                    slack = 1e-11 * (qn[qs] + xn[xs][plain_x[xs]].max(initial=0)) + 1e-200
            slack = np.where(plain_q[qs], slack, 0.0)
            odd = ~(plain_q[qs][:, None] & plain_x[xs][None]) if not (plain_q[qs].all() and plain_x[xs].all()) else None
            may = allowed(np.arange(len(q))[qs], of[xs]) if allowed else None
            if odd is not None:
                d[odd] = -np.inf  # never shut out, below
            if may is not None:
                d[~may] = np.inf
            limit = best.d[qs, -1] + slack
            near = d <= limit[:, None]
            if d.shape[1] > k + 1 and near.sum() > 4 * k * len(near):  # the tile's own k nearest are enough, all that are as near included
                spare = k + (exclude is not None)
                tile = d if odd is None else np.where(odd, np.inf, d)
                limit = np.minimum(limit, np.partition(tile, spare - 1, axis=1)[:, spare - 1] + 2 * slack)
                near = d <= limit[:, None]
            if may is not None:
                near &= may
            u, v = np.nonzero(near)
            for c in range(0, len(u), 16384):
                m, n = u[c : c + 16384] + i, v[c : c + 16384] + j
                if exclude is not None:
                    other = ids[n] != exclude[m]
                    m, n = m[other], n[other]
                best.add(m, direct(metric, q[m], x[n]), ids[n])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as doubles; one of another length, or null, is no number throughout."""
    if not column.null_count:
        flat = column.flatten()
        if not flat.null_count and (column.value_lengths().to_numpy() == dim).all():
            return np.asarray(flat, float).reshape(-1, dim)
    return np.array([v if v is not None and len(v) == dim else [np.nan] * dim for v in column.to_pylist()], float).reshape(-1, dim)


def collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a bounded table (q, v) of vectors, on the driver."""
    t = rows.select("q", "v").toArrow().combine_chunks()
    ids, v = t["q"].to_numpy(), t["v"].combine_chunks()
    v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks or [pa.array([], v.type)])
    return ids, _matrix(v, max(v.value_lengths().to_pylist(), default=0))


def nearest_many(table: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "cosine", block: int = 4096, exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) for each row of ``queries`` (same columns as the table).

    Blocks of queries are collected one by one (at most about ``block`` vectors) and sent to all tasks.
    """
    spark = table.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("q"), F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null")
    n = asked.count()
    blocks = max(1, -(-n // block))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    found = None
    for i in range(blocks if k > 0 else 0):
        qid, q = collected(asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i))
        if not len(qid):
            continue
        held = spark.sparkContext.broadcast((qid, q))

        def run(batches, held=held):
            qid, q = held.value
            best = Best(len(qid), k)
            for b in batches:
                if b.num_rows:
                    offer(best, metric, q, _matrix(b.column(1), q.shape[1]), b.column(0).to_numpy(), exclude=qid if exclude_self else None)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found(qid)], names=["query_id", "id", "distance"])

        part = rows.mapInArrow(run, "query_id long, id long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    # merge in two steps, so that a query's rows from very many tasks don't meet in one
    salted = Window.partitionBy("query_id", "salt").orderBy("distance", "id")
    some = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k)
    final = Window.partitionBy("query_id").orderBy("distance", "id")
    return some.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")
