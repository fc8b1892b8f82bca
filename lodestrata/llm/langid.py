"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters becomes a space, and each n-gram of 1 to 3 characters is
hashed to one of 2^17 buckets. Training counts buckets for each label; the matrix of smoothed log
probabilities (buckets x labels) is broadcast, and a batch is scored in numpy by gathering the rows of the
n-grams that occur and summing them text by text, ``CHUNK`` characters at a time. The posterior is taken at the mean
log probability of an n-gram times at most ``TRUST`` n-grams, since neighbouring n-grams aren't independent.

The posterior only compares the learnt labels. ``fit`` tells whether a text is in any: the mean log probability of
its n-grams under the predicted label, less that of the label's own training text. It is near 0 for a text of the
language and far below for gibberish or a language that wasn't learnt.

Bounds: at most about ``PER_LABEL`` labelled rows are learnt from for each label (chosen by hash, whole
texts), and at most ``MOST_LABELS`` labels are accepted, so the matrix has at most 2^17 x 256 32-bit floats (134 MB).
More labels are an error, never dropped.

Defined results: a null text, or one without a letter, is "und" with score 0 and fit minus infinity. With nothing to learn
from, every text is "und". Rows whose label is null are not learnt from. Ties go to the smaller label. Repeated
rows get equal results. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import byte_slices, map_texts, materialise, plain_strings, small_batches

BUCKETS, ORDERS = 1 << 17, (1, 2, 3)
PER_LABEL, MOST_LABELS, TRUST = 4000, 256, 100
SMOOTHING = 0.5
#: Characters scored at a time, whatever the length of a text, and labels whose counts are held at a time (1 MB each).
CHUNK, LABELS_HELD = 1 << 17, 16

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def runs(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """(rows, strings, n-grams begin in how many first characters of each): the lower-cased texts, each within blanks, in
    runs of about CHUNK characters. A longer text is cut, each part with what its last n-grams reach into the next."""
    rows, parts, own, held = [], [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        low = f" {t.lower()} "
        for at in range(0, len(low), CHUNK):
            n = min(CHUNK, len(low) - at)
            rows.append(i)
            parts.append(low[at : at + n + max(ORDERS) - 1])
            own.append(n)
            held += n
            if held >= CHUNK:
                yield rows, parts, own
                rows, parts, own, held = [], [], [], 0
    if rows:
        yield rows, parts, own


def ngrams(parts: list[str], own: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, n-grams of each part); those of white space alone are left out."""
    size = np.array([len(t) for t in parts], np.int64)
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = letters()[c]
    c[~letter] = 32
    ends = np.cumsum(size)
    room = np.repeat(ends, size) - np.arange(len(c))  # characters from here to the part's end
    mine = np.arange(len(c)) < np.repeat(ends - size + np.array(own, np.int64), size)
    out, rows = [], []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        some = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ c[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
            some |= letter[k : k + m]
        some &= (room[:m] >= n) & mine[:m]
        h *= np.uint32(0x9E3779B1)
        at = np.flatnonzero(some)
        out.append((h[at] >> np.uint32(32 - 17)).astype(np.int32))
        rows.append(np.searchsorted(ends, at, "right").astype(np.int32))
    if not out:
        return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
    r = np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return np.concatenate(out)[order], np.bincount(r, minlength=len(parts))


@dataclass
class Model:
    labels: list[str]
    log_prior: np.ndarray
    log_p: np.ndarray  # buckets x labels, float32
    expected: np.ndarray  # of each label, the mean log probability of its own training n-grams

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(label, posterior, fit) of each text."""
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.labels)))
        for rows, parts, own in runs(texts):
            grams, count = ngrams(parts, own)
            some = np.flatnonzero(count)
            if len(some) and self.labels:
                at, row = (np.cumsum(count) - count)[some], np.array(rows)[some]
                np.add.at(total, row, np.add.reduceat(self.log_p[grams], at, axis=0, dtype=np.float64))
                np.add.at(n, row, count[some])
        out, fit, best = np.zeros(len(texts)), np.full(len(texts), -np.inf), ["und"] * len(texts)
        some = np.flatnonzero(n)
        if not len(some):
            return best, out, fit
        mean = total[some] / n[some, None]
        total = mean * np.minimum(n[some], TRUST)[:, None] + self.log_prior
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        top = p.argmax(axis=1)
        for i, k in zip(some.tolist(), top.tolist(), strict=True):
            best[i] = self.labels[k]
        at = np.arange(len(some))
        out[some] = np.clip(p[at, top], 0, 1)
        fit[some] = mean[at, top] - self.expected[top]
        return best, out, fit


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> Model:
    """Learn from the rows of ``labelled`` whose label isn't null."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(label_col).cast("string").alias("y"), F.col(text_col).cast("string").alias("t"), F.xxhash64(*labelled.columns).alias("h")).filter("y is not null and t is not null")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    # a share of each label's rows, by a hash of the whole row so that copies of one text don't go together
    share = F.coalesce(*[F.when(F.col("y") == y, F.lit(min(1.0, per_label / sizes[y]))) for y in labels])
    sample = rows.filter((F.pmod("h", F.lit(1 << 40)) < F.ceil(share * (1 << 40))) | (share >= 1)).select("y", "t")
    index = {y: i for i, y in enumerate(labels)}

    def count(batches):
        held: dict[int, np.ndarray] = {}

        def flush():
            for y, n in held.items():
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), y, np.int32)), pa.array(k.astype(np.int32)), pa.array(n[k])], names=["y", "k", "n"])
            held.clear()

        for b in batches:
            for s in byte_slices(b, 1):
                y = [index[v] for v in s.column(0).to_pylist()]
                for r, parts, own in runs(plain_strings(s.column(1)).to_pylist()):
                    grams, n = ngrams(parts, own)
                    of = np.repeat([y[i] for i in r], n)
                    for one in np.unique(of).tolist():
                        if one not in held:
                            if len(held) >= LABELS_HELD:
                                yield from flush()
                            held[one] = np.zeros(BUCKETS, np.int64)
                        held[one] += np.bincount(grams[of == one], minlength=BUCKETS)
        yield from flush()

    found = materialise(sample.mapInArrow(count, "y int, k int, n long").groupBy("y", "k").agg(F.sum("n").alias("n")), "language-counts")
    used = max(found.select("k").distinct().count(), 1)
    log_p, expected = np.zeros((BUCKETS, len(labels)), np.float32), np.zeros(len(labels))
    for at in range(0, len(labels), LABELS_HELD):  # a bounded number of rows at a time
        part = found.filter(F.col("y").between(at, at + LABELS_HELD - 1)).toPandas()
        for y in range(at, min(at + LABELS_HELD, len(labels))):
            counts, mine = np.zeros(BUCKETS), part[part["y"] == y]
            counts[mine["k"].to_numpy(np.int64)] = mine["n"].to_numpy(np.float64)
            p = (counts + SMOOTHING) / (counts.sum() + SMOOTHING * used)
            log_p[:, y] = np.log(p)
            expected[y] = counts @ np.log(p) / max(counts.sum(), 1)
    prior = np.array([sizes[y] for y in labels], float)
    return Model(labels, np.log(prior / prior.sum()), log_p, expected)


def identify(documents: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns, lang_pred, score (posterior of the predicted label) and fit (see the module's text)."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS * MOST_LABELS floats

    def make():
        def f(texts: pa.StringArray) -> list[pa.Array]:
            best, score, near = held.value.score(texts.to_pylist())
            return [pa.array(best, pa.string()), pa.array(score), pa.array(near)]

        return f

    return map_texts(documents, text_col, keep, RESULT, make)
