"""Quality rules with cross-document line frequency.

Rules on one text: its words, code points in words, symbols, repeated lines and repeated five-word
windows. Across documents: each line is normalised (A-Z lower-cased, white space collapsed) and hashed;
per host, the distinct documents that hold it are counted. Documents with equal text are one, so that copies
alone make no line frequent. Lines in more than ``share`` of their host's distinct documents, and in more
than ``min_docs`` of them, are removed, and a document that loses more than ``depleted`` of its
words is rejected. The share decides at every size of a host; in the smallest, a line of three documents is frequent.

Counts combine before the shuffle; the frequent lines are kept as key files that tasks read block by
block, once for ``GROUP_BYTES`` of text where there are several, and texts are never shuffled.

Defined results: a null or empty text has no words, so it fails the base rules. A null host is a host
of its own. Repeated rows get equal results. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import CASED, NONSPACE, Words, byte_slices, in_blocks, key_blocks, map_groups, materialise, mix, pass_through, plain_strings, raw_bytes, row_counts, small_batches, together

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
#: A line is too frequent in more than this share of its host's distinct documents. The floor only spares lines of one or
#: two documents: three are above the share in any host that the floor decides (up to 100 documents).
MIN_DOCS, SHARE = 2, 0.02
DEPLETED, SALTS = 0.5, 32

RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())])


class Lines:
    """The lines of a slice of texts that hold a word: row, hash of the normalised line, words and byte span."""

    def __init__(self, texts: pa.StringArray) -> None:
        w = self.words = Words(texts, NONSPACE)
        n = len(w.data)
        feed = np.flatnonzero(w.data == 10)
        self.begin = np.unique(np.concatenate((w.offsets[:-1][np.diff(w.offsets) > 0], feed + 1)))
        self.begin = self.begin[self.begin <= n]
        # a line feed at the end of a row begins an empty line, which holds no word
        first = np.searchsorted(w.start, self.begin)
        last = np.append(first[1:], len(w.start))
        ok = last > first
        self.at, self.to, self.first, self.count = self.begin[ok], np.append(self.begin[1:], n)[ok], first[ok], (last - first)[ok]
        self.row = w.rows()[self.first] if len(self.first) else np.zeros(0, np.int64)
        # order counts: each word's hash is weighted by its place in the line
        place = np.arange(len(w.hash)) - np.repeat(self.first, self.count)
        weighted = mix(w.hash + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.hash = mix(np.add.reduceat(weighted, self.first)) if len(self.first) else np.zeros(0, np.uint64)


def host_hashes(hosts: list[str | None]) -> np.ndarray:
    import xxhash

    seen: dict[str | None, int] = {}
    return np.array([seen.setdefault(h, xxhash.xxh64_intdigest("\x00" if h is None else f"={h}")) for h in hosts], np.uint64)


def base_counts(texts: pa.StringArray) -> dict[str, np.ndarray]:
    w = Words(texts, CASED)
    inside = w.low != 0
    starts = (w.data & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    h, fits = w.shingles(WINDOW)
    at = np.flatnonzero(fits)
    rows = w.rows()
    key = mix(h[at] + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[:-1] |= same
    twice[1:] |= same
    cover = np.zeros(len(w.hash) + 1, np.int64)
    rep = at[order[twice]]
    np.add.at(cover, rep, 1)
    np.add.at(cover, rep + WINDOW, -1)
    dup = []
    for t in texts.to_pylist():
        seen: set[str] = set()
        n = 0
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                n += line in seen
                seen.add(line)
        dup.append(n)
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": row_counts(inside & starts, w.offsets),
        "n_symbols": row_counts(symbol[w.data], w.offsets),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": row_counts(np.cumsum(cover[:-1]) > 0, w.bounds),
    }


def frequent_lines(documents: DataFrame, *, text_col: str, host_col: str, min_docs: int, share: float) -> list[str]:
    """Key files of the (host, line) pairs that are above their host's limit."""
    small_batches(documents.sparkSession)

    def run(batches):
        import xxhash

        for b in batches:
            for s in byte_slices(b, 1):
                texts = plain_strings(s.column(1))
                doc = np.array([xxhash.xxh64_intdigest(t or "") for t in texts.to_pylist()], np.uint64).view(np.int64)
                host = host_hashes(s.column(0).to_pylist())
                lines = Lines(texts)
                key = mix(lines.hash ^ host[lines.row]).view(np.int64)
                pair = np.unique(np.stack([lines.row, key], 1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
                rows = np.concatenate((pair[:, 0], np.arange(len(doc))))  # and a row for the document itself
                whole = np.concatenate((np.zeros(len(pair), bool), np.ones(len(doc), bool)))
                keys = np.concatenate((pair[:, 1], host.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(host.view(np.int64)[rows]), pa.array(whole), pa.array(keys), pa.array(doc[rows])], names=["host", "whole", "key", "doc"])

    hosts = F.col(host_col).cast("string") if host_col in documents.columns else F.lit(None).cast("string")
    rows = documents.select(hosts.alias("h"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "host long, whole boolean, key long, doc long")
    counts = rows.distinct().groupBy("host", "whole", "key").agg(F.count("*").alias("n"))
    counts = materialise(counts.filter(F.col("whole") | (F.col("n") > min_docs)), "line-counts")
    # a host may have a third of all lines: they are dealt over SALTS places, and the host's size goes to each
    size = counts.filter("whole").select("host", F.col("n").alias("docs"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    over = counts.filter("not whole").withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(size, ["host", "salt"]).filter(F.col("n") > F.greatest(F.lit(float(min_docs)), F.col("docs") * share))
    return key_blocks(over.select("key"), "frequent-lines")


def quality(documents: DataFrame, *, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None, min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED, texts: bool = True) -> DataFrame:
    """Kept columns and the counts of the module's text, base_failed, kept, and clean_text (without the frequent lines; null unless ``texts``)."""
    frequent = frequent_lines(documents, text_col=text_col, host_col=host_col, min_docs=min_docs, share=share)
    kept = pass_through(documents, keep, RESULT)
    hosts = F.col(host_col).cast("string") if host_col in documents.columns else F.lit(None).cast("string")
    names = [*RESULT.names]

    def make():
        def first(column: list[pa.Array]) -> tuple:
            """What is counted of a slice, and its lines with their keys."""
            host, found = host_hashes(column[0].to_pylist()), Lines(column[1])
            return base_counts(column[1]), found.row, found.count, found.at, found.to, mix(found.hash ^ host[found.row])

        def second(column: list[pa.Array], c: dict, row: np.ndarray, count: np.ndarray, begin: np.ndarray, end: np.ndarray, bad: np.ndarray) -> list[pa.Array]:
            n = len(column[1])
            c["n_lines_removed"] = np.bincount(row[bad], minlength=n)
            c["n_words_removed"] = np.bincount(row[bad], weights=count[bad], minlength=n).astype(np.int64)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
            ok = ~failed & (c["n_words_removed"] <= depleted * c["n_words"])
            clean: list[str | None] = [None] * n
            if texts:
                data, offsets = raw_bytes(column[1])
                raw = data.tobytes()
                cut: dict[int, list] = {}
                for r, i, j in zip(row[bad].tolist(), begin[bad].tolist(), end[bad].tolist(), strict=True):
                    cut.setdefault(r, []).append((i, j))
                for r in range(n):
                    at, out = int(offsets[r]), []
                    for i, j in cut.get(r, ()):
                        out.append(raw[at:i])
                        at = j
                    out.append(raw[at : int(offsets[r + 1])])
                    clean[r] = b"".join(out).decode()
            return [pa.array(c[k].astype(np.int64)) for k in names[:7]] + [pa.array(failed), pa.array(ok), pa.array(clean, pa.string())]

        def f(slices: list[list[pa.Array]]) -> list[list[pa.Array]]:
            found = [first(s) for s in slices]
            bad = np.split(in_blocks(frequent, np.concatenate([x[-1] for x in found])), np.cumsum([len(x[-1]) for x in found])[:-1])
            return [second(s, *x[:-1], b) for s, x, b in zip(slices, found, bad, strict=True)]

        return f

    return map_groups(documents, [hosts, documents[text_col]], kept, RESULT, make, together(frequent))
