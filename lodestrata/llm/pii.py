"""Personal data: patterns, and terms that give a protected entity away.

Base kinds are found by pattern, leftmost and without overlap within a kind: email, ip, card (Luhn), phone.

Information-theoretic sanitisation then asks which other words of a text reveal its entities. For an entity e (a
distinct value of a base kind) and a word t outside base spans, counted in documents over all documents:

    PMI(e, t) = log2(N * c(e, t) / (df(e) * df(t)))        IC(e) = log2(N / df(e))

PMI never exceeds IC for a word that discloses everything, so PMI / IC is the share of the entity's
information that the word gives away. A word is a disclosing term where that share is at least ``DISCLOSURE``
and it shares at least ``SUPPORT`` different texts with the entity (copies of one text are one). Every occurrence
of a disclosing term is a span in each text that holds its entity, wherever the two stand. In the
redacted text, base spans become their kind; disclosing words with digits are generalised to <number>,
capitalised ones to <name>, and other words are removed.

Entities and words that occur in too few texts for any pair are left out before pairs are formed, which changes no
result; the pairs of a text are then the product of the others, made in parts of bounded size. Counts combine before
the shuffle, document frequencies are counted for candidate words only, and the disclosing pairs are key files that
tasks read block by block.

Defined results: a null or empty text has no spans. Repeated rows get equal results. Offsets are code
points, end exclusive. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import byte_slices, in_blocks, key_blocks, map_groups, materialise, mix, plain_strings, raw_bytes, row_counts, small_batches, together

SUPPORT, DISCLOSURE = 3, 0.9
#: Pairs of entities and terms that a task holds at a time.
GRID = 1 << 18
KINDS = ("email", "ip", "card", "phone", "term")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]+")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULT = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str, digits: bool = True) -> list[tuple[int, int, int]]:
    """[(start, kind number, end)], sorted. ``digits`` false promises that the text has none."""
    out = [(i, 0, j) for i, j in emails(text)] if "@" in text else []
    if digits:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:].lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def entity_hashes(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The distinct entities of a text."""
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(f"{KINDS[kind]}:{text[start:end].lower()}") for start, kind, end in spans], np.uint64))


def term_hashes(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a text; words inside base spans are no terms."""
    import xxhash

    at = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
    first, last = np.array([x[0] for x in spans]), np.maximum.accumulate([x[2] for x in spans])
    before = np.searchsorted(first, at[:, 1])  # spans that begin before the word's end
    at = at[(before == 0) | (last[np.maximum(before - 1, 0)] <= at[:, 0])]
    return np.array([xxhash.xxh64_intdigest(text[i:j].lower()) for i, j in at.tolist()], np.uint64), at[:, 0], at[:, 1]


def grids(e: np.ndarray, t: np.ndarray):
    """All pairs of the two, in parts of bounded size."""
    step = max(1, GRID // max(1, len(t)))
    for k in range(0, len(e), step):
        part = e[k : k + step]
        yield np.repeat(part, len(t)), np.tile(t, len(part))


def pair_keys(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    return mix(e * np.uint64(0x9E3779B97F4A7C15) + t)


def flags(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a digit, and which may have any span."""
    data, offsets = raw_bytes(texts)
    digit = row_counts((data >= 48) & (data <= 57), offsets) > 0
    return digit, digit | (row_counts(data == 64, offsets) > 0)


def with_entities(batches, most: int = 0):
    """Lists of (text, base spans, entities) of the texts that have any, about ``most`` bytes of such texts at a time."""
    out, size = [], 0
    for b in batches:
        for s in byte_slices(b, 0):
            texts = plain_strings(s.column(0))
            digit, some = flags(texts)
            for i in np.flatnonzero(some).tolist():
                t = texts[i].as_py()
                if own := base_spans(t, bool(digit[i])):
                    out.append((t, own, entity_hashes(t, own)))
                    size += len(t)
            if out and size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


def known(keys: list[str], arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Which elements of each array are keys of the set; one look-up for all."""
    if not arrays:
        return []
    return np.split(in_blocks(keys, np.concatenate(arrays)), np.cumsum([len(x) for x in arrays])[:-1])


def disclosed(keys: list[str], sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each text's (entities, terms), the terms that disclose one of the entities. Look-ups are of about GRID * 8 pairs."""
    told, held, size = [[] for _ in sets], [], 0

    def flush() -> None:
        for (i, terms, _), hit in zip(held, known(keys, [x[2] for x in held]), strict=True):
            told[i].append(terms[hit])
        held.clear()

    for i, (e, t) in enumerate(sets):
        for x, y in grids(e, t):
            held.append((i, y, pair_keys(x, y)))
            size += len(y)
            if size >= GRID * 8:
                flush()
                size = 0
    flush()
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in told]


def joined(parts, names: list[str]):
    """Record batches of the parts' columns."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= GRID:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*held, strict=True)], names=names)


def doc_column(text: str, n: int) -> np.ndarray:
    import xxhash

    return np.full(n, xxhash.xxh64_intdigest(text), np.uint64)


def disclosing(documents: DataFrame, text_col: str, support: int, disclosure: float) -> list[str]:
    """Key files of the (entity, term) pairs above the threshold, and of their entities and terms."""
    spark = documents.sparkSession
    small_batches(spark)
    text = documents.select(F.col(text_col).cast("string").alias("t"))

    def entities(batches):
        return joined(((e, doc_column(t, len(e))) for found in with_entities(batches) for t, _, e in found), ["e", "doc"])

    # a pair has no more texts than its entity or its term, so those in fewer than ``support`` texts are in none
    found = text.mapInArrow(entities, "e long, doc long").groupBy("e", "doc").agg(F.count("*").alias("n"))
    found = materialise(found.groupBy("e").agg(F.sum("n").alias("df_e"), F.count("*").alias("texts")).filter(F.col("texts") >= support), "entities")
    live = key_blocks(found.select("e"), "live-entities")

    def words(batches):
        def parts():
            for found in with_entities(batches, together(live)):
                for (t, own, _), hit in zip(found, known(live, [x[2] for x in found]), strict=True):
                    if hit.any():
                        h = np.unique(term_hashes(t, own)[0])
                        yield h, doc_column(t, len(h))

        return joined(parts(), ["t", "doc"])

    near = text.mapInArrow(words, "t long, doc long").distinct().groupBy("t").agg(F.count("*").alias("texts"))
    candidates = materialise(near.filter(F.col("texts") >= support).select("t"), "near-terms")
    terms = key_blocks(candidates, "candidate-terms")
    both = key_blocks(found.select(F.col("e").alias("k")).unionByName(candidates.select(F.col("t").alias("k"))).distinct(), "candidates")

    def gather(batches):
        def parts():
            for found in with_entities(batches, together(both)):
                some = [(t, own, e[hit]) for (t, own, e), hit in zip(found, known(both, [x[2] for x in found]), strict=True) if hit.any()]
                words = [np.unique(term_hashes(t, own)[0]) for t, own, _ in some]
                for (t, _, e), h, hit in zip(some, words, known(both, words), strict=True):
                    for x, y in grids(e, h[hit]):
                        yield x, y, doc_column(t, len(x))

        return joined(parts(), ["e", "t", "doc"])

    pairs = text.mapInArrow(gather, "e long, t long, doc long").groupBy("e", "t", "doc").agg(F.count("*").alias("n"))
    pairs = materialise(pairs.groupBy("e", "t").agg(F.sum("n").alias("c"), F.count("*").alias("texts")).filter(F.col("texts") >= support), "entity-terms")
    total = documents.count()

    def count(batches):
        held, size, most, hits, n_hits = [], 0, together(terms), [], 0
        for b in batches:
            for s in byte_slices(b, 0):
                held += word_sets(plain_strings(s.column(0)))
                size += s.nbytes
                if held and size >= most:
                    hits.append(candidates_in(held))
                    n_hits += len(hits[-1])
                    held, size = [], 0
                if n_hits >= GRID * 16:  # combined before they leave the task, and bounded
                    yield counted(hits)
                    hits, n_hits = [], 0
        if held:
            hits.append(candidates_in(held))
        if hits:
            yield counted(hits)

    def candidates_in(sets: list[np.ndarray]) -> np.ndarray:
        every = np.concatenate(sets)
        return every[in_blocks(terms, every)]

    def counted(hits: list[np.ndarray]) -> pa.RecordBatch:
        t, n = np.unique(np.concatenate(hits), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["t", "n"])

    df_term = text.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("df_t"))
    scored = pairs.join(found.select("e", "df_e"), "e").join(df_term, "t")
    n = F.lit(float(max(total, 1)))
    pmi, ic = F.log2(n * F.col("c") / (F.col("df_e") * F.col("df_t"))), F.log2(n / F.col("df_e"))
    key = F.col("e"), F.col("t")
    chosen = scored.filter((ic > 0) & (pmi >= ic * disclosure)).select(*key)

    def keys(batches):
        for b in batches:
            e, t = (b.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((pair_keys(e, t), e, t)).view(np.int64))], names=["k"])

    return key_blocks(chosen.mapInArrow(keys, "k long").distinct(), "disclosing")


def word_sets(texts: pa.StringArray) -> list[np.ndarray]:
    """Of each text, the hashes of its distinct lower-cased words."""
    import xxhash

    out = []
    for t in texts.to_pylist():
        if t:
            words = {w.lower() for w in WORD.findall(t)}
            out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            word = text[a:b]
            out += [text[at:a], f"<{KINDS[k]}>" if k < 4 else "<number>" if any(c.isdigit() for c in word) else "<name>" if word[:1].isupper() else ""]
            at = b
    return "".join([*out, text[at:]])


def sanitise(documents: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Kept columns and spans (kind, start, end; by start, then kind as in KINDS) and the redacted text."""
    found = disclosing(documents, text_col, support, disclosure)

    def make():
        def f(slices: list[list[pa.Array]]) -> list[list[pa.Array]]:
            spans = [[[] for _ in range(len(s[0]))] for s in slices]
            red = [s[0].to_pylist() for s in slices]
            places, sets = [], []  # texts with entities, and those entities
            for k, (texts,) in enumerate(slices):
                digit, some = flags(texts)
                for i in np.flatnonzero(some).tolist():
                    if own := base_spans(red[k][i], bool(digit[i])):
                        spans[k][i] = own
                        places.append((k, i))
                        sets.append(entity_hashes(red[k][i], own))
            live = [(at, e[hit]) for at, e, hit in zip(places, sets, known(found, sets), strict=True) if hit.any()]
            words = [term_hashes(red[k][i], spans[k][i]) for (k, i), _ in live]
            some_terms = [np.unique(h) for h, _, _ in words]
            told = disclosed(found, [(e, t[hit]) for (_, e), t, hit in zip(live, some_terms, known(found, some_terms), strict=True)])
            for ((k, i), _), (h, start, end), t in zip(live, words, told, strict=True):
                hit = np.isin(h, t)
                spans[k][i] = sorted({*spans[k][i], *((a, 4, b) for a, b in zip(start[hit].tolist(), end[hit].tolist(), strict=True))})
            for k, i in places:
                red[k][i] = redact(red[k][i], spans[k][i])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return [[pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in own], kind), pa.array(r, pa.string())] for own, r in zip(spans, red, strict=True)]

        return f

    return map_groups(documents, [documents[text_col]], keep, RESULT, make, together(found))
