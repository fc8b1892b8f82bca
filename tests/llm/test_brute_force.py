"""Operators against plain implementations, over several key blocks, and with long or hostile input."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate as dc
from lodestrata.llm import htmlextract, langid, neardup, pii, quality, shared, tokenfile, warc

from .test_operators import PROSE, TEXT, Memory, frame

WORDS = {"en": "the house and that with from their would there which about".split(), "de": "das haus und nicht mit von ihre würde dort welche über".split()}


# ---- language ----------------------------------------------------------------------------------


def plain_buckets(text):
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    for n in langid.ORDERS:
        for i in range(len(t) - n + 1):
            if t[i : i + n].strip():
                h = n
                for c in t[i : i + n]:
                    h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
                    h ^= h >> 13
                yield (h * 0x9E3779B1 & 0xFFFFFFFF) >> 15


def language_rows(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[y]) for _ in range(r.randint(1, 30))), y) for i in range(n) for y in [r.choice(["en", "de"])]]


def test_language_is_plain_naive_bayes(spark):
    known, asked = language_rows(60, 1), language_rows(40, 2)
    counts, docs = {y: Counter() for y in WORDS}, Counter(y for _, _, y in known)
    for _, t, y in known:
        counts[y].update(plain_buckets(t))
    used = len(set().union(*counts.values()))
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df(asked), langid.fit(df(known))).collect()}
    for i, t, _ in asked:
        grams = list(plain_buckets(t))
        score = {}
        for y in WORDS:
            total = sum(counts[y].values()) + langid.SMOOTHING * used
            mean = sum(math.log((counts[y][g] + langid.SMOOTHING) / total) for g in grams) / len(grams)
            score[y] = mean * min(len(grams), langid.TRUST) + math.log(docs[y] / len(known))
        best = max(sorted(score), key=score.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(s - score[best]) for s in score.values()), abs=1e-4)


def test_language_of_long_texts_in_parts(spark, monkeypatch):
    model = langid.fit(spark.createDataFrame(language_rows(60, 1), "doc_id long, text string, lang string"))
    texts = [" ".join(t for _, t, _ in language_rows(50, 3)), None, "", "x", "İstanbul das haus " * 9, "123"]
    whole = model.score(texts)
    for chunk in (1, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        labels, score, fit = model.score(texts)
        assert labels == whole[0] and np.allclose(score, whole[1]) and np.allclose(fit[np.isfinite(fit)], whole[2][np.isfinite(whole[2])])
    monkeypatch.setattr(langid, "CHUNK", 1 << 17)
    import tracemalloc

    tracemalloc.start()
    assert model.score(["the house and that " * 300_000])[0] == ["en"]  # 5.7 MB
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150 << 20


def test_fit_tells_gibberish_and_other_languages(spark):
    model = langid.fit(spark.createDataFrame(language_rows(300, 1), "doc_id long, text string, lang string"))
    r = random.Random(4)
    own = [t for _, t, _ in language_rows(40, 5)]
    other = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)), "Все люди рождаются свободными и равными в своем достоинстве", "人人生而自由在尊严和权利上一律平等"]
    assert min(model.score(own)[2]) > -1 > -3.5 > max(model.score(other)[2])


# ---- terms, lines and windows over several key blocks ------------------------------------------


def test_terms_are_those_of_plain_counts(spark, monkeypatch):
    r = random.Random(6)
    common, rare = [f"word{chr(97 + i)}" for i in range(12)], [f"Name{chr(65 + i)}" for i in range(12)]
    people = {f"p{i}@x.com": rare[i] for i in range(8)}
    texts = [" ".join(r.choice(common) for _ in range(12)) for _ in range(80)]
    for mail, name in people.items():
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(r.sample(common, 5) + [mail] + ([name] if r.random() < 0.9 else []) + r.sample(rare, 1)))
    texts += texts[-5:] + [None, ""]
    rows = [(t, {m for m in re.findall(r"\S+@\S+", t or "")}, set(re.sub(r"\S+@\S+", " ", t or "").lower().split()), set(re.findall(r"[^\W_]+", (t or "").lower()))) for t in texts]
    n, df_e, df_t = len(rows), Counter(e for _, es, _, _ in rows for e in es), Counter(w for *_, ws in rows for w in ws)
    c = Counter((e, w) for _, es, ws, _ in rows for e in es for w in ws)
    support = {k: len({t for t, es, ws, _ in rows if k[0] in es and k[1] in ws}) for k in c}
    told = {k for k in c if support[k] >= pii.SUPPORT and math.log2(n / df_e[k[0]]) > 0 and math.log2(n * c[k] / (df_e[k[0]] * df_t[k[1]])) >= pii.DISCLOSURE * math.log2(n / df_e[k[0]])}
    assert told
    for keys in (shared.BLOCK_KEYS, 2):
        monkeypatch.setattr(shared, "BLOCK_KEYS", keys)
        got = {x.doc_id: x for x in pii.sanitise(frame(spark, texts)).collect()}
        for i, (t, es, _, _) in enumerate(rows):
            want = [(m.start(), m.end()) for m in re.finditer(r"\S+", t or "") if any((e, m[0].lower()) in told for e in es)]
            assert [(s.start, s.end) for s in got[i].spans if s.kind == "term"] == want, i


def test_quality_verdict_is_that_of_plain_counts(spark, monkeypatch):
    r = random.Random(7)
    shared_lines = [f"shared line number {i} of a site with several words" for i in range(6)]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 5))]
        rows.append((i, "\n".join(r.sample([*own, *r.sample(shared_lines, r.randint(0, 6))], k=len(own))) if i % 9 else "\n".join(r.sample(shared_lines, 4) + own[:1]), f"host{i % 3}" if i % 4 else None))
    rows += [(200, rows[9][1], rows[9][2]), (201, None, "host1"), (202, "", None)]
    norm = lambda x: " ".join(x.lower().split())
    docs, holds = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        docs[h].add(t or "")
        for x in (t or "").split("\n"):
            if x.split():
                holds[h, norm(x)].add(t)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    base = {x.doc_id: x for x in quality.quality(df).collect()}
    monkeypatch.setattr(shared, "BLOCK_KEYS", 2)
    blocks = {x.doc_id: x for x in quality.quality(df).collect()}
    assert base == blocks
    rejected = 0
    for i, t, h in rows:
        lines = [x for x in (t or "").split("\n") if x.split()]
        bad = [x for x in lines if len(holds[h, norm(x)]) > max(quality.MIN_DOCS, quality.SHARE * len(docs[h]))]
        words = len((t or "").split())
        lost = sum(len(x.split()) for x in bad)
        assert (base[i].n_lines_removed, base[i].n_words_removed) == (len(bad), lost)
        assert base[i].kept == (not base[i].base_failed and lost <= quality.DEPLETED * words)
        rejected += not base[i].kept and not base[i].base_failed
    assert rejected


def test_windows_in_blocks_are_found_alike(spark):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 25)))) for i in range(30)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(40)) + " " + r.choice(items)[1] for _ in range(60)] + [None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(repr, dc.decontaminate(frame(spark, texts), bench, block_windows=n).collect())) for n in (200_000, 7))
    assert one == many


# ---- near-duplicates at the threshold ----------------------------------------------------------


def test_links_at_the_threshold_are_found(spark):
    r = random.Random(9)
    texts = []
    for _ in range(150):  # pairs whose similarity is 0.80 to 0.83: the hardest to find
        base = [f"{r.randint(0, 10**9)}" for _ in range(200)]
        other = base[:]
        for k in range(r.randint(18, 21)):
            other[9 * k + 4] = f"x{r.randint(0, 10**9)}"
        texts += [" ".join(base), " ".join(other)]
    sets = [{tuple(t.split()[i : i + 1]) for i in range(len(t.split()))} for t in texts]
    exact = {i for i in range(0, len(texts), 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}
    out = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, texts), shingle=1, percent=80).collect()}
    found = {i for i in range(0, len(texts), 2) if out[i + 1] == i}
    assert len(exact) > 100 and found == exact


# ---- pages and archives ------------------------------------------------------------------------


@pytest.mark.parametrize("piece", ["<a \"'>x", "<a title=\"x>y'z", "<a ", "<p title=\"", "<nav><article><p>x</p>", "<div class=nav><i>", "</span>", "<!x", "<!--", "<![CDATA[", "&", "<", "<textarea>"])
def test_hostile_pages_take_time_in_proportion(piece):
    began = time.process_time()
    htmlextract.main_text("<nav>" + piece * 40_000 + "<p>text")
    assert time.process_time() - began < 8


def test_quotes_that_never_close():
    assert htmlextract.main_text("<p>one</p><p class=\"x>two</p><p id='a'>three</p>") == "one\ntwo\nthree"
    assert htmlextract.main_text(f"<article>{PROSE}</article><p title=\"a > b") == TEXT


def test_distribution_decides():
    links = "".join(f"<div><a href=x>Link {i}</a></div>" for i in range(12))
    para = "A paragraph of prose that is long enough to stand out among lines of links."
    page = f"<body>{links}<h2>Heading</h2><div>{para}</div><div>{para}</div><div>Short.</div><div>{para}</div>{links}</body>"
    assert htmlextract.main_text(page) == "\n".join(["Heading", para, para, "Short.", para])
    # without a surge nothing is text but the largest window; beside an article only dense text is
    assert htmlextract.main_text(f"<article><p>{para}</p><p>Of.</p></article><div>note</div>") == f"{para}\nOf."
    dense = " ".join([para] * 6)
    assert htmlextract.main_text(f"<article><p>{para}</p></article><div>{dense}</div>") == f"{para}\n{dense}"


def test_salvage_reads_no_stretch_twice():
    class Counting(Memory):
        seen = 0

        def read_at(self, n, pos):
            Counting.seen += n
            return super().read_at(n, pos)

    good = warc.gzip_member(warc.page_record(1, "u", b"x", __import__("hashlib").sha256(b"x").hexdigest(), 1, None))
    data = b"WARC/" * 400_000 + b"\x1f\x8b\x08" * 1000 + good
    began = time.process_time()
    found = list(warc.salvage(Counting(data)))
    assert [type(x) for x in found] == [tuple, warc.Record] and found[0][:2] == (0, len(data) - len(good))
    assert Counting.seen < 4 * len(data) and time.process_time() - began < 20


def test_requests_open_only_the_files_concerned(spark, tmp_path):
    import public_tokenizers

    docs = frame(spark, [f"text {i}" for i in range(50)]).select(F.when(F.col("doc_id") > 2, F.col("doc_id")).alias("doc_id"), "text")
    manifest = tokenfile.write_token_files(docs, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), partitions=5)
    rows = manifest.orderBy("start").collect()
    assert len(rows) > 2 and sum(r.n_null for r in rows) == 3 and rows[0].least <= 4
    assert sorted(r.doc_id for r in tokenfile.read_token_files(spark, manifest, [7, 49, 1000]).collect()) == [7, 49]
    assert len([r for r in tokenfile.read_token_files(spark, manifest, [None]).collect() if r.doc_id is None]) == 3
    import os

    os.remove(rows[-1].file.removeprefix("file://"))  # the last file isn't opened for a document of the first
    assert [r.doc_id for r in tokenfile.read_token_files(spark, manifest, [5]).collect()] == [5]


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(0, 6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    got = sorted(map(tuple, shared.join_hot(rows, table, "k", 5000).select("k", "id", "x").collect()))
    assert got == sorted((7 if i < 3000 else i, i, 14 if i < 3000 else 2 * i) for i in range(5000))
