"""The registered queries against brute force, on a small fixture of awkward rows and on the smallest test tables.

The fixture has null and empty texts, very long ones, ties, exact and near copies, repeated lines, benchmark passages,
personal data, junk, rows of four languages and control characters.
"""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import oracles, queries

SF = "/root/testdata/sf0.001"
WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def awkward() -> list[tuple]:
    r = random.Random(7)
    vocab = {"en": "the of and to river stone walking bright morning house under green quickly mountain letter".split(), "de": "der die und nicht straße brücke über grün morgen haus langsam berg brief würde schön".split(), "fr": "le la et été où forêt maison rivière matin très vert lettre montagne père ça".split(), "es": "el la y niño mañana río casa verde montaña carta rápido señor año pequeño ayer".split()}
    say = lambda lang, n: " ".join(r.choice(vocab[lang]) + str(r.randint(0, 60)) * (r.random() < 0.5) for _ in range(n))
    passage = " ".join(f"Bench{i}" for i in range(14))
    lines = ["Repeated line one here", "Repeated line two here", "Repeated line three", "Repeated line four"]
    texts = [None, "", " ", "\n\n", "a", "b c", "B c", "12 34", "\x00nul \x1cword", "é", "_ - _", "|a| <b> #c"]
    for lang in vocab:
        for _ in range(14):
            texts.append("\n".join(say(lang, r.randint(5, 60)) for _ in range(r.randint(1, 5))))
    base = say("en", 300).split()
    for _ in range(25):  # near copies of one text
        w = list(base)
        for _ in range(r.randint(0, 18)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9999)}"
        texts.append(" ".join(w))
    texts += ["copied text " + " ".join(base[:40])] * 6
    texts += [say("en", 20) + "\n" + "\n".join(lines[: r.randint(2, 4)]) + "\n" + say("en", 12) for _ in range(12)]
    texts += [say("fr", 30) + ", " + passage.upper() + "! " + say("fr", 10), passage[:40], "short item", say("de", 12) + " Short, ITEM " + say("de", 4)]
    texts += [say("en", 12) + f" mail a.b+{i % 3}@x-y.example.com, +1 (212) 555-{1000 + i} from 10.0.{i}.255 card 4111 1111 1111 1111 secretcode{i % 3} " + say("en", 6) for i in range(12)]
    texts += ["1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 @ a@b a@b.c@d.e.f +12 345 678 901 2345 +1 4111111111111112", "9" * 5000, "a@" * 2000 + "b.c", "one two three four five " * 60]
    texts += [say("es", 30000)]
    return [(i, t, None if i % 17 == 0 else lang, None if i % 13 == 0 else f"src{i % 4 if i % 3 else 0}", len(t or "")) for i, (t, lang) in enumerate((t, ("en", "de", "fr", "es")[i % 4]) for i, t in enumerate(texts))]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    rows = awkward()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    items = [(1, " ".join(f"bench{i}" for i in range(14))), (2, "short ITEM"), (3, None), (4, "..."), (5, " ".join(f"bench{i}" for i in range(2, 13))), (None, "river")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    html = "<p>" + "word " * 60 + "</p>"
    pages = [(1, "http://a/", html + "é"), (2, None, None), (3, "http://b/", html), (0, "u", html), (5, "u", "tiny"), (6, "u", "tiny"), (7, "u", ""), (9, "u", html)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{d}/pages.parquet")
    return str(d), rows, items, pages


@pytest.fixture(params=["small", "tables"])
def case(request, small):
    if request.param == "small":
        return small
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    read = lambda t, c: duckdb.sql(f"select {c} from '{SF}/{t}.parquet'").fetchall()
    return SF, read("documents", "doc_id, text, lang, source, n_chars"), read("benchmark", "item_id, text"), read("pages", "page_id, url, html")


def rows(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select(*cols).collect()}


def test_op1(spark, case):
    d, _, _, pages = case
    first, want = {}, {}
    for i, _, html in sorted(pages):
        raw = (html or "").encode()
        h = hashlib.sha256(raw).hexdigest()
        again = len(raw) >= 100 and h in first
        want[i] = (len(raw), h, "revisit" if again else "response", first[h] if again else None)
        first.setdefault(h, i)
    assert rows(queries.op1_warc(spark, d), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_op2(spark, case):
    d, docs, items, _ = case
    win = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        for s in range(max(1, len(w) - 9) if w else 0):
            win[tuple(w[s : s + 10])].add("null" if i is None else str(i))
    want = {}
    for i, t, *_ in docs:
        w = ALNUM.findall(low(t or ""))
        hit, found = set(), set()
        for n in {len(x) for x in win}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in win:
                    hit.update(range(s, s + n))
                    found |= win[k]
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert any(x[1] for x in want.values())
    assert rows(queries.op2_decontaminate(spark, d), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_op3(spark, case):
    d, docs, _, _ = case
    got = rows(queries.op3_language(spark, d), "doc_id", "held_out", "lang_pred", "score")
    assert len(got) == len(docs)
    for i, t, *_ in docs:
        held, pred, score = got[i]
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= score <= 1
        assert (pred == "und") == (not any(c.isalpha() for c in t or ""))
    if d == SF:
        right = [got[i][1] == lang for i, t, lang, *_ in docs if got[i][0] and lang and len(t) > 40]
        assert np.mean(right) > 0.97


def components(sets, percent):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def shingle_sets(docs, k):
    out = {}
    for i, t, *_ in docs:
        w = WORD.findall(low(t or ""))
        out[i] = {tuple(w[s : s + k]) for s in range(max(1, len(w) - k + 1))} if w else set()
    return out


def test_op4(spark, case):
    d, docs, _, _ = case
    sets = shingle_sets(docs, 2)
    comp = components(sets, 80)
    assert rows(queries.op4_near_duplicates(spark, d), "doc_id", "n_shingles", "component_id", "kept") == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_op5(spark, case):
    d, docs, _, _ = case
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(y) <= 255 for y in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    ]
    got = rows(queries.op5_pii(spark, d), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t, *_ in docs:
        found = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m[0]))
        c, joined = Counter(x[3] for x in found), ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
        assert got[i][:5] == (c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(joined.encode()).hexdigest()), i
        assert ",".join(x for x in got[i][5].split(",") if not x.startswith("term")) == joined


def encoded(docs, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for i, x, *_ in docs}


def test_op6(spark, case):
    d, docs, _, _ = case
    ids = encoded(docs, "byte_bpe_50k.json", 0)
    got = [tuple(r) for r in queries.op6_packing(spark, d).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    at, seq = Counter(), defaultdict(list)
    for i, start, n, crc, total, s, o in sorted(got):
        assert start == at[i] and n > 0 and total == len(ids[i]) and crc == zlib.crc32(ids[i][start : start + n].tobytes())
        at[i] += n
        seq[s].append((o, n))
    assert at == {i: len(x) for i, x in ids.items()}
    for parts in seq.values():
        place = 0
        for o, n in sorted(parts):
            assert o == place
            place += n
        assert place <= 1024
    assert sum(at.values()) > 0.9 * 1024 * (len(seq) - 1)


def test_op7(spark, case):
    d, docs, _, _ = case
    ids = encoded(docs, "word_bpe_49k.json", 1)
    want, start = {}, 0
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    assert rows(queries.op7_token_files(spark, d), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op8(spark, case):
    d = case[0]
    c = duckdb.connect()
    at = f"{d}/documents.parquet"
    c.execute(f"create view documents as select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    rel = c.sql(oracles.SQL["op8_line_dedup"])
    k = [rel.columns.index(x) for x in ("doc_id", "text", "n_lines", "n_removed")]
    want = {r[k[0]]: tuple(r[x] for x in k[1:]) for r in rel.fetchall()}
    assert any(x[2] for x in want.values())
    assert rows(queries.op8_line_dedup(spark, d), "doc_id", "text", "n_lines", "n_removed") == want


def test_op9(spark, case):
    import html as h

    d, _, _, pages = case
    got = rows(queries.op9_html(spark, d), "page_id", "url", "text", "n_chars")
    for i, url, html in pages:
        assert got[i][0] == url and got[i][2] == len(got[i][1])
        if html and (m := re.search(r"<article>(.*?)</article>", html, re.S)):
            blocks = (" ".join(h.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", m[1].replace("<br>", " ")))
            assert got[i][1] == "\n".join(b for b in blocks if b)


def test_op10(spark, case):
    d, docs, _, _ = case
    got = rows(queries.op10_quality(spark, d), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t, *_ in docs:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        five = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        rep = {k for j in range(len(w) - 4) if five[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        assert got[i][:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed), i
        assert not (failed and got[i][6])
