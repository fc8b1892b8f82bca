"""The operators' own interfaces: planted cases, damage, skew, clashing columns, empty tables, repeated rows."""

from __future__ import annotations

import io
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate as dc
from lodestrata.llm import htmlextract, langid, linededup, neardup, packing, pii, quality, shared, tokenfile, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["n_words", "kept", "score", "lang_pred", "spans", "n_removed", "ids", "start", "contaminated", "component_id", "first", "n_lines", "base_failed"]
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


OPERATORS = {
    "decontaminate": lambda s, df: dc.decontaminate(df, s.createDataFrame([(1, "alpha beta")], "item_id long, text string")),
    "language": lambda s, df: langid.identify(df, langid.fit(df)),
    "near": lambda s, df: neardup.near_duplicates(df),
    "pii": lambda s, df: pii.sanitise(df),
    "pack": lambda s, df: packing.pack(df, BYTE),
    "lines": lambda s, df: linededup.drop_repeated_lines(df),
    "html": lambda s, df: htmlextract.extract(df.withColumnRenamed("text", "html")),
    "quality": lambda s, df: quality.quality(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_nulls_repeats_and_clashes(spark, name):
    op = OPERATORS[name]
    none = frame(spark, [])
    assert op(spark, none).count() == 0
    texts = [None, "", "alpha beta gamma", "alpha beta gamma", "x " * 50]
    rows = [(None if i == 1 else i // 2, t, None if i % 2 else "en", None, None) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("mine"))
    out = op(spark, df)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert out.count() == len(rows)
    assert op(spark, frame(spark, [None, None])).count() == 2


# ---- WARC --------------------------------------------------------------------------------------


class Memory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, pos):
        return self.data[pos : pos + n]


def archive(zipped, n=12):
    out, at = [], []
    for i in range(n):
        body = f"<p>page {i}</p>".encode() * (i * 40 + 1)
        raw = warc.page_record(i, f"http://x/{i}", body, warc.hashlib.sha256(body).hexdigest(), len(body), None)
        at.append(sum(map(len, out)))
        out.append(warc.gzip_member(raw) if zipped else raw)
    return b"".join(out), at


def ids(found):
    return [int(r.fields["page-id"]) for r in found if isinstance(r, warc.Record)]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    data, at = archive(zipped)
    clean = list(warc.salvage(Memory(data)))
    assert ids(clean) == list(range(12)) and all(isinstance(r, warc.Record) for r in clean)
    r = random.Random(1)
    for trial in range(40):
        bad, k = bytearray(data), r.randrange(12)
        end = (at + [len(data)])[k + 1]
        kind = trial % 4
        if kind == 0:
            p = r.randrange(at[k], end)
            bad[p] ^= 0x55
        elif kind == 1:
            p = r.randrange(at[k], end - 1)
            del bad[p : min(end, p + r.randint(1, 30))]
        elif kind == 2:
            p = r.randrange(at[k] + 1, end)
            bad[p:p] = bytes(r.randrange(256) for _ in range(r.randint(1, 200))) + b"WARC/1.1\r\nbroken\x1f\x8b\x08"
        else:
            bad = bad[: r.randrange(at[k] + 1, end)]
        found = list(warc.salvage(Memory(bytes(bad))))
        got = ids(found)
        want = [i for i in range(12) if i != k and not (kind == 3 and i > k)]
        assert [i for i in got if i != k] == want, (trial, kind, k, got)
        gaps = [g for g in found if isinstance(g, tuple)]
        if k not in got:
            assert gaps and all(a < b for a, b, _ in gaps) and gaps[0][0] >= at[k]
    assert list(warc.salvage(Memory(b""))) == []
    assert list(warc.salvage(Memory(b"junk"))) == [(0, 4, "no version line")]


def test_salvage_on_spark(spark):
    pages = spark.createDataFrame([(i, "u", "body " * (i + 30)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = shared.work_dir(spark, "warc-test")
    files = warc.write_archives(pages, folder)
    name = files.first().file
    path = name.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(path, "wb").write(data)
    found = warc.read_archives(spark, files).collect()
    gaps = [r for r in found if r.reason]
    assert len(gaps) == 1 and gaps[0].end > gaps[0].start and gaps[0].file == name
    assert len([r for r in found if not r.reason]) == 19


# ---- decontamination ---------------------------------------------------------------------------


def test_blocks_give_the_same(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randint(0, 40)}"
    items = [(i, " ".join(word() for _ in range(r.randint(1, 14)))) for i in range(30)]
    docs = [" ".join(word() for _ in range(r.randint(0, 60))) + " " + (items[i % 30][1] if i % 3 else "") for i in range(60)]
    b = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, dc.decontaminate(frame(spark, docs), b, block_windows=n).collect())) for n in (10**6, 7))
    assert one == many


# ---- near-duplicates ---------------------------------------------------------------------------


def test_large_groups(spark):
    """A hub with many variants that aren't alike among themselves, a chain, copies, and a bucket of strangers."""
    r = random.Random(5)
    base = [f"h{i}" for i in range(200)]
    texts = [" ".join(base)]
    for _ in range(250):
        w = list(base)
        for p in r.sample(range(200), 9):
            w[p] = f"n{r.randint(0, 10**9)}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(60)]
    for k in range(40):
        texts.append(" ".join(chain[k:] + [f"d{i}" for i in range(k)]))
    texts += ["copy of a text that is long enough to count here"] * 100
    r.shuffle(texts)
    got = neardup.near_duplicates(frame(spark, texts), shingle=2, percent=80).collect()
    sets = {i: {tuple(t.split()[s : s + 2]) for s in range(len(t.split()) - 1)} for i, t in enumerate(texts)}
    from .test_contracts import components

    assert {x.doc_id: x.component_id for x in got} == components(sets, 80)
    assert sum(x.first for x in got) == sum(x.kept for x in got)


def test_bayes_bounds():
    stops = neardup.bounds(0.8, 252)
    assert [n for n, _ in stops] == list(range(28, 253, 28)) and all(m < 0.8 * n for n, m in stops)
    r = np.random.default_rng(0)
    a = r.integers(0, 256, (4000, 252), np.uint8)
    alike = np.where(r.random(a.shape) < 0.8, a, r.integers(0, 256, a.shape, np.uint8))
    apart = np.where(r.random(a.shape) < 0.3, a, r.integers(0, 256, a.shape, np.uint8))
    assert len(neardup.survive(a, alike, stops)) == 4000 and len(neardup.survive(a, apart, stops)) == 0


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "same words in a row here", "en", "s", 1)] * 3 + [(None, "another text with null id", "en", "s", 1)] * 2, DOCS)
    got = neardup.near_duplicates(df).collect()
    assert sum(x.first for x in got) == 2 and {x.component_id for x in got} == {1, None}


# ---- personal data -----------------------------------------------------------------------------


def test_disclosing_terms(spark):
    r = random.Random(2)
    fill = lambda: " ".join(r.choice(["common", "words", "appear", "often", "here"]) for _ in range(15))
    texts = [fill() for _ in range(400)]
    for i in range(6):
        texts.append(f"{fill()} Zorbinia office agent77 mail boss@corp.example.com {fill()}")
    texts += [f"{fill()} office {fill()}" for _ in range(60)]
    out = pii.sanitise(frame(spark, texts)).collect()
    for x in out[400:406]:
        t = texts[x.doc_id]
        terms = {t[s.start : s.end] for s in x.spans if s.kind == "term"}
        assert {"Zorbinia", "agent77"} <= terms and "common" not in terms and "office" not in terms
        assert "<email>" in x.redacted and "Zorbinia" not in x.redacted and "<name> office <number>" in x.redacted
    assert all(not x.spans for x in out[:400])


# ---- packing and token files -------------------------------------------------------------------


def test_patterns():
    r = random.Random(4)
    for _ in range(30):
        h = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(1, 40))}
        found = packing.patterns(h, 64)
        back = {}
        for pack, n in found:
            assert 0 < sum(pack) <= 64 and n > 0
            for x in pack:
                back[x] = back.get(x, 0) + n
        assert back == h
        total, packs = sum(k * v for k, v in h.items()), sum(n for _, n in found)
        assert packs <= -(-total // 32) + 1  # no two packs are half empty
        for length in h:
            mine = sorted((lo, hi) for k, lo, hi, _, _ in packing.slots(found) if k == length)
            assert mine[0][0] == 0 and mine[-1][1] == h[length] and all(a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))


#: Letters that change their length, their kind or their neighbours under lower-casing or composition.
CASES = [chr(i) for i in range(0x80, 0x2FFF) if chr(i).lower() != chr(i) and (len(chr(i).lower()) > 1 or chr(i).lower().isascii() or not chr(i).isalpha())]
COMBINING = [chr(i) for i in [*range(0x300, 0x30F), 0x338, 0x345, 0x483, 0x5B0, 0x64B, 0x93C, 0x94D, 0x20E3, 0x3099]]


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_encoder_is_exact(path, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(tokens, "REMEMBERED", 1000)
    monkeypatch.setattr(tokens, "LONGEST", 12)
    bits = ["a", "Foo", "bar", "é", "È", "'s", "'ll", "don't", "...", ",", ".", "!?", "\n", "\n\n", " ", "  ", "\t", "\x1c", "\xa0", "12", "3", "|", "%%%", "<|endoftext|>", "<|startoftext|>", "<|", "漢", "字", "Ⅷ", "²", "Σ", "ς", "İ", "\r\n", "_", "-", "😀", "\x00", "a.b", "x,y.", *COMBINING, *CASES]
    texts = ["", " ", " a", "a ", "|", "a | b", "<|endoftext|>", "a <|endoftext|> b", "İ."] + ["".join(r.choice(bits) + " " * (r.random() < 0.4) for _ in range(r.randint(1, 30))) for _ in range(6000)]
    texts += [x + y + z for x in (*CASES, *"aÀÿßﬁ") for y in ("", r.choice(COMBINING)) for z in ".,;:!?"]
    e = tokens.Encoder(path)
    assert e.kind in ("lead", "ends")
    texts += r.sample(texts, len(texts))
    most = 0
    for i in range(0, len(texts), 500):
        for t, got in zip(texts[i : i + 500], e.encode(texts[i : i + 500]), strict=True):
            assert np.frombuffer(got, np.uint32).tolist() == e.t.encode(t, add_special_tokens=False).ids, t
        most = max(most, len(e.memory))
        if i % 4000 == 0:
            e.rest()
    assert most < 20_000 and any(len(p) > tokens.LONGEST for t in texts for p in t.split(" "))
    e.rest()
    assert not any(len(p) > tokens.LONGEST for p in {**e.memory, **e.older})


def test_file_reads_only_what_is_asked():
    sink = io.BytesIO()
    w = tokenfile.Writer(sink, 2)
    docs = {5: np.arange(10), None: np.array([7]), 9: np.zeros(5000, int)}
    for i, x in docs.items():
        w.add(i, x)
    w.close()
    data = sink.getvalue()

    class Counting(Memory):
        seen = 0

        def read_at(self, n, pos):
            Counting.seen += n
            return super().read_at(n, pos)

    f = tokenfile.Reader(Counting(data))
    before = Counting.seen
    assert np.frombuffer(f.frame(f.find({5})[0]), "<u4").tolist() == list(range(10))
    assert Counting.seen - before == f.table[0, 0] and len(f) == 3 and f.n_tokens(2) == 5000
    bad = bytearray(data)
    bad[8] ^= 1
    with pytest.raises(Exception):
        tokenfile.Reader(Memory(bytes(bad))).frame(0)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u2").tolist() == [x for v in docs.values() for x in v.tolist()]


def test_token_files_partial_read(spark):
    df = frame(spark, [f"text number {i}" for i in range(50)])
    m = tokenfile.write_token_files(df, shared.work_dir(spark, "ids"), WORDS, partitions=4)
    every = {r.doc_id: r for r in tokenfile.read_token_files(spark, m).collect()}
    some = tokenfile.read_token_files(spark, m, [3, 30]).collect()
    assert len(every) == 50 and sorted(r.doc_id for r in some) == [3, 30]
    assert all(every[r.doc_id] == r for r in some)


# ---- language, lines, html, quality ------------------------------------------------------------


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "12 34 !", "en"), (2, None, "en"), (3, "hello there friend", "en"), (4, "bonjour mon ami", "fr"), (5, "hello friend", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.fit(df)).collect()}
    assert got[1] == ("und", 0.0) and got[2] == ("und", 0.0) and got[5][0] == "en" and got[4][0] == "fr"
    none = langid.fit(df.filter("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_language_bound(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    m = langid.fit(df, per_label=100)
    assert m.labels == ["en"]


def test_line_windows(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb\nc", "q\nq\nq\nq", None, "a\nb"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.drop_repeated_lines(frame(spark, texts)).collect()}
    assert got == {0: ("a\nb\nc\nd", 4, 0), 1: ("x\ny", 5, 3), 2: ("", 3, 3), 3: ("q", 4, 3), 4: (None, None, None), 5: ("a\nb", 2, 0)}


PAGE = """<html><head><title>T</title><script>if (a < b) { "</p>" }</script></head><body><header><h2>Site</h2></header><nav>Home <a href=x>Go</a></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side text that goes on for a while to look like an article paragraph.</p></div>{body}
<div class="comments"><p>A reader says something that is long enough to count but is no part of the article.</p></div><form><label>Mail</label></form><footer>c</footer></body>"""
PROSE = "<h1>Title here</h1><p>First paragraph of some length,\n that is long enough to be taken for the text of an article.</p><p>Short.</p><p>Second &amp; last&nbsp;paragraph<br><b>bold</b> with enough text to count as prose.</p>"
TEXT = "Title here\nFirst paragraph of some length, that is long enough to be taken for the text of an article.\nShort.\nSecond & last paragraph bold with enough text to count as prose."


@pytest.mark.parametrize("body", [f"<article>{PROSE}</article>", f"<main>{PROSE}</main>", f'<div class="content">{PROSE}</div>', f"<article><header>{PROSE[:19]}</header>{PROSE[19:]}<aside>no</aside></article>"])
def test_extraction(body):
    assert htmlextract.main_text(PAGE.replace("{body}", body)) == TEXT


def test_extraction_edges():
    assert htmlextract.main_text(None) == "" and htmlextract.main_text("") == "" and htmlextract.main_text("<nav>only</nav>") == ""
    assert htmlextract.main_text("<p>Of.") == "Of." and htmlextract.main_text("just text &lt;3") == "just text <3"
    assert htmlextract.main_text("<p>cut off <a href='x") == "cut off"
    assert htmlextract.main_text("<nav>never closed<article><p>Text of it.</p></article>") == "Text of it."
    assert len(htmlextract.main_text("<article>" + "<p>one two</p>" * 20000 + "</article>")) == 8 * 20000 - 1


def test_frequent_lines(spark):
    r = random.Random(6)
    own = lambda: " ".join(f"w{r.randint(0, 5000)}" for _ in range(15))
    texts = [f"{own()}\nShared   Footer of the HOST site\n{own()}" for _ in range(60)]
    texts += ["shared footer of the host site\n" * 2 + "few own words that are only eleven in all " + "z"]
    texts += ["one text copied whole many times over so that it is no footer at all"] * 80
    got = {x.doc_id: x for x in quality.quality(frame(spark, texts), min_docs=20, share=0.1).collect()}
    assert all(got[i].kept and got[i].n_lines_removed == 1 and "Footer" not in got[i].clean_text for i in range(60))
    assert got[60].n_lines_removed == 2 and not got[60].kept
    assert all(got[i].kept and not got[i].n_lines_removed for i in range(61, 141))
    other = quality.quality(frame(spark, texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id"))), min_docs=20).collect()
    assert not any(x.n_lines_removed for x in other)


def test_words_match_the_patterns():
    import re

    r = random.Random(8)
    chars = "aZ09 \t\n\x0b\x0c\r\x00\x1c_-.é漢\xa0😀"
    for table, pattern, fold in ((shared.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True), (shared.NONSPACE, r"[^\x20\x09-\x0D]+", True), (shared.CASED, r"[^\x20\x09-\x0D]+", False)):
        texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 40))) for _ in range(300)]
        w = shared.Words(pa.array(texts), table)
        seen: dict[int, str] = {}
        for i, t in enumerate(texts):
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t) if fold else t
            words = re.findall(pattern, t)
            assert w.count[i] == len(words)
            for h, x in zip(w.hash[w.bounds[i] : w.bounds[i + 1]].tolist(), words, strict=True):
                assert seen.setdefault(h, x) == x
