"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import hashlib
import random

import pytest

from lodestrata.llm import htmlextract, pii, quality, queries, warc

from .test_operators import PAGE, PROSE, TEXT, Memory, frame, ids


# ---- op1_warc ----------------------------------------------------------------------------------


def page(i, url, body=b"<p>body</p>", first=None):
    return warc.page_record(i, url, body, hashlib.sha256(body).hexdigest(), len(body), first)


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("n", [65_000, 65_536, 131_072, 400_000])
def test_long_urls_are_read_back(zipped, n):
    url = "http://x/" + "é" * n
    raw = [page(1, "http://x/1"), page(2, url), page(3, url, first=2), page(4, "http://x/4")]
    found = list(warc.salvage(Memory(b"".join(map(warc.gzip_member, raw) if zipped else raw))))
    assert ids(found) == [1, 2, 3, 4] and found[1].fields["warc-target-uri"] == url


def test_long_urls_in_op1(spark, tmp_path):
    html = "<p>" + "word " * 60 + "</p>"
    rows = [(1, "http://x/" + "a" * 300_000, html), (2, "http://x/2", html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to) for r in queries.op1_warc(spark, str(tmp_path)).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1)}


# ---- op5_pii -----------------------------------------------------------------------------------


def test_terms_far_from_their_entity(spark):
    r = random.Random(2)
    fill = lambda n: " ".join(r.choice(["common", "words", "appear", "often", "here"]) for _ in range(n))
    texts = [fill(30) for _ in range(400)]
    # far from the mail address always; near it and again far away; and behind more than 400 marks
    texts += [f"Zorbinia {fill(300)} office agent77 boss@corp.example.com {'.' * 900} Qumran {fill(200)} agent77" for _ in range(6)]
    texts += [f"{fill(10)} Zorbinia without the address"]
    texts += [f"{fill(10)} office {fill(10)}" for _ in range(60)]
    out = {x.doc_id: x for x in pii.sanitise(frame(spark, texts)).collect()}
    for i in range(400, 406):
        terms = [texts[i][s.start : s.end] for s in out[i].spans if s.kind == "term"]
        assert terms == ["Zorbinia", "agent77", "Qumran", "agent77"]
        assert not any(x in out[i].redacted for x in ("Zorbinia", "agent77", "Qumran", "boss@")) and "office" in out[i].redacted
    assert all(not out[i].spans for i in range(len(texts)) if not 400 <= i < 406)


def test_terms_are_outside_all_base_spans():
    text = "ab@x.com 10.0.0.1 cd +12 345 678 9012 ef"
    h, start, end = pii.term_hashes(text, pii.base_spans(text))
    assert [text[i:j] for i, j in zip(start, end, strict=True)] == ["cd", "ef"] and len(h) == 2
    assert sum(len(x) for x, _ in pii.grids(h, h)) == 4 and not list(pii.grids(h[:0], h))


# ---- op10_quality ------------------------------------------------------------------------------


def test_line_limit_is_the_same_at_every_host_size(spark):
    r = random.Random(8)
    own = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(15))
    rows, want = [], {}
    for host, n in (("tiny", 3), ("small", 20), ("middle", 500), ("large", 2000)):
        for k in range(n):
            often = k < max(3, 0.036 * n)  # 3.6 % of a host is above the share, 1.6 % is not
            seldom = n >= 500 and k >= n - 0.016 * n
            text = "\n".join([own(), *["a footer that stands in many pages"] * often, *["a line that stands in few pages"] * seldom, own()])
            want[len(rows)] = int(often)
            rows.append((len(rows), text, "en", host, len(text)))
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert {x.doc_id: x.n_lines_removed for x in got} == want
    two = [(i, f"{own()}\nthe same line in two", "en", "s", 1) for i in range(2)]
    assert not any(x.n_lines_removed for x in quality.quality(spark.createDataFrame(two, "doc_id long, text string, lang string, source string, n_chars long")).collect())


# ---- op9_html ----------------------------------------------------------------------------------


@pytest.mark.parametrize("wrapper", ["div class='layout with-sidebar'", "div id='page' class='no-sidebar'", "section class='post-content share-enabled'", "div class='article-social'", "div class='page-widget'", "div role='search' id=hasMenu"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_do_not_bar_the_article(wrapper, inner):
    body = f"<{wrapper}><{inner}>{PROSE}</{inner}></{wrapper.split()[0]}>"
    assert htmlextract.main_text(f"<html><body>{body}</body></html>") == TEXT
    if inner != "div":
        assert htmlextract.main_text(PAGE.replace("{body}", body)) == TEXT


def test_named_parts_stay_barred():
    side = "<div class='sidebar-left'><article>A teaser that is long enough to count as prose but for its place.</article></div>"
    talk = "<div id='comments'>" + "<article class='comment-body'><p>A reader says more than the article itself does, and at length.</p></article>" * 20 + "</div>"
    assert htmlextract.main_text(f"<body>{side}<article>{PROSE}</article>{talk}</body>") == TEXT
    assert htmlextract.main_text(f"<body>{side}<div class='post'>{PROSE}</div><div class='widget' hidden><main>no</main></div></body>".replace("<article>", "<p>").replace("</article>", "</p>")) == TEXT


# ---- op1_warc, members of several records ------------------------------------------------------


def test_records_beside_damage_in_one_member():
    r = random.Random(3)
    raw = [page(i, f"http://x/{i}", bytes(r.randrange(32, 127) for _ in range(3000))) for i in range(30)]
    bad = raw[7].replace(b"HTTP/1.1", b"HTTP/1.2")
    data = warc.gzip_member(b"".join([*raw[:7], bad, *raw[8:]])) + warc.gzip_member(page(99, "u"))
    found = list(warc.salvage(Memory(data)))
    assert ids(found) == [i for i in range(30) if i != 7] + [99]
    assert [g[0] for g in found if isinstance(g, tuple)] == [0]
    whole = warc.gzip_member(b"".join(raw))
    late = bytearray(whole)
    late[len(whole) * 2 // 3 : len(whole) * 2 // 3 + 40] = bytes(40)
    for damaged in (bytes(late), whole[: len(whole) * 2 // 3]):
        found = list(warc.salvage(Memory(damaged + warc.gzip_member(page(99, "u")))))
        assert len(ids(found)) >= 18 and ids(found)[:18] == list(range(18)) and ids(found)[-1] == 99
        assert len(ids(found)) == len(set(ids(found))) < 31 and any(isinstance(g, tuple) for g in found)
