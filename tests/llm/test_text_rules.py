"""Quality rules, license scans, chat formatting and HTML extraction."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillsift.llm import chat_format, html_extract, license_scan, quality_rules
from quillsift.llm.common import SPACES


def brute_quality(text):
    words = re.findall(f"[^{SPACES}]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    cover = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_against_a_loop(awkward, nothing):
    got = quality_rules.quality_rules(awkward).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *brute_quality(r.text)) for r in awkward.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(nothing).count() == 0
    kept = quality_rules.quality_rules(awkward, keep_row=True)
    assert kept.select("row.*").columns == awkward.columns


def test_packed_keys_fall_back_on_a_clash(spark, monkeypatch):
    text = "a b c x a b c y d e f z d e f"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    plain = quality_rules.measure(d).first().n_repeat_words
    monkeypatch.setattr(quality_rules, "PACKED_WORDS", 4)  # longer texts take the plain sort
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 2)
    assert quality_rules.measure(d).first().n_repeat_words == plain == brute_quality(text)[4] == 12


def test_rules_reject_junk_and_keep_prose(spark):
    prose = "The quiet river runs to the market and the people of the town walk along it in the evening. " + " ".join(f"Word{i} of line{i} and the note{i}." for i in range(20))
    junk = " ".join(f"word{i}### | the" for i in range(60))
    shout = " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(80))
    d = spark.createDataFrame([(1, prose), (2, junk), (3, shout)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(d).collect()} == {1: True, 2: False, 3: False}


def brute_licenses(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_against_a_loop(spark, awkward, nothing):
    texts = ["Licensed under the MIT License, mit-license; MIT license.", "GNU General Public License version 3", "Apache License, Version 2.0", "mıt license general public", "SPDX-License-Identifier: BSD-3-Clause", ""]
    d = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = license_scan.license_scan(d).collect()
    key = lambda t: tuple(-1 if v is None else v for v in t)
    assert sorted(key((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(key((r.doc_id, *brute_licenses(r.text))) for r in d.collect())
    by = {r.doc_id: r for r in got}
    assert by[100].labels == "mit" and by[101].labels == "gpl,gpl-3.0" and by[102].labels == "apache,apache-2.0" and by[104].labels == "bsd-3-clause"
    assert all(0 <= r.score <= 1 for r in got) and by[105].score == 0
    assert license_scan.license_scan(nothing).count() == 0


def test_contained_detections_go(spark):
    d = spark.createDataFrame([(1, "released under the terms of the GNU Lesser General Public License version 2.1")], "doc_id long, text string")
    r = license_scan.license_scan(d).first()
    assert "lgpl-2.1" in r.labels.split(",") and "gpl-2.0" not in r.labels.split(",")
    assert len(license_scan.rules()) > 200


def test_links_before_long_texts(spark):
    link = "See https://creativecommons.org/licenses/by-sa/4.0/ "
    texts = [link + "word " * 100_000, link + "for the pictures while the code is licensed under the ISC license and more words " * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(d).collect()}
    assert got[0].labels == "cc" and got[0].n_words == 100_009
    assert set(got[1].labels.split(",")) == {"cc", "isc"}


def test_long_roles_and_texts(spark):
    role, text = "a\\\n<|" * 25_000, "<|im_end|>\\" * 10_000
    d = spark.createDataFrame([(1, 0, role, text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat_format.read_back(chat_format.format_chat(d)).first()
    assert [(t.role, t.text) for t in r.turns] == [(role, text), ("assistant", text)] and r.loss_texts == [text]


def test_chat_edges(awkward, nothing):
    d = awkward.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text", "kept", "key", "row")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(d)).collect()}
    want = {}
    for r in awkward.collect():
        want.setdefault(r.doc_id, []).append(r.text or "")
    assert {k: sorted(r.loss_texts) for k, r in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_chat_escapes_are_reversible(spark, nothing):
    rows = [
        (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok"), (1, 1, "assistant", "\\<|\\|<\\| \\\\ \\n"), (2, 1, "assistant", None), (2, 0, None, ""), (2, 1, "assistant", "b"), (None, 0, "odd\nrole\\n", "x"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(d)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3]) for r in rows[:2]]
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", ""), ("assistant", "b")]
    assert [(t.role, t.text) for t in got[None].turns] == [("odd\nrole\\n", "x")]
    assert got[1].loss_texts == [rows[1][3]] and got[2].loss_texts == ["", "b"]
    assert chat_format.format_chat(d.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("text", None, None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 2)]
    d = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART_TYPE}>")
    r = chat_format.format_chat(d, parts_col="parts").first()
    assert r.formatted == "<|im_start|>user\nsee <\\|<|image_1|><|audio_2|><|document_3|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.turn, a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 3), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "c.pdf", 1500)]


def test_op9_digests(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in chat_format.op9_chat_formatting(spark, sf).collect()}
    conv = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        conv.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert got.keys() == conv.keys()
    for k, turns in conv.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(loss) and got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<p>one<p>two", "one two"),
        ("<body><nav><p>Menu, menu, menu.</p></nav><article><h1>T</h1><p>A b.<br>C</p></article><aside>x, y, z.</aside><footer>f</footer></body>", "T A b. C"),
        ("<div class='content'><h2>H</h2><p>Long text, with marks. And more, of it.</p></div><div id=comments><p>Nice, very nice. Really, truly.</p></div>", "H Long text, with marks. And more, of it."),
        ("<article><p>x &lt;b&gt; &#233;</p><script>if (a<b) x('</p>')</script><form><p>Sign, up.</p></form><div class='cookie-notice'>c</div><p>y</p></article>", "x <b> é y"),
        ("<article><p>a</p><!-- <p>no</p> --><p title='>'>b</p></article>", "a b"),
        ("<article><header><h1>Head</h1></header><p>Body.</p></article>", "Head Body."),
        ("<main><article><h2 class='section-header'>Head</h2><p>Text, one.</p><article class='comment'><p>No, no.</p></article></article><div class='teasers'><p>More.</p></div></main>", "Head Text, one."),
        ("<div><a href='/?class=ad'>Some, text.</a></div>", "Some, text."),
        ("<p class='notice'>N.</p><div><p>One, two. Three.</p><p>Four.</p></div>", "One, two. Three. Four."),
    ],
)
def test_extraction(page, text):
    assert html_extract.extract(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p title=it's>One fine text.</p><p>Two it's here.</p></article>", "One fine text. Two it's here."),
        ("<p>Text, one <span hidden>no</span> two <span class='advert'>no <b>x</b></span>end.</p>", "Text, one two end."),
        ("<article><p>Part, one of the text.</p></article><article><p>Part, two of the text.</p></article>", "Part, one of the text. Part, two of the text."),
        ("<article><p>Teaser.</p></article><div><p>The main text, long enough to count.</p><p>It goes on, and on, and on.</p></div>", "The main text, long enough to count. It goes on, and on, and on."),
        ("<div class='ad'><p>All there is, in a named element.</p></div>", "All there is, in a named element."),
    ],
)
def test_extraction_of_odd_pages(page, text):
    assert html_extract.extract(page) == text


def test_path_ratios_decide(monkeypatch):
    links = "".join(f"<li>Link {i}</li>" for i in range(120))
    long = "The first part of the text, which is long, has marks. It goes on for a while, and then ends. " * 3
    pages = {
        f"<div><ul>{links}</ul></div><div><h2>Head</h2><p>{long}</p><p>{long}</p></div><div><ul>{links}</ul></div>": f"Head {long.strip()} {long.strip()}",
        f"<div><table><tr><td>{'</td><td>'.join('abcdefgh')}</td></tr></table><p>{long}</p><blockquote>{long}</blockquote></div>": f"{long.strip()} {long.strip()}",
        f"<article><div class='promo'>Buy.</div><p>{long}</p><div class='related'>{long}</div></article>": None,
    }
    got = {p: html_extract.extract(p) for p in pages}
    assert all(got[p] == want for p, want in pages.items() if want)
    assert "Buy" not in got[list(pages)[2]]
    monkeypatch.setattr(html_extract, "scores", lambda found: [1.0] * len(found))
    assert all(html_extract.extract(p) != got[p] for p in list(pages)[:2])


def test_extraction_of_every_page(spark):
    import html as h

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in html_extract.op8_html_extract(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for k, p in pages.items():
        inner = re.search(r"<article>(.*?)</article>", p, re.S)[1]
        want = " ".join(h.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert got[k].text == want and got[k].n_chars == len(want)


def sentences(n: int) -> str:
    return " ".join(f"Sentence {i} of the text is long, has marks, and says a little more." for i in range(n))


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<div><p>A {sentences(3)}</p><div><p>B {sentences(5)}</p><p>{sentences(4)}</p></div></div>", f"A {sentences(3)} B {sentences(5)} {sentences(4)}"),
        (f"<body><div><p>Lead.</p><div><p>{sentences(5)}</p><p>{sentences(4)}</p></div><p>Tail of it.</p></div></body>", f"Lead. {sentences(5)} {sentences(4)} Tail of it."),
        (f"<body><article><h2>A</h2><p>{sentences(12)}</p></article><article><h2>B</h2><p>{sentences(4)}</p></article></body>", f"A {sentences(12)} B {sentences(4)}"),
        (f"<main><article><p>{sentences(12)}</p></article><article><p>{sentences(4)}</p></article></main>", f"{sentences(12)} {sentences(4)}"),
        ("We <mark class='search-hit'>found</mark> it, <span class='header'>Chapter</span> and <a class='related'>this link</a>.", "We found it, Chapter and this link."),
        (f"<article><p>{sentences(5)}</p><figure><figcaption>A view.</figcaption></figure><ul><li>One</li></ul></article>", f"{sentences(5)} A view. One"),
    ],
)
def test_extraction_keeps_all_of_the_text(page, text):
    assert html_extract.extract(page) == text


def test_extraction_of_deep_pages():
    import time

    for page, text in (("<div>x" * 100_000, " ".join("x" * 100_000)), ("<foo>" * 50_000 + "x" + "<li></b></x>" * 50_000, "x"), ("<p>y" + "<span hidden>" * 50_000 + "</b></span>" * 50_000, "y")):
        began = time.process_time()
        assert html_extract.extract(page) == text
        assert time.process_time() - began < 15  # a square of the depth would take minutes


def test_ratios_decide_on_pages_with_neutral_names(monkeypatch):
    """The table's pages without names and article marks, where the article's paragraphs are long: the whole article and nothing else."""
    import html as h

    import pyarrow.parquet as pq

    pages, want = [], []
    for p in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        inner = re.search(r"<article>(.*?)</article>", p, re.S)[1]
        text = " ".join(h.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        if len(text) >= 250 * inner.count("<p>"):
            pages.append(re.sub(r"<(/?)article>", lambda m: "</div>" if m[1] else "<div class='x2'>", p).replace('class="ad"', 'class="x1"'))
            want.append(text)
    assert len(pages) > 50 and [html_extract.extract(p) for p in pages] == want
    monkeypatch.setattr(html_extract, "scores", lambda found: [1.0] * len(found))
    assert all(html_extract.extract(p) != t for p, t in zip(pages, want))


def test_extraction_edges(spark):
    d = spark.createDataFrame([(1, "u", None, 5), (1, "u", "<p>x" * 20_000, 5)], "page_id long, url string, html string, n_chars long")
    got = html_extract.html_extract(d).collect()
    assert sorted(r.n_chars for r in got) == [0, 39_999]
    assert html_extract.html_extract(d.limit(0)).count() == 0
