import random
import re

import pytest

from ledgerlens.llm import htmltext, licenses, pii, quality
from tests.llm.common import edge_docs, edge_rows, no_docs, words


GPL = """ * This {0} is free software; you can redistribute it and/or modify
 * it under the terms of the GNU {2}General Public License as published by
 * the Free Software Foundation{3} of the License, or
 * (at your option) any later version.
 *
 * This {1} is distributed in the hope that it will be useful,"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


@pytest.mark.parametrize(
    "text,want",
    [
        ("Some prose.\nLicensed under the Apache License, Version 2.0.\nMore.", "Apache-2.0"),
        ("prose without an end\nReleased under the MIT License.", "MIT"),
        ("This work is licensed\nunder the GNU General Public License,\nversion 3.", "GPL-3.0"),
        ("Licensed under CC BY-NC 4.0. Released under the MIT License.", "CC-BY-NC-4.0,MIT"),
        ("// SPDX-License-Identifier: BSD-3-Clause\ncode", "BSD-3-Clause"), ("SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("/* SPDX-License-Identifier:  GPL-2.0-or-later */", "GPL-2.0-or-later"), ("Licensed under the MIT License\nno full stop, more", "MIT"),
        (GPL.format("program", "program", "", "; either version 2"), "GPL-2.0-or-later"), (GPL.format("program", "program", "", ", either version 3").replace(";", ":", 1), "GPL-3.0-or-later"),
        (GPL.format("library", "library", "Lesser ", "; either version 2.1"), "LGPL-2.1-or-later"), (GPL.format("file", "file", "Affero ", ", either version 3").replace(";", ":", 1), "AGPL-3.0-or-later"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0"),
        (APACHE, "Apache-2.0"), ("Licensed under the MIT License\nand other words\n\n" + APACHE, "Apache-2.0,MIT"),
        ("a license to kill. under the sea.", ""),
        (None, ""), ("", ""),
    ],
)
def test_licenses(spark, text, want):
    got = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.licenses == want


def test_license_sequences(spark):
    by_id = {}
    for s, n in licenses.SENTENCES.items():
        by_id.setdefault(n, s)
    bsd = ". ".join(by_id[n].capitalize() for n in ("bsd-grant", "bsd-source", "bsd-binary")) + "."
    texts = [bsd, bsd + " " + by_id["bsd-endorse"].capitalize() + ".", ". ".join([by_id["bsd-source"], by_id["bsd-grant"], by_id["bsd-binary"]]) + "."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licenses for r in licenses.scan_licenses(df).orderBy("doc_id").collect()] == ["BSD-2-Clause", "BSD-3-Clause", ""]
    assert all(re.search(licenses.CUES, s) for s in licenses.dictionary())
    assert licenses.scan_licenses(edge_docs(spark)).count() == len(edge_rows()) and licenses.scan_licenses(no_docs(spark)).collect() == []


SLOW = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def slow_spans(text):
    out = []
    for kind, pattern in enumerate(SLOW):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(d) for d in digits[::-1][::2]]
            even = [sum(map(int, str(2 * int(d)))) for d in digits[::-1][1::2]]
            fine = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 13 <= len(digits) <= 19 and sum(odd + even) % 10 == 0, 9 <= len(digits) <= 15)
            if fine[kind]:
                out.append((kind, *m.span()))
    return out


def test_long_runs_of_zeros_are_addresses():
    zeros = "0" * 4301
    assert pii.base_spans(zeros + ".1.2.3") == [(1, 0, 4307)]
    assert pii.base_spans(f"{zeros}256.1.2.3 {zeros}.{zeros}.1.255") == [(1, 4311, 4311 + 2 * 4301 + 7)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1234567890..@@-+ ()%_\n,é٣") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == slow_spans(text), text
    for text in ("a" * 300 + "@x.y", "a" * 9000 + "@x.y.z@b.c", "x@y.z" + "b" * 700 + "@q.r", "1" * 3000 + ".2.3.4", "4111 1111-1111 1111"):
        assert pii.base_spans(text) == slow_spans(text)


def test_field_finds_held_out_spans():
    field = pii._field(400, 5)
    right = found = true = 0
    for text, spans in pii.examples(600, 99):
        got = set(field.spans(text))
        right, found, true = right + len(got & set(spans)), found + len(got), true + len(spans)
    assert right >= 0.95 * found and right >= 0.95 * true
    rng = random.Random(1)
    assert not any(field.spans(words(rng, 200) + ". In 1999, version 2.0, page 12.") for _ in range(20))


def test_decoding_is_the_best_segmentation():
    """The dynamic programme against all segmentations of short lines."""
    import numpy as np

    field = pii._field(400, 5)
    for text in ("call (415) 555-2671 now", "a 1.2.3.4, 5", "x@y.org 12-34"):
        units = [m.span() for m in pii.UNIT.finditer(text)]
        lower = [text[a:b].lower() for a, b in units]
        scores = {(i, j): np.array(pii.features(text, units, i, j, lower)) @ field.weights for i, j in pii.segments(text, units)}

        def best(t, y):
            if t == len(units):
                return 0.0, []
            options = [(field.moves[y, 0] + best(t + 1, 0)[0], best(t + 1, 0)[1])]
            for (i, j), s in scores.items():
                if i == t:
                    for k in range(len(pii.KINDS)):
                        rest = best(j + 1, k + 1)
                        options.append((field.moves[y, k + 1] + s[k] + rest[0], [(k, units[i][0], units[j][1]), *rest[1]]))
            return max(options, key=lambda o: o[0])

        assert field.decode(text, 0, len(text)) == best(0, 0)[1]


def test_decoding_in_blocks_and_windows_equals_one_pass():
    field = pii._field(400, 5)
    rng = random.Random(21)
    lines = [t for t, _ in pii.examples(300, 77)]
    for _ in range(60):
        text = ""
        for _ in range(rng.randint(1, 12)):
            text += rng.choice([rng.choice(lines), words(rng, rng.randint(1, 60)), "1 2 3 4 5 6 7 8 9 10 11 12 ", "(((", "+" * 9, "a@b " * 5]) + rng.choice([" ", "\n", ""])
        whole = field.decode(text, 0, len(text), 1 << 20)
        assert all(field.decode(text, 0, len(text), block) == whole for block in (1, 7, 64)) and field.spans(text) == whole


@pytest.mark.parametrize("size", [10, 50, 59, 60, 61, 200, 5000])
def test_long_secrets_and_addresses_are_whole(size):
    field = pii._field(400, 5)
    secret = "aB" * (size // 2) + "9"
    text = f'Some words first. api_key = "{secret}" and more.'
    assert (5, text.index(secret), text.index(secret) + len(secret)) in field.spans(text)
    mail = "a" * size + "@example.org"
    text = words(random.Random(1), 30) + " " + mail + " end"
    assert (0, text.index(mail), text.index(mail) + len(mail)) in pii.personal_spans(text, field)[1]


def test_many_numbers_need_little_memory():
    import tracemalloc

    field = pii._field(400, 5)
    text = " ".join(str(k % 977) for k in range(4_000))
    tracemalloc.start()
    field.spans(text)
    assert tracemalloc.get_traced_memory()[1] < 15_000_000
    tracemalloc.stop()


def test_pii_edges(spark):
    got = pii.find_personal_data(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows()) and all(r.base_spans == "" for r in got)
    df = spark.createDataFrame([(1, "mail me.1@mail.example.com or +1 (415) 555-2671, 4111111111111111 at 10.0.0.1")], "doc_id long, text string")
    r = pii.find_personal_data(df).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and set(r.base_spans.split(",")) <= set(r.spans.split(","))
    assert pii.find_personal_data(no_docs(spark)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies, yes, always, more</div><nav><a href=/>Home</a></nav>
<div id="content"><div class="post"><h1>Head &amp; line</h1><p>First, para, with text&nbsp;here and <a href=y>a link</a>, more.<div class="ad-slot">Buy!</div>
<p>Second<br>line.</p><ul><li>one<li>two</ul><form><input><p>Mail us</p></form></div>
<div class="sidebar"><p>Side, text, with, many, commas, in, it, indeed, long enough to be taken seriously by a scorer.</p></div>
<div id="comments"><p>Nice, article, really, I loved it, all of it, thanks.</p></div></div><footer>&copy; me</footer>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Head & line\nFirst, para, with text here and a link, more.\nSecond line.\none\ntwo"
    assert htmltext.main_text("<article><h1>A</h1><p><b>x<br><p>y &amp z</p></article><footer>f</footer>") == "A\nx\ny & z"
    assert htmltext.main_text("plain") == "plain" and htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<nav>x</nav>") == ""
    assert htmltext.main_text("<div>" * 20_000 + "deep") == "deep"


WRAPPERS = ["layout no-sidebar", "content-with-sidebar", "entry social", "legal-article", "print-view", "discussion-post", "post", "page has-comments"]
JUNK_PARTS = [
    "<div class='sidebar'><p>Side, a, b, c, with, commas, all, over.</p></div>", "<div id='comments'>{}</div>", "<ul class='related'><li><a href=a>One thing</a><li><a href=b>Other thing</a></ul>",
    "<div class='cookie-notice'><p>We use cookies, yes.</p></div>", "<div class='ad-slot'>Buy, now!</div>", "<nav><a href=/>Home</a></nav>", "<div role='alert'><p>Notice</p></div>",
    "<form><p>Mail us</p></form>", "<section class='share-buttons'><a href=x>Share</a></section>", "<div hidden><p>Hidden, text, here.</p></div>",
]


def test_planted_pages():
    """Articles in wrappers of many names, with junk before, after and between; all text of the article and nothing else comes out."""
    rng = random.Random(31)
    for _ in range(300):
        want, body = ["Title & more"], "<h1>Title &amp; more</h1>"
        for k in range(rng.randint(6, 14)):
            text = words(rng, rng.randint(12, 40)).capitalize() + ", and more."
            want.append(text)
            body += rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<blockquote><p>{}</p></blockquote>", "<section id='discussion'><p>{}</p></section>", "<div class='related-work'><p>{}</p></div>"]).format(text)
            if rng.random() < 0.2:
                body += rng.choice(JUNK_PARTS).format("".join(f"<p>{words(rng, 9)}, nice.</p>" for _ in range(rng.randint(1, 4))))
        # sections with doubtful names count as prose from a share of the page on
        page = f"<div class='{rng.choice(WRAPPERS)}'>{body}</div>"
        if rng.random() < 0.5:
            page = f"<div id='main-wrapper'>{page}</div>"
        sides = [rng.choice(JUNK_PARTS).format("<p>One, two, three comments.</p>") for _ in range(2)]
        html = f"<html><head><title>T</title></head><body>{sides[0]}{page}{sides[1]}<footer>f</footer></body></html>"
        assert htmltext.main_text(html).split("\n") == want, html


def test_many_comments_do_not_win():
    body = "<h1>T</h1>" + "".join(f"<p>Paragraph {k}, with words, in it.</p>" for k in range(4))
    html = f"<body><div class='post'>{body}</div><div class='comments'>" + "<p>I think, honestly, that, well, this, is, long.</p>" * 40 + "</div></body>"
    assert htmltext.main_text(html).count("\n") == 4 and "honestly" not in htmltext.main_text(html)


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (2000, 16_000):
        start = time.process_time()
        assert htmltext.main_text("<blockquote>some text, here " * n).count("\n") == n - 1
        took.append(time.process_time() - start)
    assert took[1] < 24 * max(took[0], 0.05)


def test_pages_edges(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "<p>" + "long, " * 50_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = htmltext.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 78), (1, 78), (2, 0), (3, 299_999)]
    assert htmltext.extract_pages(df.limit(0)).collect() == []


def slow_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_counts_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "#", "é ", "\n", "\x0b", "\xa0", "a b c "]) for _ in range(rng.randint(0, 60)))
        assert quality.text_counts(text)[:5] == slow_counts(text)


def test_learned_list_keeps_good_rows(spark):
    rng = random.Random(9)
    good = [(i, words(rng, 120) + ".", 1) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in words(rng, 120).split()), 0) for i in range(100)]
    docs = spark.createDataFrame([r[:2] for r in good + junk], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good[:200] + junk[:60]] + [(None, 1), (5, None), (99999, 0)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.judged(docs, labels).collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in junk)
    assert quality.fit(docs, labels.limit(0)) == [] and quality.accepts([]) is not None


def test_quality_edges(spark):
    labels = spark.createDataFrame([(5, 1), (1, 0)], "doc_id long, quality int")
    got = quality.judged(edge_docs(spark), labels).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got}
    assert by[5].kept and not by[2].kept and by[2].n_words == 0 and by[2**60 + 1].word_chars == 7
    assert quality.judged(no_docs(spark), labels).collect() == []
