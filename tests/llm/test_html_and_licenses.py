import random

import duckdb
import pytest

from emberfield.llm import html_text, licenses

ARTICLE = "<article><h1>Head &amp; tail</h1><p>First <b>bo</b>ld with <a href='x'>a link</a>.<p>Second&nbsp;para<br>after</article>"
TEXT = "Head & tail First bold with a link. Second para after"


@pytest.fixture(scope="module")
def weights():
    pages = [f"<html><head><title>t</title></head><body><div>outside words here</div>{ARTICLE}<div>more outside</div></body></html>"] * 30
    counts = sum((html_text.label_counts(p) for p in pages), start=html_text.Counter())
    return html_text.weights_of(counts)


@pytest.mark.parametrize(
    "page",
    [
        ARTICLE,
        f"<nav><ul><li><a>menu</a></ul></nav>{ARTICLE}<footer>&copy; foot</footer>",
        f"<script>var t='</p>';if(a<b){{}}</script><style>p>a{{}}</style><!-- no <p>text --> {ARTICLE}",
        ARTICLE.replace("<p>Second", "<div class='ad-box'>Buy <b>this</b></div><aside>side</aside><form><label>f</label><input></form><p>Second"),
        f"<header><h1>Site</h1></header><main>{ARTICLE}</main><section id=comments><p>{'I think so too. ' * 30}</section>",
        f"<div class=cookie-notice>{'accept all of this ' * 20}</div>{ARTICLE.removesuffix('</article>')}",
    ],
)
def test_article_text(page, weights):
    assert html_text.main_text(page, weights) == TEXT


def test_best_region_without_labels(weights):
    body = "".join(f"<p>{'real words of the story ' * 6}</p>" for _ in range(4))
    page = f"<div><div><div>x</div></div></div><div>y</div>{body}<div></div><div>z</div>"
    assert html_text.main_text(page, weights) == " ".join(["real words of the story"] * 24)


def test_fit_and_extract(spark):
    pages = spark.createDataFrame([(i, "u", ARTICLE) for i in range(40)], "page_id long, url string, html string")
    rows = html_text.extract(pages, html_text.fit(pages)).collect()
    assert {(r["text"], r["n_chars"]) for r in rows} == {(TEXT, len(TEXT))}


def test_license_rules(docs_of):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    mit = [s for i, s in licenses.SENTENCES if i in ("mit-grant", "mit-condition")]
    texts = [f"Story.\nReleased under the MIT License.\n{gpl}", "\n".join(mit), f"{gpl} or (at your option) any later version.", "LICENSED UNDER CC BY-NC 4.0!", "the license of poets", None, mit[0].replace("software", "software\n")]
    got = {r["doc_id"]: (r["licenses"], r["license_class"]) for r in licenses.scan(docs_of(texts)).collect()}
    assert got == {0: ("GPL-3.0-only,MIT", "copyleft"), 1: ("MIT", "permissive"), 2: ("GPL-3.0-or-later", "copyleft"), 3: ("CC-BY-NC-4.0", "restricted"), 4: ("", "none"), 5: ("", "none"), 6: ("MIT", "permissive")}


GPL_NOTICE = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""


def test_every_sentence_and_rule_fires(docs_of):
    forms = [lambda s: s, lambda s: f"Story\x01 goes. {s} More of it."]
    texts = [(i, form(s)) for i, s in licenses.SENTENCES for form in forms]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of([t for _, t in texts])).collect()}
    assert [(got[k]["sentence_ids"], got[k]["n_sentences"]) for k in range(len(texts))] == [(i, 1) for i, _ in texts]
    sentence = {i: s for i, s in reversed(licenses.SENTENCES)}
    rules = licenses.scan(docs_of(["\n".join(sentence[i] for i in seq) for _, _, seq in licenses.RULES])).collect()
    assert [(r["licenses"], r["license_class"]) for r in sorted(rules)] == [(name, kind) for name, kind, _ in licenses.RULES]


def test_wrapped_notices(docs_of):
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed"
    texts = [GPL_NOTICE, "\n".join("# " + x.strip() for x in GPL_NOTICE.split("\n")), mpl, "not released under the MIT License.", "Released under the MIT License. Or not"]
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.scan(docs_of(texts)).collect()}
    gpl = ("gpl-header,gpl-warranty", "GPL-3.0-or-later")
    assert got == {0: gpl, 1: gpl, 2: ("mpl2-notice", "MPL-2.0"), 3: ("", ""), 4: ("mit-notice", "MIT")}


@pytest.mark.parametrize("gap", ["  ", "\n", "\r\n * ", "\n// "])
def test_sentences_with_any_gap_between_words(docs_of, gap):
    texts = [gap + s.replace(" ", gap) for _, s in licenses.SENTENCES]
    got = licenses.scan(docs_of(texts)).collect()
    assert [r["sentence_ids"] for r in sorted(got)] == [i for i, _ in licenses.SENTENCES]


@pytest.mark.parametrize(
    "page",
    [
        *[f"<div class='{c}'><div>x</div>{ARTICLE}</div>" for c in ("page has-sidebar", "with-navbar", "no-ads", "sidebar", "page-widgets")],
        f"<section id='discussion'>{ARTICLE}<div class=ad>Buy this</div></section>",
        f"<main><div class='widget'>{ARTICLE}<div class=related><article>t</article></div></div></main>",
        f"<form action=x>{ARTICLE}</form>",
        f"<body><nav><a>menu</a>{ARTICLE}</body>",
        f"<div><div class='ad'>Buy this<main>{ARTICLE}</main></div><footer>foot",
        f"<head><title>t</title><body>{ARTICLE}",
        ARTICLE.replace("<h1>", "<div class=toc-entry><h1>").replace("after<", "after</div><"),
        ARTICLE.replace("<p>Second", "<div class='ad'>Buy this<p>Second"),
        ARTICLE.replace("<p>Second", "<p class='ad'>Buy this<p>Second"),
    ],
)
def test_boilerplate_names_and_open_ends_keep_the_article(page, weights):
    assert html_text.main_text(page, weights) == TEXT


def test_teasers_and_comments_as_articles_stay_out(weights):
    story = "real words of the story " * 6
    for rest in ("<div class=sidebar><article>a teaser</article></div>", "<section id=comments><article>one reply</article></section>"):
        assert html_text.main_text(f"<div><p>{story}</p></div>{rest}", weights) == story.strip()
        assert html_text.main_text(f"<main><p>{story}</p>{rest}</main>", weights) == story.strip()
    assert html_text.main_text(f"<div class='legal'><p>{story}</p></div><div>z</div>", weights).startswith(story.strip())


def test_best_run_is_the_maximum_of_all_runs():
    r = random.Random(5)
    weights = {"#word": 0.5, "p": -0.7, "/p": -0.3, "b": -0.05, "div": -2.0}
    for _ in range(300):
        seen = [(k, "", False) if (k := r.choice(["p", "/p", "b", "div", "em", "section", ""])) else ("", " w" * r.randrange(6), r.random() < 0.2) for _ in range(r.randrange(14))]

        def score(part):
            return sum(0.0 if out else (weights.get(k, html_text.UNSEEN_INLINE if html_text.inline(k) else html_text.UNSEEN_BLOCK) if k else 0.5 * len(t.split())) for k, t, out in part)

        start, end = html_text.best_run(seen, weights)
        assert score(seen[start:end]) == pytest.approx(max(score(seen[i:j]) for i in range(len(seen) + 1) for j in range(i, len(seen) + 1)))


def test_the_run_decides_where_a_label_has_no_text(weights):
    story = "real words of the story " * 6
    assert html_text.main_text(f"<article></article><p>{story}</p>", weights) == story.strip()
    assert html_text.main_text(ARTICLE.replace("article>", "div>"), weights) == TEXT  # the same without the label


def test_bsd_notice_with_all_rights_reserved(docs_of):
    known = dict((i, s) for i, s in reversed(licenses.SENTENCES))
    bsd = "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n" + "\n".join(known[i] for i in ("bsd-grant", "bsd-source", "bsd-binary"))
    texts = [bsd, "All rights reserved.", "All rights reserved. All rights reserved. Licensed under CC BY 4.0."]
    got = {r["doc_id"]: (r["licenses"], r["license_class"]) for r in licenses.scan(docs_of(texts)).collect()}
    assert got == {0: ("BSD-2-Clause", "permissive"), 1: ("LicenseRef-All-Rights-Reserved", "restricted"), 2: ("CC-BY-4.0", "permissive")}


def test_twin_agrees_on_wrapped_notices(docs_of):
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed"
    commented = "\n".join("# " + x.strip() for x in GPL_NOTICE.split("\n"))
    known = [s for _, s in licenses.SENTENCES]
    docs = docs_of([GPL_NOTICE, commented, mpl, " ".join(known), "\n".join(known), "not " + known[0], "All rights\nreserved.", None, "", *known])
    want = sorted(map(tuple, licenses.scan(docs).collect()))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = con.execute(f"SELECT doc_id, n_sentences, sentence_ids, licenses, license_class FROM ({licenses.LICENSES_SQL})").fetchall()
    assert sorted(got) == want


def test_label_is_kept_to_its_ends():
    heavy = {"#word": 0.3, "p": -12.0, "/p": -12.0, "h1": -12.0, "/h1": -12.0, "div": -12.0, "/div": -12.0}
    story = "real words of the story " * 40
    page = f"<div>x</div><article><h1>A head</h1><p>{story}</p><div>A line</div><p>The end.</p></article><p>{story}</p>"
    assert html_text.main_text(page, heavy) == f"A head {story}A line The end."
