import itertools
import random
import time
from html.parser import HTMLParser

import pytest

import corpus_pipeline
from gleiswerk.llm import html_extract, license_scan
from gleiswerk.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def page(article, i=0, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';x({i});</script></head><body><header><h1>Site name</h1></header><nav><ul><li><a href='/a'>Menu {i}</a></li></ul></nav>"
        f"<!-- c --><div class='ad'>Buy now {i}</div><div class=\"cookie-notice\">We use cookies</div><aside>Side {i}</aside>{article}<section class='comments'><p>Nice post {i}</p></section><form><input value=x>Search</form>{extra}<footer>&copy; host</footer></body></html>"
    )


def test_extract_article():
    html = page("<article><h1>A  title &amp; more</h1><p><b>Bold</b>ly\n\n said<br>next<p>Second&nbsp;one <i>x</i>y</article>")
    assert html_extract.extract(html, None) == "A title & more Boldly said next Second one xy"


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<div><script>if(a<b){}</script>x</div>", "x"), ("<p>1 < 2 &lt; 3", "1 < 2 < 3"), ("<!-- open", ""), ("<article>a<ul><li>b<li>c</ul></article>", "a b c"),
    ("<body><nav>menu</nav><div>text</div><footer>f</footer>", "text"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<article><p>x</p><aside>no</aside><nav>no</nav></article>", "x"), ("<p title='a>b'>c</p>", "c"),
])
def test_extract_cases(html, want):
    assert html_extract.extract(html, None) == want


def test_wrapper_drops_constants_of_the_template():
    pages = [page(f"<div class='body'><article><div class='share-hint'>no</div><section>Subscribe to us today</section><p>Words of page {i}</p></article></div>", i) for i in range(8)]
    wrapper = html_extract.induce(pages)
    assert wrapper["article"][0].endswith("article")
    assert html_extract.extract(pages[3], wrapper) == "Words of page 3"
    # a few copies of one page prove nothing
    same = html_extract.induce([pages[0]] * 8)
    assert "Words of page 0" in html_extract.extract(pages[0], same)


def test_simple_tree_matching():
    a, b = (html_extract.Reduced([html_extract.parse(x)], "") for x in ("<div><h1>x</h1><p>a</p><ul></ul></div>", "<div><p>b</p><table></table><ul></ul></div>"))
    n, pairs = html_extract.matching(a, b)
    assert n == 4 and [x.sign for x, _ in pairs] == ["#root", "div", "ul", "p"]


def test_alignment_by_brute_force():
    """The most pairs, against every way to pair the children."""

    def most(a, b):
        if a.sign != b.sign:
            return 0
        xs, ys = a.children, b.children
        best = 0
        for k in range(min(len(xs), len(ys)) + 1):
            for left in itertools.combinations(xs, k):
                for right in itertools.combinations(ys, k):
                    best = max(best, sum(most(x, y) for x, y in zip(left, right, strict=True)))
        return best + 1

    rng = random.Random(3)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth and t == 'div' else rng.choice('ab')}</{t}>" for t in (rng.choice(["div", "table", "h1", "ul"]) for _ in range(rng.randrange(4))))

    for _ in range(60):
        a, b = (html_extract.Reduced([html_extract.parse(tree(2))], "") for _ in range(2))
        n, pairs = html_extract.matching(a, b)
        assert n == most(a, b) == len(pairs) and all(x.sign == y.sign for x, y in pairs)
        few, paired = html_extract.matching(a, b, [0])  # no room for tables
        assert few == len(paired) <= n and all(x.sign == y.sign for x, y in paired)


def test_many_siblings_are_aligned_soon():
    pages = [f"<div>{''.join(f'<h2>H{i}</h2><p>P{i} {k}</p>' for i in range(1500))}</div>" for k in range(3)]
    began = time.process_time()
    html_extract.induce(pages)
    assert time.process_time() - began < 5


def test_any_depth_loses_nothing():
    inner = lambda n: "<div>" * n + "in" + "</div>" * n
    for n in (200, 20_000):
        assert html_extract.extract(f'<div class="page"><article>{inner(n)}<p>After</p></article><nav>no</nav></div>', None) == "in After"
        assert html_extract.extract(f"{'<div>' * n}<nav>Menu one</nav>{'</div>' * n}<p>Text</p>", None) == "Text"
    assert html_extract.extract(inner(5000) + "<p>y</p>", html_extract.induce([inner(5000) + "<p>y</p>", inner(5000) + "<p>z</p>"])) == "in y"


@pytest.mark.parametrize(("name", "is_boilerplate"), [
    ("comments", True), ("userComments", True), ("cookiebar", True), ("site-footer", True), ("main_nav", True), ("adSlot", True), ("comment-list", True), ("relatedPosts", True), ("NAV", True),
    ("social-history", False), ("search-algorithms", False), ("notice-board", False), ("article-header", False), ("main-content", False), ("load", False), ("shadow", False), ("navigator", False), ("", False),
])
def test_names(name, is_boilerplate):
    assert html_extract.tells(name) == is_boilerplate


def test_ids_of_headings_and_sections_stay():
    html = '<article><h2 id="social-history">A</h2><h2 id="comments">B</h2><section id="related-work">C</section><p class="notice-board">D</p><div class="userComments">x</div><div class="cookiebar">y</div><section id="comments">z</section></article>'
    assert html_extract.extract(html, None) == "A B C D"


def test_varying_slot_is_the_article_without_such_an_element():
    body = lambda k: f'<ul><li><a href="/{k}">Link {k} of the menu</a></li><li><a href="/b{k}">More {k * 7}</a></li></ul><h1>Title {k}</h1><div class="c"><p>Body text number {k} that goes on for a while.</p><h2>Part {k}</h2><p>And {k + 1} more.</p></div><div>Visitors {k * 13}</div>'
    pages = [f"<body>{body(k)}</body>" for k in range(12)]
    wrapper = html_extract.induce(pages)
    assert wrapper["article"] == ["/body/h1", "/body/div.c"]
    assert html_extract.extract(pages[3], wrapper) == "Title 3 Body text number 3 that goes on for a while. Part 3 And 4 more."


def test_constants_of_a_few_pages():
    pages = [f"<body><div>Home Products About</div><p>Story {k} of the day</p><div>Copyright Company</div></body>" for k in range(4)]
    assert html_extract.extract(pages[2], html_extract.induce(pages)) == "Story 2 of the day"


def test_wrappers_count_all_pages(spark):
    """A line of the article that one page of sixty has otherwise is no constant of the template, whichever page that is."""
    page = "<html><body><nav>Menu</nav><article><p class='fee'>{}</p><p>Story {} of this site</p></article></body></html>"
    for odd in (3, 31, 58):
        fees = ["Five euros" if i == odd else "Free entry" for i in range(60)]
        rows = [(i, f"http://a.example/{i}", page.format(fee, i)) for i, fee in enumerate(fees)]
        found = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
        assert {r.page_id: r.text for r in found.collect()} == {i: f"{fee} Story {i} of this site" for i, fee in enumerate(fees)}


class PlainText(HTMLParser):
    """The text of a page's article, read by another parser."""

    def __init__(self):
        super().__init__()
        self.out, self.inside, self.skip = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("aside", "nav", "form", "script", "style", "footer", "button")
        if tag not in ("b", "i", "a", "em", "strong", "span", "code", "u"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("aside", "nav", "form", "script", "style", "footer", "button")
        if tag not in ("b", "i", "a", "em", "strong", "span", "code", "u"):
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.out.append(data)


def test_pages(spark):
    got = QUERIES["op6_html_extract"](spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        plain = PlainText()
        plain.feed(pages[r.page_id].html)
        assert r.text == " ".join("".join(plain.out).split())
        assert r.n_chars == len(r.text) and r.text


def test_pages_odd(spark, monkeypatch):
    rows = [(1, None, None, "x"), (2, "http://h/a", "", "x"), (3, "http://h/a", "<p>t" * 2000, "x"), (3, "http://h/a", "<p>t" * 2000, "x"), (4, "no url", "<article>x</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumnRenamed("host", "wrapper")
    want = [(1, ""), (2, ""), (3, " ".join(["t"] * 2000)), (3, " ".join(["t"] * 2000)), (4, "x")]
    assert sorted((r.page_id, r.text) for r in html_extract.main_text(df).collect()) == want
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)  # the other way
    assert sorted((r.page_id, r.text) for r in html_extract.main_text(df).collect()) == want
    assert html_extract.main_text(df.where("false")).count() == 0


# -- licences -----------------------------------------------------------------------------


def test_licences_and_inheritance(spark):
    apache, mit = license_scan.TEMPLATES["Apache-2.0"][0], license_scan.TEMPLATES["MIT"][0]
    long = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.py", long), (3, "a/b/LICENSE.txt", f"{apache}\n{long}"), (4, "a/z.py", long), (5, "a/b/own.py", f"# {license_scan.TEMPLATES['GPL-3.0'][0]}\n{long}"),
        (6, "q/x.py", long), (7, None, mit), (8, "a/b/c/d/y", None), (9, "a/b/c/d/y", ""), (9, "a/b/c/d/y", ""), (10, "top.txt", long + "\n" + "licensed words but no template at all"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'x' as dir", "'y' as licence")
    got = {r.doc_id: r for r in license_scan.with_inherited(license_scan.declared(df)).collect()}
    assert {k: r.licence for k, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "MIT", 5: "GPL-3.0", 6: None, 7: "MIT", 8: "Apache-2.0", 9: "Apache-2.0", 10: None}
    assert got[2].inherited_from == "a/b" and got[4].inherited_from == "a" and got[1].licence_file and not got[5].licence_file


def test_licences_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    found = {r.doc_id: r.declared for r in QUERIES["op4_license_scan"](spark, "/root/testdata/sf0.01").collect()}
    short = {name: group[0] for name, group in license_scan.TEMPLATES.items() if name in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0")}
    for r in rows:
        want = {n for n, x in short.items() if x in r.text.split("\n")}
        assert (found[r.doc_id] in want) if want else found[r.doc_id] is None


GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(("text", "want"), [
    (f"This library is free software; {GNU.format('Lesser General Public License', ';', '2.1')}", "LGPL-2.1"),
    (f"This program is free software; {GNU.format('General Public License', ';', '2')}", "GPL-2.0-or-later"),
    (f"This program is free software: {GNU.format('General Public License', ',', '3')}", "GPL-3.0"),
    (f"This program is free software: {GNU.format('Affero General Public License', ',', '3')}", "AGPL-3.0"),
    ("BSD 2-Clause", "BSD-2-Clause"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("Licensed under the ISC License", "ISC"),
    ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY 3.0.", None), ("Licensed under the GNU General Public License, version 1", None),
    ("Licensed under the Apache License, Version 1.1.", None), ("Released under the MIT License.", "MIT"), ("no licence at all", None),
])
def test_siblings_are_told_apart(text, want):
    found = license_scan.Templates(1000, {})
    assert found.best(text)[0] == want
    wrapped = "\n# ".join(text.replace("-", " ").split()) if "SPDX" not in text else text
    assert found.best(f"# {wrapped}")[0] == want


def test_blank_lines_make_no_difference_to_a_licence_file(spark):
    rows = [(1, "a/COPY", "Licensed under the MIT License." + "\n" * 5000), (2, "a/b.py", "x")]
    got = {r.doc_id: r for r in license_scan.with_inherited(license_scan.declared(spark.createDataFrame(rows, "doc_id long, path string, text string"))).collect()}
    assert got[1].licence_file and got[2].licence == "MIT"


def test_licences_empty(none):
    assert license_scan.with_inherited(license_scan.declared(license_scan.document_paths(none))).count() == 0


# -- the pipeline ----------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = corpus_pipeline.materialize(stage(spark, now, SF), "stage")
        if k < 4:
            assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes[0] > sizes[1] >= sizes[2] > 0 and sizes[3] <= sizes[2] and sizes[4] == sizes[3]
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_by_brute_force(spark):
    """Stages two to four against plain Python, each on its own input."""
    from test_line_dedup import brute
    from test_suffix_jaccard import brute_components, brute_spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.materialize(stages["line_dedup"](spark, docs, SF), "stage")
    before = [(r.doc_id, r.text) for r in docs.collect()]
    after = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert len(after) == len(before) and all(after[d][1] == len(after[d][0]) for d in after)
    import hashlib

    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, (t, _) in after.items()} == {x[0]: x[3] for x in brute(before)}
    first = corpus_pipeline.materialize(stages["near_duplicates"](spark, kept, SF), "stage")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in first.collect()) == sorted(d for d, _, c in brute_components(rows) if c == d)
    cut = stages["repeated_passages"](spark, first, SF).collect()
    want = {x[0]: x[4] for x in brute_spans([(r.doc_id, r.text) for r in first.collect()])}
    same = sum(hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] for r in cut)
    assert len(cut) == len(want) and same >= 0.9 * len(cut)  # cut characters are left out of texts


def test_pipeline_odd(spark, odd, none):
    for df in (none, odd):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, SF)
            assert k == 4 or out.columns == df.columns
            out.count()


def brute_best(own, text):
    """The best cosine of every run of lines with every template, by whole vectors."""
    import math
    from collections import Counter

    def vector(words):
        weights = {t: n * own.idf.get(t, own.unseen) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / norm for t, w in weights.items()}

    lines = [x for line in text.split("\n") if (x := license_scan.terms(line))]
    best = (0.0, None)
    for name in sorted(license_scan.TEMPLATES):
        for x in license_scan.TEMPLATES[name]:
            words = license_scan.terms(x)
            v = vector(words)
            for i in range(len(lines)):
                for j in range(i + 1, min(len(lines), i + len(words)) + 1):
                    run = [t for y in lines[i:j] for t in y]
                    telling = {t for t in words if t[0].isdigit() or t in license_scan.NAMING}
                    if not telling <= set(run) or (license_scan.SIBLINGS - telling) & set(run):
                        continue
                    w = vector(run)
                    score = sum(a * w.get(t, 0.0) for t, a in v.items())
                    if score >= license_scan.MIN_SCORE and score > best[0] + 1e-9:
                        best = (score, name)
    return best


def test_best_equals_brute_force():
    import random

    rng = random.Random(2)
    own = license_scan.Templates(1000, {"the": 900, "of": 800, "a": 700, "this": 500, "work": 90, "or": 300, "to": 600})
    templates = [x for group in license_scan.TEMPLATES.values() for x in group]
    for k in range(60):
        words = license_scan.terms(rng.choice(templates)) * rng.choice([1, 1, 1, 20])
        words = [w for w in words if rng.random() > rng.choice([0, 0.1, 0.4])]
        for _ in range(rng.randint(0, 8)):
            words.insert(rng.randint(0, len(words)), rng.choice(["the", "of", "noise", "this", "x9"]))
        width = rng.choice([1, 3, 8, 1000])
        text = "\n".join(["a line of the work", *(" ".join(words[i : i + width]) for i in range(0, len(words), width)), "the end"])
        score, name = brute_best(own, text)
        got = own.best(text)
        assert abs(got[1] - score) < 1e-9 and (got[0] is None) == (name is None), (k, text, got, score, name)


def test_headers_wrapped_and_repeated():
    own = license_scan.Templates(1000, {})
    mit = license_scan.TEMPLATES["MIT"][2]
    assert own.best(" ".join([mit] * 20))[:1] == ("MIT",)
    words = mit.split()
    assert own.best("\n".join(" ".join(words[i : i + 3]) for i in range(0, len(words), 3)))[0] == "MIT"
    assert own.best("x\nLicensed under CC BY-SA 4.0.\ny")[0] == "CC-BY-SA-4.0"


def test_attributes_and_nesting():
    page = lambda x: html_extract.extract(f"<html><body>{x}</body></html>", None)
    assert page('<p>Read <a href="/p?id=ad-5">the report</a> now</p>') == "Read the report now"
    assert page('<p data-id="comment-3">Body text</p><p class="menu">x</p>') == "Body text"
    assert page("<div>" * 100_000 + "deep" + "</div>" * 100_000) == "deep"
