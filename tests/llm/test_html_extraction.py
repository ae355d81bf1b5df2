import html
import itertools
import random
import re
import time
from collections import Counter

import pytest

from tessera.llm import html_extraction as H

from .html_layouts import LAYOUTS

W = H.default_weights()


def article(page):
    """What a plain reading of the test pages gives: the blocks of their only article element."""
    own = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", own)]
    return "\n\n".join(x for x in parts if x)


def test_pages_of_the_test_data(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in rows.collect()}
    out = H.extract_pages(rows.withColumn("text", rows.url)).collect()
    assert {r.page_id: r.text for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out)


def test_region_is_the_best_of_all():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-2, -1, -0.5, 0.5, 1, 3]) for _ in range(rng.randrange(0, 9))]
        i, j = H.best_region(s)
        most = max([0.0, *(sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2))])
        assert abs(sum(s[i:j]) - most) < 1e-9


def test_layouts():
    page = """<html><head><title>x</title><style>p{}</style></head><body><div id=top class='site-header'><h2>Site</h2></div>
    <div class='menu'><ul><li><a>Home</a><li><a>About</a></ul></div><div class='content'><h1>My title</h1><p>One &amp; two&nbsp;three<br>four <i>fi</i>ve.
    <p>Second para &lt;b&gt; is here &#8212; long enough.<div class='ad-box'>Buy now</div><p>Third.</p></div>
    <div class='sidebar'><p>Related stuff here to read now</p></div><div id='comments'><h3>Comments</h3><p>I liked this article so much, thanks for writing it all.</p></div>
    <div class=footer>(c) 2020</div></body>"""
    assert H.extract(page, W) == "My title\n\nOne & two three four five.\n\nSecond para <b> is here — long enough.\n\nThird."
    page = "<article><h1>T</h1><p>Text here &copy; 2020 <script>x<y</script>more</p><aside>note</aside><section class='comments'><h3>Say</h3><p>first!</p></section><form><p>mail</p></form><p hidden>no</p><footer>foot</footer></article>"
    assert H.extract(page, W) == "T\n\nText here © 2020 more"
    page = "<main><h1>Big</h1><div class='cookie-notice'>We use cookies on this site</div><p>Body text of main.</p><ul><li>one thing</li><li><a>two</a> thing</li></ul></main>"
    assert H.extract(page, W) == "Big\n\nBody text of main.\n\none thing\n\ntwo thing"


def test_broken_and_empty(spark):
    assert H.extract("just text, no markup", W) == "just text, no markup"
    assert H.extract("<p>unclosed <b>bold <p>next <div>deep <!-- c --> x</div> <a href=\"a>b\">link</a> tail < 5 & more", W) == "unclosed bold\n\nnext\n\ndeep x\n\nlink tail < 5 & more"
    for page in (None, "", "<", "<!--", "<p", "<script>x", "<nav>a b</nav>", "<div class=\"", "</p></div>", "<a '" * 2000):
        assert isinstance(H.extract(page, W), str)
    assert H.extract("<nav>menu words here</nav><footer>small print</footer>", W) == ""
    deep = "<div>" * 900 + "text of it" + "</div>" * 900
    assert H.extract(deep, W) == "text of it"
    long = "<article>" + "<p>some words in a row</p>" * 20_000 + "</article>"
    assert H.extract(long, W).count("\n\n") == 19_999
    rows = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "u", "<p>x y</p>", "b")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, H.extract_pages(rows).collect()), key=str) == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "x y", 3)], key=str)
    assert H.extract_pages(rows.limit(0)).collect() == []


def accuracy(complete):
    """Precision and recall in words, by layout that the weights weren't fitted to."""
    out = {}
    for name, page in LAYOUTS.items():
        want = Counter(w for b in H.blocks(page, labelled=True) if b.main for w in b.text.split())
        got = Counter(H.extract(re.sub("</?x-main>", "", page), W, complete).split())
        both = sum((want & got).values())
        out[name] = both / max(1, sum(got.values())), both / sum(want.values())
    return out


def test_accuracy_on_other_layouts():
    whole, region = accuracy(True), accuracy(False)
    mean = lambda found, k: sum(x[k] for x in found.values()) / len(found)
    print(whole, mean(whole, 0), mean(whole, 1), mean(region, 0), mean(region, 1))
    assert mean(whole, 0) > 0.95 and mean(whole, 1) > 0.95
    # why the region is completed to its element
    assert mean(region, 1) < mean(whole, 1)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div>" * 100_000 + "text of it" + "</div>" * 100_000, "text of it"),
        ("text before<p>and " + "<a " * 350_000, "text before\n\nand"),
        ("</p></div>" * 100_000 + "text of it", "text of it"),
        ("<div><a '>" * 100_000, ""),
        ("<p>" + "<span>" * 50_000 + "<p>ab" * 50_000, "\n\n".join(["ab"] * 50_000)),
        ("<li><div>" + "<span>" * 20_000 + "<li>ab" * 20_000, "ab" * 20_000),
    ],
)
def test_time_is_in_proportion_to_length(page, text):
    start = time.perf_counter()
    assert re.sub(r"\s", "", H.extract(page, W)) == re.sub(r"\s", "", text)
    assert time.perf_counter() - start < 10


def test_marks_count_in_labelled_pages_only():
    page = "<article><p>some words that stay</p><x-main class='sidebar'><p>and these inside of an unknown element</p></x-main></article>"
    assert "and these" not in H.extract(page, W) and [b.main for b in H.blocks(page, labelled=True)] == [False, True]


def test_tags():
    read = lambda page: [page[a:b] for a, b in _all_tags(page)]
    assert read("a<b>c</b>") == ["<b>", "</b>"]
    assert read("""<a title="x>y" href='>'>t<!-- <b> --><i>""") == ["""<a title="x>y" href='>'>""", "<!-- <b> -->", "<i>"]
    assert read("""<p id="never closed>text<b>x</b>""") == ["""<p id="never closed>""", "<b>", "</b>"]
    assert read("1 < 2 <!doctype html><?xml?> <3") == ["<!doctype html>", "<?xml?>"]


def _all_tags(page):
    at = 0
    while found := H.next_tag(page, at):
        yield found[0], found[1]
        at = found[1]
