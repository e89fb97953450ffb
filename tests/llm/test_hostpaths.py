import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import hostpaths

ART = "Running text of the article, long enough to count. " * 10
one = lambda html: hostpaths.extract_page(html, [], [])


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>hello</p><a" + ' x="a"' * 100, "hello"),
        ("<p>hello</p><a " + '"' * 100_000, "hello"),
        ("<p>hello</p>" + '<a x="y ' * 100_000, "hello"),
        ("<p>hello</p>" + "<a x=\"y'> " * 100_000, "hello"),
        ("<div>" * 100_000 + "deep", "deep"),
        ("<div>" * 100_000 + "deep" + "</div>" * 100_000, "deep"),
        ("<ul><li>" * 50_000 + "deep", "deep"),
        ("word " * 2_000_000, ("word " * 2_000_000).strip()),
        ("<" * 200_000, "<" * 200_000),
        ("<p>x</p>" + "<!-- " * 200_000, "x"),
        ("<p>x</p><script>" + "<p>y</p>" * 1000, "x"),
    ],
)
def test_broken_pages_take_linear_time(html, text):
    start = time.time()
    assert one(html) == text
    assert time.time() - start < 30


def test_ten_megabytes():
    assert one("<article>" + "<p>word another word</p>" * 450_000 + "</article>") == "\n".join(["word another word"] * 450_000)


@pytest.mark.parametrize("name", ["related-work", "notice-of-intent", "code share", "with-sidebar", "post-header"])
def test_sections_of_an_article_stay(name):
    assert one(f"<article><p>{ART}</p><section class='{name}'><p>{ART}</p></section><p class=comment>x</p></article>").count("Running") == 20


@pytest.mark.parametrize("name", ["comments", "cookie-notice", "site-footer", "ad banner-300", "werbung", "Kommentare", "sidebar left", "postFooter"])
def test_what_is_named_otherwise_goes(name):
    assert one(f"<body><div class=story><p>{ART}</p><div class='{name}'>bad</div></div>") == ART.strip()


def test_inside_a_line():
    assert one("<p>a <span hidden>no <span>no</span> no</span>b <i style='display: none'>no</i>c<b hidden>d</p><p>e") == "a b c\ne"
    assert one("<p>x&nbsp;&lt;&#65;&amp;amp; <a title='a > b'>y</a>\n\n z<br>w") == "x <A&amp; y z\nw"


def test_headline_and_lead_outside_the_body_stay():
    assert one(f"<body><div class=x><h1>Head</h1><p>lead</p><div class=b><p>{ART}</p></div></div><footer>f</footer>") == f"Head\nlead\n{ART.strip()}"
    assert one(f"<body><form id=page><div class=a><p>{ART}</p></div></form>") == ART.strip()


def test_consensus(spark):
    """Votes against plain counting; what repeats over a host goes, whatever its name; a second template keeps to its own path."""
    page = lambda i, cls, more: f"<body><div class='{cls}'><p>{ART}{i}</p><div class=zzz>Folgen Sie uns</div><div class=fig>picture {i}</div></div>{more}"
    rows = [(i, f"http://a.de/{i}", page(i, "text", "<div class=yyy>Impressum</div>")) for i in range(8)]
    rows += [(10 + i, f"http://a.de/x{i}", page(i, "other", "<div class=text><p>box</p></div>")) for i in range(4)]
    rows += [(20, "http://a.de/0", rows[0][2]), (21, "http://b.de/", page(1, "text", "")), (22, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = defaultdict(lambda: [set(), Counter(), 0])
    for host, html in {(r[1].split("/")[2] if r[1] else "", r[2]) for r in rows}:
        for _, path, digest, vote, _ in hostpaths.shapes(html):
            w = want[host, path]
            w[0].add(html)
            w[1][digest] += 1
            w[2] += vote
    got = {(r["host"], r["path"]): (r["pages"], r["kinds"], r["votes"]) for r in hostpaths.votes(pages).collect()}
    assert got == {k: (len(a), len(b), c) for k, (a, b, c) in want.items()}
    text = {r["page_id"]: r["text"] for r in hostpaths.extract(pages.withColumn("paths", F.lit(1))).collect()}
    for i in range(8):
        assert text[i] == f"{ART}{i}\npicture {i}"
    for i in range(4):
        assert text[10 + i] == f"{ART}{i}\npicture {i}"
    assert text[20] == text[0] and "Folgen" in text[21] and text[22] == ""
    old = hostpaths.BROADCAST_PATHS
    try:
        hostpaths.BROADCAST_PATHS = 0
        assert {r["page_id"]: r["text"] for r in hostpaths.extract(pages).collect()} == text
    finally:
        hostpaths.BROADCAST_PATHS = old


def test_all_voted_paths_of_a_host_are_tried(spark):
    page = lambda k, n, more="": f"<body><div class='k{chr(97 + k)}'><p>{ART}{n}</p></div><div class=z><p>{more}</p></div>"
    rows = [(k * 10 + n, "//h/", page(k, n)) for k in range(9) for n in range(2 + (k < 4))] + [(99, "//h/", page(8, 9, ART * 9))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in hostpaths.extract(pages).collect()}[80] == f"{ART}0"
    assert len(hostpaths.winners(hostpaths.votes(pages)).first()["paths"]) == 9
