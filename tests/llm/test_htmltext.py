"""Main text of pages: hand-made templates, a brute-force region, and pages as text in text out."""

import random

from revlume.llm import htmltext

SCHEMA = "page_id long, url string, html string, text string, kind int"
P1 = "First paragraph of the article with some <b>bold</b> words, a <a href='/x'>link</a> and &amp; references &lt;here&gt;."
P2 = "Second paragraph that goes on for quite a while, as paragraphs of articles are used to do, and ends here."
T1, T2 = "First paragraph of the article with some bold words, a link and & references <here>.", P2
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">All news of the day</a></li></ul></nav>'
SIDE = '<div class="sidebar"><h3>Most read stories of this week</h3><p>Another text that has nothing to do with it at all, and is long.</p></div>'
FOOT = "<footer><p>Copyright notice of the site with many words in one line.</p></footer>"
AD = '<div class="ad-slot"><p>Buy this now, it is cheap and good and everyone has one at home.</p><ul><li>a</li><li>b</li></ul></div>'
NOTES = '<section id="comments"><h2>Comments</h2><div class="comment"><p>I read this and have a long opinion about all of it, really.</p></div></section>'
FORM = "<form><p>Leave your address with us to get more of this every day.</p><input name='x'><button>Send it</button></form>"

CASES = {
    "marked": (f"<html><head><title>T</title><style>p{{}}</style></head><body>{NAV}<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article>{SIDE}{FOOT}</body></html>", f"Title\n\n{T1}\n\n{T2}"),
    "advert, form and script within": (f"{NAV}<article><p>{P1}</p>{AD}{FORM}<script>var t='</p><p>no';</script><p>{P2}</p>{NOTES}</article>{FOOT}", f"{T1}\n\n{T2}"),
    "short first paragraph before an advert": (f"<main><p>Short.</p>{AD}<p>{P2}</p></main>", f"Short.\n\n{T2}"),
    "no mark": (f"<body><div id='header'><h1>Site name and motto</h1></div>{NAV}<div class='content'><h1>Title</h1><p>{P1}</p>{AD}<p>{P2}</p></div>{SIDE}{NOTES}{FOOT}", f"Title\n\n{T1}\n\n{T2}"),
    "list and table": (f"<article><p>{P1}<ul><li>one<li>two <i>words</i></ul><table><tr><td>x<td>y</table></article>", f"{T1}\n\none\n\ntwo words\n\nx\n\ny"),
    "paragraphs not closed": (f"<article><p>{P1}<p>{P2}", f"{T1}\n\n{T2}"),
    "white space": ("<article><p> a \n\t b<br>c&nbsp;d&#32;e<b>f</b>g </p></article>", "a b c d efg"),
    "header of an article": (f"<header>Site</header><article><header><h1>Title</h1></header><p>{P2}</p></article>", f"Title\n\n{T2}"),
    "hidden and roles": (f"<article><p>{P2}</p><div hidden>no one sees this text at all</div><div style='display: none'>nor this one</div><div role='complementary'>nor that</div></article>", T2),
    "cookie notice first": (f"<div class='cookie-notice'>We use cookies for many purposes, all of them good. Accept.</div><main><p>{P2}</p></main>", T2),
    "comments as articles": (f"<article><p>{P2}</p></article><article class='comment'><p>A long opinion of a reader, about all this and more.</p></article>", T2),
    "less-than signs": ("<article><p>1 < 2 and a <3 b; x<y</p></article>", "1 < 2 and a <3 b; x"),
    "comment markup": (f"<article><!-- <p>not this</p> --><p>{P2}</p><!-- open", T2),
    "plain text": ("only words  here", "only words here"),
    "nothing": ("", ""),
    "no word": ("<div><p></p><br></div>", ""),
    "only a menu": (NAV, ""),
    "unknown references": ("<article><p>&nosuch; &#x48;&#101;y &copy</p></article>", "&nosuch; Hey ©"),
    "state names": (f"<div class='has-sidebar no-ads'><article class='post comments-open'><p>{P2}</p></article></div>", T2),
}


def test_templates_without_weights():
    blank = htmltext.Weights({})
    assert {k: htmltext.main_text(page, blank) for k, (page, _) in CASES.items()} == {k: text for k, (_, text) in CASES.items()}


def test_templates_with_learned_weights(spark):
    rows = [(i, f"u{i}", page, "x", 1) for i, (page, _) in enumerate(CASES.values())]
    rows += [(None, None, None, None, None), (3, "again", rows[3][2], "x", 1)]
    got = htmltext.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    texts = [text for _, text in CASES.values()] + ["", list(CASES.values())[3][1]]
    wanted = [(r[0], r[1], t, len(t)) for r, t in zip(rows, texts)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


def test_region_is_the_greatest_sum():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        start, end = htmltext.best_region(scores)
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)], default=0.0)
        assert sum(scores[start:end]) == best


def test_counts_are_added_over_pages(spark):
    pages = spark.createDataFrame([(i, "u", page, "x", 1) for i, (page, _) in enumerate(CASES.values())] * 3, SCHEMA)
    wanted = {}
    for page, _ in list(CASES.values()) * 3:
        for kind, mine, number in htmltext.counted(page):
            a, b = wanted.get(kind, (0, 0))
            wanted[kind] = (a + number * mine, b + number)
    assert htmltext.learn(pages).counts == wanted
    few = htmltext.learn(pages, sample=10).counts
    assert set(few) <= set(wanted)


def test_long_and_deep_pages_take_linear_time():
    deep = "<div>" * 20000 + "word " * 10 + "</b></i></span>" * 20000
    assert htmltext.main_text(deep, htmltext.Weights({})).split()[0] == "word"
    open_quotes = "<article><p>" + "<a title=\"x>word " * 20000
    htmltext.main_text(open_quotes, htmltext.Weights({}))
    many = "<article>" + "<p>one two three" * 30000
    assert len(htmltext.main_text(many, htmltext.Weights({})).split()) == 90000


def test_empty_table(spark):
    assert htmltext.extract(spark.createDataFrame([], SCHEMA)).collect() == []
