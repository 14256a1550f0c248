"""Main text of pages: made-up layouts with known articles, and the given pages by their own markup."""

import html as html_lib
import re
import time

from tracemill.llm import html_text as ht

P1 = "The quick brown fox, as they say, jumps over the lazy dog, and then it rests for a while in the shade of a tree."
P2 = "Short one."
P3 = "Another paragraph, with commas, follows; it is long enough to count as text that someone wrote to be read."


def test_layouts():
    body = f"<h1>Title &amp; more</h1><p>{P1}</p><p>{P2}<p>{P3} <a href=x>link</a></p>"
    want = "\n\n".join(["Title & more", P1, P2, P3 + " link"])
    noise = "<nav><ul><li><a href=/>Home, sweet home and other menu entries, of many words</a></ul></nav>"
    comments = f"<div id='comments'><p>{P1} Nice, nice, nice, really.</p><p>{P3}</p></div>"
    for page in (
        f"<html><head><title>t</title><style>p>{{}}</style></head><body>{noise}<article>{body}</article><footer>&copy; {P1}</footer></body></html>",
        f"<body><header><h1>Site</h1><p>{P1}</p></header><div class='side sidebar'><p>{P1}{P1}</p></div><main>{body}</main>{comments}",
        f"<body><div class='wrap has-sidebar'><div id=content>{body}</div></div><div class=cookie-notice>We use cookies, as all, do.</div>",
        f"<BODY><DIV CLASS='mainContent'>{body}<div class='ad'>Buy, buy, buy: {P1}</div><form><p>{P1}</p><input></form><script>var a='<p>{P1}</p>';</script></DIV>",
        f"<article>{body}<aside>{P1}</aside><section class='comments'><article class=comment><p>{P1}</p></article></section></article>",
        f"<article><!-- <p>{P1}</p> -->{body}",
    ):
        assert ht.main_text(page) == want, page


def test_class_words_do_not_take_articles():
    blocks = [f"{P1} {i}." for i in range(4)]
    want, long = "\n\n".join(blocks), f"<p>{P1} Nice, nice.</p>" * 9
    body = "".join(f"<p>{b}</p>" for b in blocks)
    for page in (
        "<body><div id=page>" + "".join(f"<div class='elementor-widget'><p>{b}</p></div>" for b in blocks) + "</div>",
        "<body><div class='page has-sidebar'><div id=text>" + "".join(f"<div>{b}</div>" for b in blocks) + "</div></div>",
        "<body><div class='has-sidebar'><ul>" + "".join(f"<li>{b}</li>" for b in blocks) + "</ul></div>",
        f"<body><article class='post category-legal'>{body}</article><div id=more>" + "".join(f"<p>More of it, {i}</p>" for i in range(90)) + "</div>",
        f"<body><article><p>{blocks[0]}</p><div class='notice'><p>{blocks[1]}</p></div><p>{blocks[2]}</p><p>{blocks[3]}</p><div class='share'><a href=x>Share this, please</a></div></article>",
        f"<body><form action=x><input name=v><div id=content>{body}</div></form>",
        f"<body><div id=content>{body}</div><div class=comments>{long}</div>",
        f"<body><article>{body}<div id=comments>{long}</div></article>",
    ):
        assert ht.main_text(page) == want, page


def test_nothing_else_is_dropped_or_added():
    body = f"<p>{P1}</p><p>{P3}</p>"
    want = f"{P1}\n\n{P3}"
    for page, text in (
        (f"<article>{body}<section class='legal notes'><p>{P1} It is law.</p></section></article>", f"{want}\n\n{P1} It is law."),
        (f"<body><div id=content>{body}<p class='share'>{P1} We share it.</p></div>", f"{want}\n\n{P1} We share it."),
        (f"<article>{body}<div class='text-ad-free'><p>{P3} No adverts.</p></div></article>", f"{want}\n\n{P3} No adverts."),
        (f"<body><div class=outer>Loose text, beside the best container, of some length. <div id=text>{body}</div><b>And more</b> loose text, behind it, <i>is</i> kept.</div>", f"Loose text, beside the best container, of some length.\n\n{want}\n\nAnd more loose text, behind it, is kept."),
        (f"<article><p>foo<img src=x>bar, {P1}</p></article>", f"foobar, {P1}"),
        ("<body><ul>" + "".join(f"<li><a href='/{i}'>Link number {i}, to somewhere else</a></li>" for i in range(20)) + "</ul>", ""),
        (f"<article>{body}</article><label for=q>Search for what, please?</label>", want),
        (f"<article><p>See <a href=/x/>this</a> and, well, {P1}</p><div/>{P3}</article>", f"See this and, well, {P1}\n\n{P3}"),
        (f"<body><div id=content><a name=top/>{body}</div>", want),
    ):
        assert ht.main_text(page) == text, page


def test_markup():
    page = f"<article><p>a\n <b>b</b>&nbsp;c&#233;&lt;br&gt; x<br>y</p><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><pre> k  l\n m</pre><p title='a>b'>5 < 6 & 7</p><p>{P1}</article>"
    assert ht.main_blocks(page) == ["a b cé<br> x y", "one", "two", "1 2", "3", "k l m", "5 < 6 & 7", P1]
    assert ht.main_text(None) == ht.main_text("") == ht.main_text("<p></p>") == ""
    assert ht.main_text("just words") == "just words"


def test_hostile_pages_end_soon():
    start = time.time()
    for page in ("<p" * 100_000, "<div>" * 50_000 + "x", '<p a="' * 30_000, "<!--" * 50_000, "<b><p>" * 20_000 + P1, "<li>" * 50_000, "</div>" * 50_000, f"<article><p>{'word, ' * 200_000}</p></article>"):
        ht.main_text(page)
    assert time.time() - start < 60


def test_odd_rows(spark):
    page = f"<article><p>{P1}</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (3, "v", "")]
    df = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = sorted(map(tuple, ht.extract(df).select("page_id", "url", "text", "n_chars").collect()), key=str)
    assert out == sorted([(1, "u", P1, len(P1))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert ht.extract(df.limit(0)).count() == 0


def test_query_on_given_pages(spark):
    """The given pages hold one article element; cut it out with patterns and compare."""
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in ht.op5_html_extraction(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", inner)
        parts = [" ".join(html_lib.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        assert got[r["page_id"]]["text"] == "\n\n".join(x for x in parts if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
