"""Main text of pages with planted menus, notices, adverts, comments and broken markup."""

import time

from skyloom.llm import html_text
from skyloom.llm.html_text import blocks_of

P = "The report of the council says that it is for all of the people who live in this part of the city, and that they have been asked by it to come and say what they think of the plan for the old market."
Q = "There was a time when the market was open on each day of the week, but it is not so now, as one of the owners has said, and more and more of the people who came to it are going to the other side of the river."
S = "So it is."
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>All of the news from the city</a></li></ul></nav>"


def text(page):
    b = html_text._decided([page])
    return "\n".join(b["text"][b["kept"]])


def test_article_element():
    page = f"""<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style><script>if (a < b) document.write("<p>{P}</p>")</script></head><body class="has-sidebar">
<header><h1>The City Paper</h1><p>{P}</p></header>{MENU}<div class="cookie-notice"><p>{Q}</p></div>
<article class="post"><header><h1>The  old&nbsp;market</h1></header><p>{P}</p><div class="ad">{Q}</div><p>{S}</p><figure><figcaption>A view</figcaption></figure>
<form><label>Your name</label><p>{P}</p></form><aside><p>{Q}</p></aside><p>AT&amp;T &lt;3 caf&eacute; &#8364;<br>{Q} <a href="x">{S}</a></p>
<section id="comments"><h2>Comments</h2><article class="comment-body"><p>{P}</p></article></section></article>
<div id="sidebar"><p>{Q}</p></div><p>{P}</p><footer>&copy; {P}</footer></body></html>"""
    assert text(page) == f"The old market\n{P}\n{S}\nA view\nAT&T <3 café € {Q} {S}"


def test_no_article_element():
    page = f"<body>{MENU}<div class='header'><b>The Paper</b></div><div><h2>The market</h2><p>{P}</p><p>{S}</p><p>{Q}</p><ul><li><a href='1'>More of the news that is to come</a></li></ul><div>Copyright 2020 Paper Ltd</div></div><div class='related'>{P}</div></body>"
    assert text(page) == f"The market\n{P}\n{S}\n{Q}"


def test_short_pages():
    assert text("<nav><a href=1>Home</a></nav><article><h1>One</h1><p><b>Two.<br><p>Three</article><footer>Four</footer>") == "One\nTwo.\nThree"
    assert text(f"<div class=ad>x</div><h1>One</h1><p>Two</p><footer>{P}</footer>") == "One\nTwo"
    assert [text(x) for x in (None, "", "<p>", "<script>x", "<!-- x", "<nav>only</nav>", "<p hidden>x</p>")] == [""] * 7
    assert text("plain words of a page") == ""


def test_links_and_unknown_languages():
    linked = " ".join(f"<a href='{i}'>the link of the page {i}</a>" for i in range(20))
    assert text(f"<p>{P}</p><p>{linked}</p><p>{Q}</p>") == f"{P}\n{Q}"
    assert text(f"<article><p>{P}</p><p>{linked}</p><p>{S}</p></article>") == f"{P}\n{S}"
    strange = "xyzzy plugh frobnicate quux " * 20
    assert text(f"<p>{strange}</p>") == strange.strip()
    assert text(f"<p>{P}</p><p>{P}</p><p>{strange}</p>") == f"{P}\n{P}"


def test_ends_of_broken_pages():
    for tail in ("<p", "<p class", "<p class='x", "</artic", "<!-- half", "<script>var a = '"):
        assert text(f"<article><p>{P}</p>{tail}") == P
    assert text(f"<article><p>{P} &am") == f"{P} &am" and text(f"<article><p>{P} &amp") == f"{P} &"
    assert text(f"<article><p title='a > b' class=x>{P}<p>1 < 2 and the rest of it</article>") == f"{P}\n1 < 2 and the rest of it"
    assert text(f"<article><div><a href=1>x<p>{P}</div><p>{Q}</article>").endswith(Q)


def test_blocks():
    assert [b[0] for b in blocks_of("a<b>b</b>c<p>d<br>e<li>f<li>g<table><tr><td>h<td>i</table>j")] == ["abc", "d e", "f", "g", "h", "i", "j"]
    assert [(t, n) for t, n, *_ in blocks_of("<p>one <a>two three</a> four")] == [("one two three four", 8)]


def test_long_and_hostile_pages_take_linear_time():
    for piece in ("<a ", "<a href='", "<div>", "<!--", "<", "<b>x</b>", "</p>", "<a =\"", "<script>", "<li>x", "<p><span class=ad>x"):
        t = time.time()
        blocks_of(piece * 60_000)
        assert time.time() - t < 20, piece
    assert text("<article>" + f"<p>{P}</p>" * 5000) == "\n".join([P] * 5000)


def test_frames(spark):
    rows = [(1, "u", f"<article><p>{P}"), (1, "u", f"<article><p>{P}"), (None, None, None), (2, "v", ""), (3, "w", f"<p>😀 {Q}")]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, text string, page string, n_chars int")
    got = html_text.extract_text(df.repartition(2))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", P, len(P)), (1, "u", P, len(P)), (None, None, "", 0), (2, "v", "", 0), (3, "w", "😀 " + Q, len(Q) + 2)], key=repr)
    assert html_text.extract_text(df.where("false")).count() == 0
    b = html_text.page_blocks(df).where("kept").collect()
    assert sorted(r["text"] for r in b) == sorted([P, P, "😀 " + Q]) and {r["label"] for r in b} == {"good"}
