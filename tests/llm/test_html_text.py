import html
import re

import pytest

from tableprep.llm import html_text as H
from tableprep.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "This is a paragraph of the article, with a good many words in it, so that it reads like prose."
P3 = "".join(f"<p>{LONG} Number {i}.</p>" for i in range(3))
T3 = [f"{LONG} Number {i}." for i in range(3)]


def marked(page):
    """What stands in the one ``article`` element of a generated page, by patterns."""
    m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    return "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split())))


def test_query_against_patterns(spark):
    got = H.op11_main_text(spark, SF).collect()
    pages = {r["page_id"]: r for r in table(spark, SF, "pages").collect()}
    assert len(got) == len(pages) == len({r["page_id"] for r in got})
    for r in got:
        assert (r["text"], r["url"]) == (marked(pages[r["page_id"]]["html"]), pages[r["page_id"]]["url"])
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("begin, end", [("<div>", "</div>"), ("", ""), ("<div class='layout with-sidebar'><div id=main-content>", "</div></div>"),
                                        ("<table><tr><td>", "</td></tr></table>"), ("<section>", "</section>")])
def test_generated_pages_without_their_mark(spark, begin, end):
    """The clusters find the same region where the page doesn't mark it."""
    for r in table(spark, SF, "pages").limit(60).collect():
        page = r["html"].replace("<article>", begin).replace("</article>", end)
        assert "\n".join(H.main_lines(page)) == marked(r["html"])


PAGES = {
    "parts around": (f"<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class=cookie-notice><p>{LONG}</p></div><main><article><h1>Title</h1>"
                     f"{P3}<aside><p>{LONG}</p></aside><form><p>{LONG}</p></form><div class=share-buttons>Share this</div></article>"
                     f"<section id=comments><article class=comment><p>{LONG} {LONG}</p></article></section></main><footer><p>{LONG}</p></footer></body>", ["Title", *T3]),
    "main only": (f"<main><h1>Title</h1>{P3}<h2>Sub</h2><p>Short.</p><ul><li>one<li>two</ul></main><div id='sidebar'><p>{LONG}{LONG}</p></div>",
                  ["Title", *T3, "Sub", "Short.", "one", "two"]),
    "no marks, named": (f"<div id=header><a href=/>Home</a> <a href=/b>About</a></div><div class='post'><h1>Title</h1><div class='post-content'>{P3}<p>Short.</p></div></div>"
                        f"<div class='related-posts'><p>{LONG}</p></div><div class=reader-comments><p>{LONG}</p><p>{LONG}</p></div>", ["Title", *T3, "Short."]),
    "no marks, no names": (f"<div><a href=/>Home</a> | <a href=/b>About</a></div><div><h1>Title</h1>{P3}<p>Ok.</p></div><div><ul><li><a href=/x>More</a></li></ul></div>",
                           ["Title", *T3, "Ok."]),
    "references, white space": ("<article><p>a&amp;b &lt;c&gt;&nbsp; d\n\n\te&#233;&#x4e2d;&copy &unknown;</p><p>line<br>break <b>bo</b>ld <i> x </i></p></article>",
                                ["a&b <c> d eé中© &unknown;", "line break bold x"]),
    "scripts, styles, notes": (f"<article><script>var p='</p><p>no';</script><style>p {{}}</style><!-- <p>no</p> --><noscript>no</noscript>{P3}<template><p>no</p></template></article>", T3),
    "tags never closed": (f"<div class=ad>Buy now<article><h1>Title<p><b>{LONG}<p>{LONG}<table><tr><td>cell<td>other</table><li>item", ["Title", LONG, LONG, "cell", "other", "item"]),
    "articles in a column": (f"<aside><article><h2>Teaser</h2><p>Read.</p></article></aside><article><h1>Title</h1>{P3}</article>", ["Title", *T3]),
    "hidden": (f"<article>{P3}<p hidden>no</p><div style='display: none'><p>no</p></div><p aria-hidden=true>no</p></article>", T3),
    "no markup": ("just some words\n and  more", ["just some words and more"]),
    "nothing": ("<html><head><title>x</title></head><body></body></html>", []),
    "menus only": ("<nav><a href=/>Home</a></nav><footer>x</footer>", []),
    "broken": ("<article><p>a < b and <3 &amp &am</p></p></article></div><", ["a < b and <3 & &am"]),
    "long article, tiny paragraphs": ("<article>" + "".join(f"<p>{i}</p>" for i in range(300)) + "</article><div class=ad>" + LONG * 9 + "</div>", [str(i) for i in range(300)]),
}


@pytest.mark.parametrize("case", PAGES)
def test_pages(case):
    page, want = PAGES[case]
    assert H.main_lines(page) == want


def test_smoothing():
    flat = H.smoothed([5.0] * 7, H.Ratios())
    assert all(abs(x - 5) < 1e-12 for x in flat)
    one = H.smoothed([0, 0, 0, 10, 0, 0, 0], H.Ratios())
    assert one[3] == max(one) and one[1] == one[5] > 0 == one[0]


def test_awkward_rows(spark):
    long = "<article>" + "<p>" + LONG + "</p>" * 1 + ("<p>" + LONG + "</p>") * 20_000 + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (3, "u", " \n "), (4, "u", long), (5, "u", "<p>x</p>"), (5, "u", "<p>x</p>"), (None, "u", "<p>y"), (6, "u", deep)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "page_id long, url string, html string, text int, n_chars int, lines int")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in H.main_text(df).collect()), key=str)
    want = [(1, "u", ""), (2, None, ""), (3, "u", ""), (4, "u", "\n".join([LONG] * 20_001)), (5, "u", "x"), (5, "u", "x"), (0, "u", "y"), (6, "u", "deep")]
    assert got == sorted(((*r, len(r[2])) for r in want), key=str)
    assert H.main_text(df.limit(0)).count() == 0
