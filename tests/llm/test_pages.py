"""Main text of pages: the articles of the given tables, hand-made pages of many shapes, broken markup, labels of the passes."""

import html
import re
import time

import pytest

from footlog.llm import mainhtml
from footlog.llm.queries import op11_main_text

SF = "/root/testdata/sf0.01"
LONG = "It was said that the harbour had been closed for the whole of the winter, and that none of the boats which were in it could leave before the ice was gone."
ALSO = "When the pilots of the town met in the hall they said that they would not go out to the ships until the lights at the end of the pier were on again."
THIRD = "Nobody in the town had an answer to this, but most of the people who live there were sure that it would be over by the end of the month or so."
ADVERT = "Buy now cheap tyres, top brands, free delivery, lowest prices, order today, limited stock, call centre open, buy two get one free, best deals."


def main_of(page: str) -> str:
    found = mainhtml.blocks(page)
    labels = mainhtml.Rules(mainhtml.STOP_WORDS).labels(found)[2]
    return "\n".join(b.text for b, label in zip(found, labels, strict=True) if label)


def test_articles_of_the_given_pages(spark):
    """The given pages have one article element each; its blocks, read by other means, are the text."""
    for row in op11_main_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        inside = row.html.split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert row.text == "\n".join(p for p in parts if p), row.page_id
        assert row.n_chars == len(row.text)


PAGES = {
    "no article element": (
        f"<body><div id=top-nav><a href=/>Home</a> <a href=/x>News</a></div><div class=x1><h2>The harbour</h2><p>{LONG}</p><p>Short one.</p><p>{ALSO}</p></div>"
        f"<div class='site-footer'><p>{THIRD}</p></div></body>",
        f"The harbour\n{LONG}\nShort one.\n{ALSO}",
    ),
    "comments after the article": (
        f"<article><h1>Ice</h1><p>{LONG}</p></article><section id=comments><h3>3 comments</h3><article class=comment><p>{ALSO}</p></article><p>{THIRD}</p></section>",
        f"Ice\n{LONG}",
    ),
    "comments inside the article": (f"<article><p>{LONG}</p><div class=comment-list><p>{ALSO}</p></div><article><p>{THIRD}</p></article></article>", LONG),
    "comments told by their heading": (f"<main><p>{LONG}</p><div><h2>Comments (2)</h2><p>{ALSO}</p><p>I agree.</p></div><p>{THIRD}</p></main>", f"{LONG}\n{THIRD}"),
    "page inside a form": (f"<form id=aspnet><header><p>{THIRD}</p></header><main><p>{LONG}</p><form><label>Mail</label><p>{ALSO}</p></form></main></form>", LONG),
    "header of the article": (f"<header>Site</header><article><header><h1>Ice</h1></header><p>{LONG}</p><footer>By A</footer></article>", f"Ice\n{LONG}"),
    "advert and notice inside": (
        f"<article><p>{LONG}</p><div class='ad-box'>{THIRD}</div><div role=alert>{THIRD}</div><aside>{THIRD}</aside><p style='display:none'>{THIRD}</p><p>End.</p></article>",
        f"{LONG}\nEnd.",
    ),
    "advert without a name": (f"<div><p>{LONG}</p></div><div><p>{ADVERT}</p></div><div><p>{ALSO}</p></div>", f"{LONG}\n{ALSO}"),
    "lists of links": (f"<div><p>{LONG}</p><ul><li><a href=/a>{ALSO}</a></li><li><a href=/b>{THIRD}</a></li></ul></div>", LONG),
    "link inside the text": (f"<article><p>{LONG} <a href=/x>See there</a>.</p></article>", f"{LONG} See there."),
    "scripts, styles, comments": (f"<article><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>{ALSO}</p> --><p>{LONG}</p><noscript>{THIRD}</noscript></article>", LONG),
    "references": (f"<article><p>{LONG} caf&eacute; &amp;amp; &#x6f22;&nbsp;&lt;b&gt;</p></article>", f"{LONG} café &amp; 漢 <b>"),
    "white space and breaks": (f"<article><p>a\n\t b<br>c<br><br>d</p><p>{LONG}</p></article>", f"a b c\nd\n{LONG}"),
    "unclosed everything": (f"<nav><a href=/>x</a></nav><article><p><b>{LONG}<p>{ALSO}<div>Last", f"{LONG}\n{ALSO}\nLast"),
    "unclosed quote": (f'<article><p class="a>{LONG}</p><p>{ALSO}</p></article>', f"{LONG}\n{ALSO}"),
    "another alphabet": (f"<article><h1>Порт</h1><p>{'порт закрыт зимой льдом ' * 9}</p></article>", "Порт\n" + ("порт закрыт зимой льдом " * 9).strip()),
    "all short": ("<article><p>One.</p><p>Two.</p></article>", "One.\nTwo."),
    "short outside": ("<div><p>One.</p><p>Two.</p></div>", ""),
    "nothing": ("", ""),
    "text alone": (LONG, LONG),
    "sidebar names": (f"<body class='has-sidebar'><div class='content with-sidebar'><p>{LONG}</p></div><div class='sidebar-content'><p>{ALSO}</p></div></body>", LONG),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert main_of(page) == text


def test_passes():
    found = mainhtml.blocks(f"<div><p>{LONG}</p><p>Between.</p><p>{ALSO}</p><p>After.</p><p>{ADVERT}</p><h2>Title</h2><p>{THIRD}</p></div>")
    _, first, second = mainhtml.Rules(mainhtml.STOP_WORDS).labels(found)
    assert first == [True, None, True, None, False, None, True]
    assert second == [True, True, True, False, False, True, True]


@pytest.mark.parametrize("part", ["<a ", '<a href="', "<div>", "</div>", "<!--", "<p><b>", "<article>", "&am", "<a href='x'>", "<script>", "<br>", "< "])
def test_long_broken_pages_take_time_in_proportion(part):
    started = time.process_time()
    main_of(part * (400_000 // len(part)))
    assert time.process_time() - started < 6


def test_hard_rows(spark):
    rows = [(1, None, None), (None, "u", f"<p>{LONG}</p>"), (2, "v", ""), (3, "w", f"<p>{LONG}</p>"), (3, "w", f"<p>{LONG}</p>"), (4, None, "<p>" + f"{LONG} " * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as block", "1 as n_chars")
    got = sorted((r.page_id or 0, r.url or "", r.text) for r in mainhtml.extract(pages).collect())
    assert got == [(0, "u", LONG), (1, "", ""), (2, "v", ""), (3, "w", LONG), (3, "w", LONG), (4, "", (f"{LONG} " * 2000).strip())]
    empty = pages.limit(0)
    assert mainhtml.extract(empty).count() == 0 and mainhtml.labelled_blocks(empty).count() == 0
    parts = mainhtml.labelled_blocks(pages).where("page_id = 3").collect()
    assert [(p.block, p.tag, p.first_label, p.main) for p in parts] == [(0, "p", "text", True)] * 2
