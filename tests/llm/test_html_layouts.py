"""Main text of twenty and more page layouts, written out by hand."""

from __future__ import annotations

import pytest

from lumenframe.llm import html_text

A = "The harbour froze early that year, and the boats lay still, one beside the other, until spring."
B = "Nobody had expected the ice to last; the fishermen mended nets, told stories and waited."
C = "By April the channel was open again and the first catch came in at dawn"
LONG = "The survey of the northern coast took eleven years and filled forty volumes of notes " * 12
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/news>News</a></ul></nav>"
FOOT = "<footer><p>All rights reserved, worldwide, forever.</p></footer>"
BODY = f"<h1>Ice</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"Ice\n\n{A}\n\n{B}\n\n{C}"


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>Site, the best</title></head><body>{body}</body></html>"


def noise(attributes: str, tag: str = "div") -> str:
    return f"<{tag} {attributes}><p>Unwanted words, many of them, that no reader of the article should see.</p></{tag}>"


LAYOUTS = {
    "plain article": f"{NAV}<article>{BODY}</article>{FOOT}",
    "layout word on the page": f"<div class='page has-sidebar'>{NAV}<article>{BODY}</article></div>{FOOT}",
    "layout word on the site": f'<div class="site has-sidebar"><div class="content">{BODY}</div></div>',
    "theme word": f'<div class="theme-header-sticky">{NAV}<main>{BODY}</main></div>',
    "noise name around it all": f'<div class="sidebar-layout-left"><div class="wrap"><article>{BODY}</article></div>{FOOT}</div>',
    "noise name, no article": f'<div class="comments-page"><div>{BODY}</div></div>',
    "newsletter inside": f"<article>{BODY}{noise('class=article-newsletter')}</article>",
    "share inside": f"<article>{noise('class=post-share')}{BODY}</article>",
    "promo inside": f'<div class="content">{BODY}{noise("class=content-promo")}</div>',
    "related inside": f"<article>{BODY}{noise('class=entry-related', 'section')}</article>",
    "header by class inside": f'<article><div class="page-header"><h1>Ice</h1><p>Section, Region, Date</p></div><p>{A}</p><p>{B}</p><p>{C}</p></article>',
    "header inside": f"<article><header><h1>Ice</h1><p>By a writer, yesterday</p></header><p>{A}</p><p>{B}</p><p>{C}</p></article>",
    "comment articles": f"<article>{BODY}{noise('class=comment', 'article')}{noise('class=comment id=c2', 'article')}</article>",
    "comments longer than the article": f"<div class=content>{BODY}</div><section id=comments>{noise('class=text') * 9}</section>",
    "quote in an attribute": f"<article><h1>Ice</h1><p title=it's>{A}</p><p data-x=\"a > b\" title='\"'>{B}</p><p>{C}</p></article>",
    "class in a value": f"<article><h1 title='the class=ad of all'>Ice</h1><p>{A}</p><p>{B}</p><p>{C}</p></article>",
    "cookies and advert": f"{noise('id=cookie-banner')}<article>{BODY}{noise('class=ad')}{noise('class=adSlot')}</article>{noise('role=alert')}",
    "sidebar": f"{noise('', 'aside')}{noise('class=sidebar')}<main>{BODY}</main>",
    "hidden": f"<article>{BODY}{noise('hidden')}{noise('style=display:none')}{noise('aria-hidden=true')}</article>",
    "form and script": f"<article>{BODY}<form><p>Your mail, please</p><input></form><script>if (a<b) x('<p>no</p>')</script><style>p{{}}</style></article>",
    "nested sections": f"<article><div><h1>Ice</h1><p>{A}</p></div><div><section><p>{B}</p></section><section><p>{C}</p></section></div></article>",
    "menu of a paragraph": f"<article><p><a href=a>One</a> | <a href=b>Two</a> &middot; <a href=c>Three</a></p>{BODY}</article>",
    "table layout": f"<table><tr><td class=menu><a href=a>One</a><a href=b>Two</a></td><td>{BODY}</td></tr></table>",
    "id of content": f"<div id=header><p>Site name, motto</p></div><div id=content>{BODY}</div><div id=footer><p>Address, phone</p></div>",
    "unclosed": f"<article><h1>Ice<p>{A}<p>{B}<p>{C}",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    assert html_text.main_text(page(LAYOUTS[name])) == TEXT


def test_linked_prose_stays():
    linked = f'{A} <a href=x>The whole story of the ice is in the records of the harbour office, bound in leather</a> and <a href=y>in the letters that the captains wrote home every week of that winter</a>.'
    got = html_text.main_text(page(f"<article><p>{B}</p><p>{linked}</p><p>{C}</p></article>"))
    assert "bound in leather" in got and "captains wrote home" in got
    short = "See <a href=x>the long list of all the vessels</a>, <a href=y>and of all the captains</a>."
    assert "See the long list of all the vessels, and of all the captains." in html_text.main_text(page(f"<article><p>{A}</p><p>{short}</p><p>{B}</p></article>"))


def test_long_body_without_commas_beats_a_teaser():
    teaser = "<article><p>Cheap, bright, new, large, soft, warm, light, good, fine, rare.</p></article>"
    got = html_text.main_text(page(f"{teaser}<div class=text><p>{LONG}</p><p>{LONG}</p></div>"))
    assert got.count("northern coast") == 24 and "Cheap" not in got


def test_headings_and_lists_of_the_article_stay():
    body = f"<div id=story><h2>First</h2><div><p>{A} {B}</p><p>{B}</p></div><h2>Second</h2><div><p>{A} {C}</p><ul><li>nets</li><li>boats</li></ul></div></div>"
    got = html_text.main_text(page(body))
    assert got == f"First\n\n{A} {B}\n\n{B}\n\nSecond\n\n{A} {C}\n\nnets\n\nboats"


def test_long_text_and_repeats(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i}, with words, of its own.</p>" for i in range(20_000)) + "</article>"
    rows = spark.createDataFrame([(1, "u", long, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_text(rows).collect()
    assert sorted((str(r.page_id), len(r.text.split("\n\n")) if r.text else 0) for r in got) == [("1", 20_000), ("2", 0), ("2", 0), ("None", 0)]
