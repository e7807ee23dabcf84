"""The block rules of page extraction, on pages made for one rule each and on the given pages with their markup taken away."""

import re

import pytest

from docforge.llm.html_text import main_text

ONE = "The house on the hill was old, and it had been there for as long as anyone could remember in the village."
TWO = "It was said that the owner of the house had left it to his son, who never came back to live in it after the war."
BODY = f"<h1>Old house</h1><p>{ONE}</p><p>{TWO}</p>"
FULL = f"Old house\n\n{ONE}\n\n{TWO}"
NAV = '<nav><a href="/">Home</a></nav>'

CASES = {
    "layout class around the article": (f'{NAV}<div class="layout with-sidebar"><article>{BODY}</article></div><footer>x</footer>', FULL),
    "marked container that holds the page": (f'{NAV}<div class="sidebar-left"><div>{BODY}</div></div>', FULL),
    "form around the page": (f"<form id=aspnetForm>{NAV}<div>{BODY}</div></form>", FULL),
    "a form beside the text": (f"<div>{BODY}</div><form><p>{ONE}</p></form>", FULL),
    "attribute values are not attributes": (f'<div title="the hidden valley">{BODY}</div>', FULL),
    "hidden container": (f"<div>{BODY}</div><div hidden><p>{ONE} Hidden.</p></div>", FULL),
    "self-closing drawing": (f"<article><h1>Old house</h1><svg/><p>{ONE}</p><svg><text>bad</text></svg><p>{TWO}</p></article>", FULL),
    "unknown stop words": ("<div><h1>Старый дом</h1><p>Дом на холме был старым, и он стоял там столько, сколько кто-либо мог вспомнить.</p><p>Говорили.</p></div><div><a href=x>Главная</a> <a href=y>Новости</a></div>", "Старый дом\n\nДом на холме был старым, и он стоял там столько, сколько кто-либо мог вспомнить.\n\nГоворили."),
    "no spaces": ("<div><h1>古い家</h1><p>丘の上の家は古く、村の誰もが覚えている限りずっとそこにあった。所有者は息子に家を残した。</p><p>終わり。</p></div>", "古い家\n\n丘の上の家は古く、村の誰もが覚えている限りずっとそこにあった。所有者は息子に家を残した。\n\n終わり。"),
    "a link around blocks": (f"<div>{BODY}</div><div><a href=/x><p>Read the other story about the city and its people in the summer of the last year.</p></a></div>", FULL),
    "a link that never ends": (f"<div><p>See <a href=/x>this.</p><p>{ONE}</p><p>{TWO}</p></div>", f"See this.\n\n{ONE}\n\n{TWO}"),
    "more comments than text": (f'<div class=content>{BODY}</div><div id="comments">{f"<p>{TWO}</p>" * 9}</div>', FULL),
    "notice without a class": (f"<div>We use cookies to make this site work.</div><div>{BODY}</div>", FULL),
    "short blocks of an article": (f"<article>{BODY}<ul><li>one</li><li><a href=q>two</a></li></ul><p>End</p></article>", f"{FULL}\n\none\n\ntwo\n\nEnd"),
    "teasers are no article": (f"<div>{BODY}</div><div class=related><article><h2>Other</h2><p>short one</p></article></div>", FULL),
    "references and white space": ("<article><p>a &amp; b&nbsp;&lt;c&gt;\n\n d&#233;</p></article>", "a & b <c> dé"),
    "only a short block": ("<p>Hello.</p>", "Hello."),
    "scripts and styles": (f"<script>var t='</p>';</script><style>p{{}}</style><article>{BODY}</article><script>x", FULL),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(name):
    page, text = CASES[name]
    assert main_text(f"<html><head><title>t</title></head><body>{page}</body></html>") == text


def test_null_page():
    assert main_text(None) == ""


@pytest.mark.parametrize("tag", ["div", "section", "td"])
def test_without_the_article_tag(spark, tag):
    """The rules carry the result: of 250 pages with the article's tag renamed, nearly all blocks stay and none is added."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    kept = total = same = 0
    for page in pages:
        own, other = main_text(page).split("\n\n"), main_text(re.sub(r"<(/?)article", rf"<\1{tag}", page)).split("\n\n")
        kept, total, same = kept + len(set(own) & set(other)), total + len(set(own)), same + (own == other)
        assert set(other) <= set(own)
    assert kept >= 0.95 * total and same >= 0.95 * len(pages)


def test_long_page_and_depth():
    assert main_text("<div>" * 5_000 + f"<p>{ONE}</p>" * 5_000).count(ONE) == 5_000
