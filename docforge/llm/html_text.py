"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags, and every block knows the element that holds it. Menus, footers
and the like go by their tag. A class, id or role that names such a part (or ``hidden``, or a form) is a vote
against a container, which a container that holds most of the page's text overrules. The first pass decides
blocks by link density, length and stop-word density, or end punctuation where the language is not one of the
stop words'. Short blocks stay open; the second pass gives each the label of the nearest decided blocks. Where
an article is marked up, the rest of the page is no text; elsewhere the smallest element with most of the
decided text takes its place.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import tidied
from docforge.plans.tables import bounded_arrow

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be because been before but by can could did do for from had has have he her his how i if in into is it its just like"
    " may me more most my no not now of on one only or other our out over she so some such than that the their them then there these they this to two up was we were"
    " what when which who will with would you your"
    " aber als am an auch auf aus bei bin bis da das dass dem den der des die dies diese doch du durch ein eine einem einen einer es für hat hatte ich ihr im in ist ja"
    " kann man mehr mit nach nicht noch nur oder schon sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur"
    " au aux avec ce ces cette comme dans de des du elle en est et était eux il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on ont ou où par pas"
    " plus pour qu que qui sa sans se ses si son sont sur ta te tu un une vos votre vous y à été être"
    " al algo ante antes con como contra cual cuando del desde donde el ella ellos en entre era eran es esa ese eso esta este esto fue ha hay la las le les lo los más"
    " me mi muy no nos o otra otro para pero por porque que quien se ser si sin sobre su sus también te tiene todo un una uno y ya".split()
)
#: Elements that never hold article text, whatever they hold; a header counts outside of an article only.
LEFT_OUT = frozenset("nav footer aside head dialog menu select button datalist noscript template svg canvas object audio video".split())
#: Elements whose content is not markup.
_RAW = "script|style|textarea|iframe|noscript|template|title|xmp|noembed|noframes"
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main"
    " menu nav ol p pre section summary table tbody td tfoot th thead tr ul select button label option optgroup".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that vote against a container.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar sidebar widget widgets related"
    " recommended recommendations teaser teasers share sharing social comment comments commentlist disqus respond replies footer masthead topbar copyright disclaimer"
    " hidden skip tagcloud search complementary contentinfo".split()
)
#: First words of a class that say how a page is laid out, not what it holds (with-sidebar).
_LAYOUT = frozenset("with has no without is".split())
#: Short blocks outside of an article that say one of these are notices.
_NOTICE = re.compile(
    r"©|\(c\) ?\d{4}|\b(?:all rights reserved|cookies?|newsletter|subscribe|sign up|log ?in|privacy policy|terms of (?:use|service)|advertisement|sponsored|follow us|share (?:on|this))\b", re.I
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening element of these ends an open one of the same set inside the same parent.
_CELLS = frozenset("li dd dt tr td th option".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CUT_OFF = re.compile(r"<[a-zA-Z/!][^<]*\Z")
_SPLIT = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?…。！？؟।](?:[\"'»”’)\]]*)(?:\s|\Z)|[。！？]")
_WIDE = re.compile(r"[⺀-鿿가-힯豈-﫿]")
#: Limits of the first pass, and the share of decided text that the element of the article holds.
LINKED, FEW_LINKS, SHORT, LONG, DENSE, SPARSE, MOST = 0.5, 0.2, 70, 200, 0.30, 0.12, 2 / 3


class Node:
    """An element that holds blocks: its parent's number, and what its tag and attributes say."""

    __slots__ = ("articles", "chars", "marked", "out", "parent", "tag", "titles")

    def __init__(self, parent: int, tag: str, *, out: bool = False, marked: bool = False) -> None:
        self.parent, self.tag, self.out, self.marked = parent, tag, out, marked
        self.chars = self.articles = self.titles = 0


class Block:
    __slots__ = ("label", "linked", "links", "node", "tag", "text")

    def __init__(self, text: str, linked: int, links: int, node: int, tag: str) -> None:
        self.text, self.linked, self.links, self.node, self.tag, self.label = text, linked, links, node, tag, ""


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}


def _votes_against(tag: str, attrs: str) -> bool:
    """Whether an element's own tag or attributes say that it holds no article text."""
    if tag in ("html", "body", "main") or tag in _VOID:
        return False
    if tag == "form":
        return True
    if not attrs:
        return False
    found = _attributes(attrs)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDING.search(found.get("style", "")):
        return True
    for name in ("class", "id", "role"):
        for value in found.get(name, "").lower().split():
            words = _SPLIT.split(value)
            if words[0] not in _LAYOUT and (not _MARKS.isdisjoint(words) or words[-1] == "header" and len(words) > 1 and tag != "article" and words[0] in ("site", "page", "top")):
                return True
    return False


def blocks(page: str) -> tuple[list[Block], list[Node]]:
    """All text blocks in page order, but for those of left-out elements, and the elements that hold them."""
    out: list[Block] = []
    nodes = [Node(-1, "")]
    stack = [0]
    parts: list[str] = []
    linked, links, anchor = 0, 0, 0  # an open link is given by the size of the stack at its start

    def close() -> None:
        nonlocal parts, linked, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                node = stack[-1]
                out.append(Block(text, min(linked, len(text)), links, node, nodes[node].tag))
        parts, linked, links = [], 0, 0

    def text(s: str) -> None:
        nonlocal linked
        if nodes[stack[-1]].out:
            return
        if "&" in s:
            s = html_lib.unescape(s)
        parts.append(s)
        if anchor:
            linked += len(" ".join(s.split()))

    def push(tag: str, attrs: str) -> None:
        above = nodes[stack[-1]]
        gone = above.out or tag in LEFT_OUT or (tag == "header" and not any(nodes[i].tag == "article" for i in stack))
        nodes.append(Node(stack[-1], tag, out=gone, marked=_votes_against(tag, attrs)))
        stack.append(len(nodes) - 1)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, attrs = (m["end"], m["attrs"]) if m["tag"] else (m["end2"], m["attrs2"])
        if tag == "a":
            anchor = 0 if end or "href" not in _attributes(attrs) else len(stack)
            links += anchor > 0
        elif tag == "br":
            parts.append(" ")
        elif tag == "hr":
            close()
        elif tag in _BLOCK:
            close()
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    held = nodes[stack[k]].tag
                    if held == tag:
                        del stack[k:]
                        break
                    if held in ("body", "html") or (tag in ("p", "li", "dd", "dt") and held in ("div", "article", "section", "main", "ul", "ol", "td")):
                        break
            else:
                if nodes[stack[-1]].tag == "p":  # a block ends an open paragraph
                    stack.pop()
                if tag in _CELLS and nodes[stack[-1]].tag == tag:
                    stack.pop()
                push(tag, attrs)
            if anchor > len(stack):  # the element that the link began in is over
                anchor = 0
        elif end:
            if len(stack) > 1 and nodes[stack[-1]].tag == tag:
                close()
                stack.pop()
        elif tag not in _VOID and not attrs.endswith("/") and (tag in LEFT_OUT or (attrs and _votes_against(tag, attrs))):
            close()
            push(tag, attrs)
    if at < len(page):
        rest = page[at:]
        text(rest[: rest.rfind("<")] if _CUT_OFF.search(rest) else rest)  # a tag that was cut off
    close()
    return out, nodes


def _sums(found: list[Block], nodes: list[Node]) -> None:
    """Unlinked characters, articles and titles that each element holds."""
    for b in found:
        nodes[b.node].chars += len(b.text) - b.linked
    for node in nodes:
        node.articles, node.titles = int(node.tag == "article" and not node.marked), int(node.tag == "h1")
    for node in reversed(nodes[1:]):
        above = nodes[node.parent]
        above.chars, above.articles, above.titles = above.chars + node.chars, above.articles + node.articles, above.titles + node.titles


def _without_marked(found: list[Block], nodes: list[Node]) -> list[Block]:
    """Blocks outside of marked containers; one with most of the text stays if it has the only article, else all titles, else if little would be left."""
    within = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], 1):
        within[i] = within[node.parent] or node.marked
    root = nodes[0]
    free = sum(len(b.text) - b.linked for b in found if not within[b.node])
    for i, node in enumerate(nodes[1:], 1):
        above = nodes[node.parent].out
        if root.articles:
            whole = node.articles == root.articles == 1
        else:
            whole = node.titles == root.titles if root.titles else free < LONG
        kept = whole and node.chars * 2 > root.chars
        node.out = above or node.out or (node.marked and not kept)
    return [b for b in found if not nodes[b.node].out]


def _held_by(found: list[Block], nodes: list[Node], chosen: set[int]) -> list[bool]:
    """For each block whether it stands in a chosen element."""
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        inside[i] = i in chosen or (node.parent >= 0 and inside[node.parent])
    return [inside[b.node] for b in found]


def _first_pass(b: Block) -> str:
    """text, other, or open."""
    density = b.linked / len(b.text)
    if density > LINKED:
        return "other"
    size = len(b.text) + len(_WIDE.findall(b.text))
    if size < SHORT or density > FEW_LINKS:
        return "open"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= (SPARSE if size >= LONG else DENSE) or _SENTENCE.search(b.text):
        return "text"
    return "open"


def _article(found: list[Block], nodes: list[Node]) -> tuple[list[bool], bool]:
    """Which blocks stand in the article, and whether it is marked up: else the smallest element with most of the decided text."""
    total = sum(len(b.text) - b.linked for b in found)
    for tag in ("article", "main"):
        chosen = {i for i, node in enumerate(nodes) if node.tag == tag and not node.out}
        held = _held_by(found, nodes, chosen)
        chars = sum(len(b.text) - b.linked for b, h in zip(found, held, strict=True) if h)
        if chars and chars * 2 >= total:
            return held, True
    decided = [0] * len(nodes)
    for b in found:
        if b.label == "text":
            decided[b.node] += len(b.text)
    for i in range(len(nodes) - 1, 0, -1):
        decided[nodes[i].parent] += decided[i]
    if not decided[0]:
        return [True] * len(found), False
    # children come after their parents: the last element with more than half of the text is the smallest one
    main = max(i for i, n in enumerate(decided) if n >= MOST * decided[0])
    holders = {node.parent for node in nodes if node.chars}
    if main and main not in holders:
        main = nodes[main].parent  # one long paragraph is not the whole article
    return _held_by(found, nodes, {main}), False


def _second_pass(found: list[Block], held: list[bool], marked_up: bool) -> None:
    """Open blocks get the label of the nearest decided ones; those apart from the article are no text."""
    n = len(found)
    for i, b in enumerate(found):
        if b.label == "other":
            # one link amid text; menus come as lists or in rows
            alone = b.links <= 1 and (marked_up or b.tag not in _CELLS) and not any(0 <= j < n and found[j].linked > LINKED * len(found[j].text) for j in (i - 1, i + 1))
            b.label = "open" if alone and held[i] else "other"
        if not marked_up and len(b.text) < LONG and b.label != "text" and _NOTICE.search(b.text):
            b.label = "other"
        if not held[i]:
            first = next((j for j in range(n) if held[j]), n)
            b.label = b.label if (b.label == "text" and len(b.text) >= LONG) or (b.tag == "h1" and b.label == "open" and i < first) else "other"
    before: list[tuple[int, str]] = []
    last = (-n, "")
    for i, b in enumerate(found):
        before.append(last)
        if b.label != "open" and held[i]:
            last = (i, b.label)
    last = (3 * n, "")
    for i in range(n - 1, -1, -1):
        b = found[i]
        if b.label != "open":
            if held[i]:
                last = (i, b.label)
            continue
        (p, left), (q, right) = before[i], last
        if b.tag in _HEADINGS and q == i + 1:  # a heading belongs to what it heads
            b.label = right
        elif not left or not right or left == right:
            b.label = left or right or "text"
        else:
            b.label = left if i - p < q - i else right if q - i < i - p else "text"
        if marked_up and b.label == "other" and not b.linked and not left == right == "other":
            b.label = "text"


def main_text(page: str | None) -> str:
    """The article of a page: its text blocks in page order, joined by an empty line."""
    found, nodes = blocks(page or "")
    _sums(found, nodes)
    found = _without_marked(found, nodes)
    for b in found:
        b.label = _first_pass(b)
    held, marked_up = _article(found, nodes)
    if marked_up:  # it holds all of the text
        found, held = [b for b, h in zip(found, held, strict=True) if h], [True] * sum(held)
    _second_pass(found, held, marked_up)
    return "\n\n".join(b.text for b in found if b.label == "text")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each row's whole html: page_id, url, text, n_chars (code points).

    A null or empty page has an empty text; null ids and urls stay null; repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows.
    """
    bounded_arrow(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(tidied(_extract), "page_id bigint, url string, text string, n_chars bigint")
