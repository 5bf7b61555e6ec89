"""Main text of web pages by tree scoring.

A page becomes a tree. Elements that by name, role, or a whole word of class or id are menus, headers,
footers, sidebars, notices, adverts, forms, reader comments or code are noise. A word of class or id that
states a layout (``has-sidebar``) is none, and an element named like noise that holds most of the
page's text, with the article in it, is pardoned. Of a header inside the article the headings stay.

Each paragraph gives points for its length and commas to its ancestors, fewer with distance; a
container's points are discounted by its share of link text; names such as ``article`` are a bonus. The
best container is kept, up to the article that it is part of, with the siblings that score enough or read
as prose. Inside, only noise, lists and boxes of links go; prose stays, however many links it has.

Defined results: null and empty pages have empty text; repeated rows repeat; unclosed elements,
comments and scripts end with the page; a quote in an unquoted attribute is a character; pages are read
whole, whatever their length and depth; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and words that name what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form button select option input menu dialog fieldset audio video map label".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead topbar footer foot sidebar side aside rail widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup "
    "login comment comments disqus respond replies reply share sharing social related recommended recommendations pagination pager toc skip search tags byline-links form copyright".split()
)
CONTENT_WORDS = frozenset("article content main post entry story body text page hentry".split())
BASE = {"article": 10, "main": 10, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "th": -5}
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table article section div main body html select".split())

#: What in a word of class or id makes it a statement about a layout or a state, not a name.
STATES = frozenset("has with without no not is js theme layout enabled disabled open closed active sticky visible".split())
#: Names of headers, of which headings stay where they are inside an article.
HEADERS = frozenset("header masthead".split())

# A quoted value begins right after its equals sign.
_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|([!?][^>]*)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|(/[^>]*)>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
#: Ancestors that a paragraph's points reach.
_LEVELS = 6
_COMMAS = re.compile("[,，、،;]")


class _Node:
    __slots__ = ("tag", "parent", "kids", "names", "noise", "header", "score", "base", "links", "anchors", "chars", "clean", "main", "skip")

    def __init__(self, tag: str, parent: _Node | None, names: frozenset = frozenset(), noise: int = 0, header: bool = False):
        self.tag, self.parent, self.kids, self.names = tag, parent, [], names
        #: 0 none, 1 by class or id, 2 by element, role or style.
        self.noise, self.header = noise, header
        self.score, self.base, self.links, self.anchors, self.chars = 0.0, 0, 0, 0, 0
        #: Characters outside noise; whether an article or main heading is inside.
        self.clean, self.main = 0, False
        self.skip = False


def _described(tag: str, attributes: str) -> tuple[frozenset, int, bool]:
    """Words of an element's class and id, whether it is noise, and whether for being a header."""
    noise, header = 2 * (tag in DROPPED or tag == "header"), tag == "header"
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return frozenset(), noise, header
    words: set[str] = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "role":
            noise = max(noise, 2 * (value.lower() in ROLES))
            header |= value.lower() == "banner"
        elif name == "style":
            noise = max(noise, 2 * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            noise = 2
        elif name in ("class", "id") and tag not in ("html", "body"):
            for token in value.split():
                parts = [x.lower() for x in _PART.findall(token)]
                words.update(parts)
                named = OTHER.intersection(parts)
                if named and not STATES.intersection(parts) and (tag != "main") and (tag != "article" or len(parts) == 1 or parts[-1] in OTHER):
                    header |= not noise and named <= HEADERS
                    noise = max(noise, 1)
    return frozenset(words), noise, header


def _tree(page: str) -> list[_Node]:
    """Elements in page order, the root first."""
    root = here = _Node("html", None)
    nodes = [root]
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            here.kids.append(page[at:])
            break
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        tag = m[4]
        if tag is None:
            continue
        tag = tag.lower()
        if m[3]:
            if tag == "br":
                here.kids.append(" ")
                continue
            up = here
            while up is not root and up.tag != tag:
                if up.tag in SCOPES and tag not in SCOPES:
                    up = root
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in ("html", "body"):
            if tag == "body":
                while here is not root:
                    here = here.parent
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            here.kids.append("" if tag == "wbr" else " ")
            if tag != "hr":
                continue
        if tag in BLOCK:
            up = here
            while up is not root and up.tag != "p" and (up.tag not in BLOCK or up.tag in HEADING):
                up = up.parent
            if up.tag == "p":
                here = up.parent
        closes = CLOSES.get(tag)
        if closes:
            up = here
            while up is not root and up.tag not in closes and up.tag not in SCOPES:
                up = up.parent
            if up.tag in closes:
                here = up.parent
                if tag == "tr" and here.tag == "tr":
                    here = here.parent
        if here.tag == "head" and tag not in RAW and tag not in VOID:
            here = here.parent
        if tag in RAW and not m[5].endswith("/"):
            end = _END[tag].search(page, at)
            at = n if end is None else page.find(">", end.end()) + 1 or n
            here.kids.append(" ")
            continue
        node = _Node(tag, here, *_described(tag, m[5]))
        here.kids.append(node)
        nodes.append(node)
        if tag not in VOID and not (m[5].endswith("/") and tag not in BLOCK):
            here = node
    return nodes


def _judge(nodes: list[_Node]) -> None:
    """Pardons what is only named like noise, and turns headers inside an article into their headings."""
    for node in reversed(nodes):
        own = sum(len(x.strip()) for x in node.kids if isinstance(x, str))
        node.chars += own
        node.clean += own
        if node.parent is not None and node.noise < 2:
            node.parent.chars += node.chars
            if not node.noise:
                node.parent.clean += node.clean
                node.parent.main |= node.main or node.tag in ("article", "main", "h1")
    total, clean = nodes[0].chars, nodes[0].clean
    inside: dict[int, bool] = {}
    for node in nodes:
        around = node.parent is not None and inside[id(node.parent)]
        if node.noise == 1 and 2 * node.chars > total and (node.main or 4 * clean < node.chars):
            node.noise = 0
            clean = max(clean, node.clean)
        if node.noise and node.header and around:
            node.noise = 0  # as a holder of headings
        elif not node.noise:
            node.header = False
        inside[id(node)] = not node.noise and not node.header and (around or node.tag in ("article", "main") or node.tag in ("div", "section") and bool(node.names & CONTENT_WORDS))
    for node in nodes:
        node.chars = 0


def _blocks(node: _Node, want_owner: bool) -> list:
    """Texts of blocks in page order; with owners: (text, owner, characters in links)."""
    found, words, state = [], [], [0]

    def flush(owner: _Node) -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                found.append((text, owner, state[0]) if want_owner else text)
        state[0] = 0

    # a header's text counts within its headings only
    stack = [(node, iter(node.kids), node, False, node.header)]
    while stack:
        here, kids, owner, link, mute = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                if mute:
                    continue
                words.append(kid)
                if link and not kid.isspace():
                    state[0] += len(kid)
                continue
            block = kid.tag in BLOCK
            if kid.skip or kid.noise:
                words.append(" ")
                continue
            if block:
                flush(owner)
            elif kid.tag in ("td", "th"):
                words.append(" ")
            stack.append((kid, iter(kid.kids), kid if block else owner, link or kid.tag == "a", (mute or kid.header) and kid.tag not in HEADING))
            break
        else:
            stack.pop()
            if here.tag in BLOCK or not stack:
                flush(owner)
            elif here.tag in ("td", "th"):
                words.append(" ")
    return found


def _score(nodes: list[_Node]) -> dict[int, _Node]:
    """Pass paragraphs' points up; returns the elements that got some."""
    scored: dict[int, _Node] = {}
    for text, owner, linked in _blocks(nodes[0], True):
        points = 0.0
        if owner.tag not in HEADING:
            points = 1 + len(_COMMAS.findall(text)) + len(text) / 100
        up = owner
        if up.tag in ("p", "pre", "blockquote", "li", "dd", "tr", "figcaption") and up.parent is not None:
            up = up.parent
        level = 0
        owner.chars += len(text)
        owner.links += linked
        while up is not None and points and level < _LEVELS:
            if id(up) not in scored:
                scored[id(up)] = up
                up.base = BASE.get(up.tag, 0) + 5 * bool(up.names & CONTENT_WORDS)
            up.score += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            up, level = up.parent, level + 1
    for node in reversed(nodes):
        node.anchors += node.tag == "a"
        if node.parent is not None and not node.noise:
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.anchors += node.anchors
    for node in scored.values():
        node.score = (node.score + node.base) * (1 - min(1.0, node.links / max(1, node.chars)))
    return scored


def _menu(node: _Node) -> bool:
    """Lists and boxes of links, and paragraphs of nothing but links."""
    if node.anchors < 2 or node.tag not in ("ul", "ol", "dl", "div", "section", "table", "p"):
        return False
    if node.tag != "p":
        return node.links > 0.6 * node.chars
    stack: list = list(node.kids)
    while stack:
        kid = stack.pop()
        if isinstance(kid, str):
            if any(c.isalnum() for c in html.unescape(kid)):
                return False
        elif kid.tag != "a" and not kid.noise:
            stack += kid.kids
    return True


def _whole(best: _Node) -> _Node:
    """The article that the best container is part of: its nearest ``article`` or ``main``, if that scores, or else containers named as content."""
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None and 4 * up.score >= best.score:
        return up
    while best.parent is not None and best.parent.tag in ("div", "section") and best.parent.names & CONTENT_WORDS:
        best = best.parent
    return best


def main_text(page: str | None) -> str:
    """The main text of one page: blocks joined by an empty line."""
    if not page:
        return ""
    nodes = _tree(page)
    _judge(nodes)
    scored = _score(nodes)
    if not scored:
        return "\n\n".join(_blocks(nodes[0], False))
    best = _whole(max(scored.values(), key=lambda x: x.score))
    kept: list = [best]
    if best.parent is not None:
        enough = max(10.0, 0.2 * best.score)
        named = best.tag in ("article", "main")
        titled = any(x.tag == "h1" and not x.noise for x in _within(best))
        kept, headings = [], []
        for kid in best.parent.kids:
            if not isinstance(kid, _Node):
                continue
            density = kid.links / max(1, kid.chars)
            bonus = 0.2 * best.score if kid.names and kid.names == best.names else 0
            prose = kid.tag in ("p", "pre", "blockquote") and density < 0.5 and (kid.chars > 80 or not named and best.parent.parent is not None)
            least = max(enough, 0.5 * best.score) if kid.tag == "article" else enough  # another article is another text
            if kid is best or kid.score - kid.base + bonus >= least and density < 0.5 or prose or kid.tag == "h1" and not titled:
                kept += headings * (not named) + [kid]
                headings = []
            elif kid.tag in HEADING and kid.tag != "h1":
                headings = [kid]
            elif kid.chars:
                headings = []
    holder = _Node("div", None)
    holder.kids = kept
    for node in nodes:
        node.skip = node is not best and _menu(node)
    return "\n\n".join(_blocks(holder, False))


def _within(node: _Node) -> Iterator[_Node]:
    stack = [node]
    while stack:
        here = stack.pop()
        yield here
        stack += [x for x in here.kids if isinstance(x, _Node)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page in batch.column("__html"):
            texts.append(main_text(page.as_py()).encode("utf-8", "replace").decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["__id", "__url", "text"])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Returns id, url and ``text`` for each page."""
    source = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    id_type, url_type = (source.schema[c].dataType.simpleString() for c in ("__id", "__url"))
    run: Callable = _extract
    return source.mapInArrow(run, f"__id {id_type}, __url {url_type}, text string").select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), "text")
