"""Main text of web pages by composite text density.

A tolerant parser builds the tree of block elements; inline elements belong to the block around
them and count as its tags. What is never article text is left out of the tree's text: scripts,
styles, forms, navigation, asides, page headers and footers, hidden elements, and elements whose
class, id or role names a menu, sidebar, notice, advert or comments, unless they hold most of
the page's text. A class names such a thing if it is one of the words of `CHROME`, or made of them and of
words for boxes (`cookie-banner`, `ad_slot-2`); a paragraph or another element of running text only
if it is such a word (`ad`, not `ad-note`).

For every node the composite density is its characters per tag, adjusted by the share of its
characters and tags that are links; a node's density sum adds up the densities of its children
(text of its own, with the inline elements in it, counts as a child). The node of the largest sum is
the core; the least density on the path from it to the body is the threshold, and every other node
outside it that reaches the threshold gives the largest-sum node of its own subtree too. The main text
runs over all chosen nodes, and the headings between them. Only then, where chosen nodes lie in
article elements, is each of them widened to its outermost article, so that titles and short
paragraphs beside it stay: density alone picks the articles.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, runs

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source map area".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never article text.
OUT = frozenset("script style noscript template iframe object embed svg canvas audio video map form button select option textarea input label fieldset datalist output progress meter nav footer aside menu dialog head title noframes noembed xmp search".split())
#: An open element that the start of another one closes, and where the search for it stops.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)), "tfoot": (("thead", "tbody", "tr"), ("table",))}
#: Words of a class, id or role that mark what isn't article text.
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus "
    "footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion "
    "related recommended rail reply replies respond search share sharing shares sidebar sidebars signup skip social sponsor sponsored subscribe toolbar topbar widget widgets "
    "contentinfo complementary alert dialog toc teaser teasers".split()
)
#: Words that only say what kind of box it is: beside a word of CHROME they change nothing.
BOXES = frozenset(
    "area bar block blocks bottom box boxes btn button buttons card cards column columns container content desktop fixed global group holder icon icons inner item items left link links list "
    "main middle mobile module outer page panel placeholder posts primary right row secondary section site slot slots static sticky top unit units wrap wrapper zone".split()
)
#: Elements of running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption".split())

_TOKEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s/>]|$)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "up", "kids", "chrome", "chars", "tags", "own_tags", "link_chars", "link_tags", "own_link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, chrome: bool):
        self.tag, self.up, self.kids, self.chrome = tag, up, [], chrome  # kids: nodes, and (text, in a link) of the block's own
        self.tags = self.link_tags = 0


def _is_chrome(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in OUT or (tag == "header" and not inside_article):
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in _PART.findall(word)]
                named = [p for p in parts if p in CHROME or p == "header" and not inside_article]
                if named and (len(parts) == 1 or tag not in PROSE and all(p in CHROME or p == "header" or p in BOXES or p.isdigit() for p in parts)):
                    return True
    return False


class Frame:
    """An open block element, and the inline elements open in it."""

    __slots__ = ("tag", "node", "open", "count", "linked")

    def __init__(self, tag: str, node: Node, linked: bool):
        self.tag, self.node, self.open, self.count, self.linked = tag, node, [], Counter(), linked

    def in_link(self) -> bool:
        return self.linked or self.count["a"] > 0


def parse(page: str) -> Node:
    """The tree of block elements of a page. Every step takes time in proportion to what it closes."""
    root = Node("#page", None, False)
    stack, opened = [Frame("#page", root, False)], defaultdict(list)  # of each element name the places in the stack where it is open
    at, n = 0, len(page)
    last = page.rfind(">") + 1  # no tag can end beyond it, so none is looked for there

    def pop() -> None:
        opened[stack.pop().tag].pop()

    while at < n:
        token = _TOKEN.search(page, at, last) if at < last else None
        end = token.start() if token else n
        if end > at:
            stack[-1].node.kids.append((entities.unescape(page[at:end]), stack[-1].in_link()))
        if not token:
            break
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            if page.startswith("!--", token.start() + 1) and not page.endswith(("-->", "--!>", "<!-->", "<!--->"), token.start(), at):
                break  # a comment without an end
            continue
        tag, closing, attrs, top = tag.lower(), token[1] or token[4], token[3] or token[6] or "", stack[-1]
        if closing:
            if top.count[tag]:  # inline end tags close nothing beyond their block
                while (name := top.open.pop()) != tag:
                    top.count[name] -= 1
                top.count[tag] -= 1
            elif opened[tag]:
                while top.tag != tag:
                    pop()
                    top = stack[-1]
                pop()
            continue
        if tag in CLOSES_P and top.tag == "p" or tag in HEADINGS and top.tag in HEADINGS:
            pop()
        elif tag in IMPLIED:
            names, stops = IMPLIED[tag]
            nearest = max((opened[x][-1] for x in names if opened[x]), default=-1)
            if nearest > max((opened[x][-1] for x in stops if opened[x]), default=-1):
                while len(stack) > nearest:
                    pop()
        top = stack[-1]
        inside = bool(opened["article"] or opened["main"])
        if tag in INLINE and not (attrs and tag not in VOID and _is_chrome(tag, attrs, inside)):
            top.node.tags += 1
            top.node.link_tags += tag == "a"
            if tag == "br":
                top.node.kids.append((" ", False))
            elif tag not in VOID and not attrs.endswith("/"):
                top.open.append(tag)
                top.count[tag] += 1
            continue
        if tag in VOID:
            continue
        node = Node(tag, top.node, _is_chrome(tag, attrs, inside))
        top.node.kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else n
            if not node.chrome:
                node.kids.append((page[at:stop], False))
            at = n if not close else (page.find(">", stop) + 1 or n)
        elif not attrs.endswith("/") or tag in CLOSES_P:
            opened[tag].append(len(stack))
            stack.append(Frame(tag, node, top.in_link()))
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, parents before children; without recursion, as pages may be nested deeply."""
    out = [root]
    for node in out:
        out += [k for k in node.kids if isinstance(k, Node)]
    return out


def _size(text: str) -> int:
    return len(" ".join(text.split()))


def _spare(nodes: list[Node]) -> None:
    """A named element isn't chrome if it holds the page: a body, a wrapper of the article or of the
    first heading, or most of the text of a page without an article (a body of class `has-sidebar`)."""
    own, holds = {}, {}
    for node in reversed(nodes):
        kids = [k for k in node.kids if isinstance(k, Node) and k.tag not in OUT]
        own[node] = sum(own[k] for k in kids) + sum(len(k[0]) for k in node.kids if not isinstance(k, Node))
        holds[node] = any(holds[k] or k.tag in ("article", "main", "h1") and not k.chrome for k in kids)
    total, whole = own[nodes[0]], any(x.tag in ("article", "main") and not x.chrome for x in nodes)
    for node in nodes:
        if node.chrome and node.tag not in OUT and node.tag != "header" and own[node] * 2 > total:
            node.chrome = not (node.tag in ("html", "body", "main") or holds[node] or not whole and own[node] * 5 > total * 4)


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars = node.link_chars = 0
        node.own_tags, node.own_link_tags = node.tags, node.link_tags
        for k in node.kids:
            if isinstance(k, Node):
                if not k.chrome:
                    node.chars += k.chars
                    node.link_chars += k.link_chars
                    node.tags += k.tags + 1
                    node.link_tags += k.link_tags
            else:
                size = _size(k[0])
                node.chars += size
                node.link_chars += size * k[1]
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        own = [k for k in node.kids if not isinstance(k, Node)]
        text = sum(_size(k[0]) for k in own)
        node.total = sum(k.density for k in node.kids if isinstance(k, Node) and not k.chrome)
        if text:
            node.total += _density(text, node.own_tags, sum(_size(k[0]) for k in own if k[1]), node.own_link_tags, share)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / max(1, tags) * math.log1p(chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)) / max(1.0, base)


def _article(node: Node | None) -> Node | None:
    """The outermost article around `node`, itself included."""
    found = None
    while node:
        found = node if node.tag == "article" else found
        node = node.up
    return found


def _chosen(nodes: list[Node]) -> list[Node]:
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    shown, hidden = [], set()
    for node in nodes:
        if node.chrome or node.up in hidden:
            hidden.add(node)
        else:
            shown.append(node)
    if not shown:
        return []
    core = max(shown, key=lambda x: x.total)
    if not core.total:
        return []
    threshold, up = core.density, core
    while up is not body and up.up:
        up = up.up
        threshold = min(threshold, up.density)
    best = {}
    for node in reversed(shown):
        best[node] = max([node, *(best[k] for k in node.kids if isinstance(k, Node) and k in best)], key=lambda x: x.total)
    marked, covered, todo = [], set(), [body]
    ancestors = set()
    up = core
    while up:
        ancestors.add(up)
        up = up.up
    while todo:
        node = todo.pop()
        if node not in best or node in covered:
            continue
        if node not in ancestors and node.density >= threshold and node.total:
            marked.append(best[node])
            covered.update(_order(best[node]))
            if best[node] is node:
                continue
        if node is core:
            marked.append(core)
            continue
        todo += [k for k in node.kids if isinstance(k, Node)]
    wide = [_article(node) or node for node in marked or [core]]
    return list(dict.fromkeys(wide))


def _blocks(top: Node, wanted: set | None) -> list[str]:
    """Text of the blocks under `top` in page order; with `wanted`, only under those nodes, and headings between them."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(parts).split()):
            out.append(line)
        parts.clear()

    todo: list = [(top, wanted is None)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
            continue
        node, on = item
        if not isinstance(node, Node):
            if on:
                parts.append(node[0])
            continue
        if node.chrome:
            if node.tag not in INLINE:
                flush()
            continue
        on = on or wanted is not None and (node in wanted or node.tag in HEADINGS)
        flush()
        todo.append(None)
        todo += [(k, on) for k in reversed(node.kids)]
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    if not page:
        return ""
    nodes = _order(parse(page))
    _spare(nodes)
    _measure(nodes)
    chosen = _chosen(nodes)
    if not chosen:
        return ""
    if len(chosen) == 1:
        return "\n".join(_blocks(chosen[0], None))
    paths = []
    for node in chosen:
        path = []
        while node:
            path.append(node)
            node = node.up
        paths.append(path[::-1])
    common = 0
    while all(len(p) > common and p[common] is paths[0][common] for p in paths):
        common += 1
    return "\n".join(_blocks(paths[0][common - 1], set(chosen)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches, text=2):
        texts = [extract(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """One row for each row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    text: blocks in page order joined by one line feed, white space inside a block as one space,
    character references decoded; empty for null, empty and textless pages. n_chars: its code
    points. Pages are taken whole, however long or broken. Repeated rows each give a row; other
    columns are ignored; an empty table gives an empty result.
    Sets the session's rows of an Arrow batch (`common.bounded`).
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return bounded(slim).mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
