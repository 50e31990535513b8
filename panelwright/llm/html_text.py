"""Main text of web pages by tree scoring.

Parts that are never main text (scripts, navigation, forms, and elements whose class, id or role says advert, comment,
sidebar and the like) leave the tree first. A name says so if it ends in such a word ("reader-comments", "ad-slot"); one that only
holds it ("side-effects") lowers the points of an element in an article or with much text. Every paragraph earns points for being there, for its length and for its
commas; it passes them to its parent, half of them to the grandparent, a third to the next, less at each step. An ancestor's
points are discounted by the share of its text that is links. The best container is kept (in an article or main element, that
element), and those of its siblings that reach a fifth of its points, bear the same tag and names, or are plain paragraphs beside
it; nothing inside them is dropped or cut. Tags are read as HTML has it, and in time proportional to the page, whatever is left open.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TAG = r"<(/?)([a-zA-Z][^\s/>]*+)"
_OTHER = r"<!--(?:-?>|.*?(?:--!?>|(?P<open>\Z)))|<[!?][^>]*+>"
#: A quote opens a value only behind an equals sign; one that is never closed is part of the value.
_VALUE = r"\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)"
_NAME = r"=?[^\s/>=]++|="
_TOKEN = re.compile(rf"{_TAG}((?:[\s/]++|(?:{_NAME})(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+)*+)>|(<)/?[a-zA-Z]|{_OTHER}", re.S)
#: Once a tag finds no end outside its quotes, quotes are looked at no more.
_UNQUOTED = re.compile(rf"{_TAG}([^>]*+)>|{_OTHER}", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+(?:{_VALUE})?+)?+")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text that no tag but their own end tag interrupts.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
BLOCKS = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul").split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt td h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when the named ones begin.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: Where the search for an element to end stops.
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist"), "body": ("html",)}
NEVER = frozenset("head script style noscript template nav aside footer form iframe object embed applet svg math canvas audio video button select textarea input dialog menu search title".split())
NEVER_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id that mark what is not main text.
NEVER_WORDS = frozenset(("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner comment comments commentlist disqus reply replies respond "
                         "sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal "
                         "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toc skip hidden offscreen").split())
#: Words behind which a name says nothing more about what an element is.
STRUCTURAL = frozenset("list lists item items section area wrap wrapper container box block bar top bottom left right thread count counter link links posts articles stories button buttons icon icons "
                       "inner outer row col column panel module unit slot holder form header title heading body text group zone region".split())
#: A layout that has, or lacks, such a part.
WITH = frozenset("has with no without".split())
#: Ordinary nouns: ids in articles, and of elements that begin with a heading, are often made of titles; a class may mark a remark.
PLAIN_IDS = frozenset("side rail share sharing skip foot hidden reply replies respond menu login signup alert notice notices overlay modal popup banner promotion social subscription toc".split())
PLAIN_CLASSES = frozenset("side skip foot alert notice notices".split())
#: Ordinary nouns that parts of an article may be about: such a part stays if it has much text.
SUBJECTS = frozenset("share sharing social menu rail".split())
#: Words of readers' remarks, which articles within articles may be.
REMARKS = frozenset("comment comments reply replies respond".split())
#: Characters of unlinked paragraphs that are much text, and what is left of an element's points if a name casts doubt on it.
MUCH_TEXT = 200
DOUBT = 0.2
#: Words that keep an element whatever other names its class has; one of NEVER_WORDS behind it in the same name wins.
KEEP_WORDS = frozenset("article content main post entry story".split())
BONUS = {"article": 25.0, "main": 15.0}


class _Node:
    __slots__ = ("tag", "words", "role", "children", "parent", "points", "text", "linked", "names", "doubt", "plain", "hidden")

    def __init__(self, tag: str, parent=None, words=(), role: str = "", names=()):
        self.tag, self.parent, self.words, self.role, self.names, self.doubt, self.hidden = tag, parent, words, role, names, False, False
        self.children: list = []
        self.points, self.text, self.linked = 0.0, 0, 0
        self.plain = None


def _attributes(raw: str) -> tuple[list, str, bool, list]:
    """Words of class and id, the role, whether the element is hidden, and each name: whether it is an id, and its words."""
    words, role, hidden, names = [], "", False, []
    if raw and not raw.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), html.unescape(a or b or c)
            if name in ("class", "id"):
                for one in value.split():
                    parts = [w.lower() for w in _PART.findall(one)]
                    names.append((name == "id", parts))
                    words += parts
            elif name == "role":
                role = value.strip().lower()
            hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower())
    return words, role, hidden, names


def parse(page: str) -> _Node:
    """A tree of elements and texts; end tags that are missing are implied, those without a beginning are ignored."""
    root = _Node("html")
    stack = [root]
    depths: dict[str, list] = {}  # places of the open elements of a tag in the stack, ascending

    def close(depth: int) -> None:
        for node in reversed(stack[depth:]):
            depths[node.tag].pop()
        del stack[depth:]

    at, size, ends = 0, len(page), page.rfind(">") + 1
    token, start = _TOKEN, 0
    while (m := token.search(page, start, ends)) is not None:
        if token is _TOKEN and m[4]:
            token = _UNQUOTED
            continue
        if m.start() > at:
            stack[-1].children.append(page[at:m.start()])
        at = start = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            if m["open"] is not None:  # a comment without an end
                return root
            continue
        if m[1]:
            if depths.get(tag):
                close(depths[tag][-1])
            continue
        if tag == "html":
            continue
        if tag in BLOCKS or tag in ENDS:
            ending, scope = (("p",), ("td", "th", "button", "object")) if tag not in ENDS else ((*ENDS[tag], "p"), SCOPE[tag])
            floor = max((depths[t][-1] for t in scope if depths.get(t)), default=0)
            inside = [d[bisect_right(d, floor)] for d in map(depths.get, ending) if d and d[-1] > floor]
            if inside:
                close(min(inside))
        words, role, hidden, names = _attributes(m[3])
        child = _Node(tag, stack[-1], words, role, names)
        child.hidden = hidden
        stack[-1].children.append(child)
        if tag in RAW:
            # Searched in the page itself: lower() moves what stands behind letters like U+0130.
            end = _RAW_END[tag].search(page, at)
            close_at = page.find(">", end.end()) if end else -1
            at = start = size if close_at < 0 else close_at + 1
        elif tag not in VOID and m[3] != "/" and m[3][-2:] not in (' /', '"/', "'/"):
            depths.setdefault(tag, []).append(len(stack))
            stack.append(child)
    if at < size:
        stack[-1].children.append(page[at:].partition("<!--")[0])
    return root


def _unwanted(node: _Node, inside: bool) -> bool:
    """``inside``: within an article or main element, whose own header may hold its title."""
    if node.hidden or node.tag in NEVER or node.role in NEVER_ROLES:
        return True
    if node.tag == "header":
        return not inside
    if node.tag in ("body", "main") or not NEVER_WORDS.intersection(node.words):
        return False
    if node.tag == "article":
        return _says(node, *node.names[0], inside) == "never" or any(_is_remark(parts) for _, parts in node.names)
    said = {_says(node, own_id, parts, inside) for own_id, parts in node.names}
    if "behind" in said:
        return True
    if inside and NEVER_WORDS.intersection(node.words) <= SUBJECTS and _paragraph_text(node) >= MUCH_TEXT:
        node.doubt = True
        return False
    if KEEP_WORDS.intersection(node.words) or not said & {"never", "doubt"}:
        return False
    if "never" in said:
        return True
    node.doubt = True
    return not inside and _paragraph_text(node) < MUCH_TEXT


def _is_remark(parts: list) -> bool:
    return not REMARKS.isdisjoint(parts) and all(w in REMARKS or w in KEEP_WORDS or w in STRUCTURAL or len(w) == 1 for w in parts)


def _says(node: _Node, own_id: bool, parts: list, inside: bool) -> str:
    """What a name says: "never" main text, the same "behind" a word that keeps, "doubt", or nothing."""
    never = NEVER_WORDS.intersection(parts)
    if not never or parts[0] in WITH:
        return ""
    last = len(parts)
    while last and (parts[last - 1] in STRUCTURAL or len(parts[last - 1]) == 1):
        last -= 1
    sure = last and parts[last - 1] in NEVER_WORDS
    if own_id:
        if node.tag in PARAGRAPHS:
            return ""
        headed = _begins_with_heading(node)
        if headed and not all(w in NEVER_WORDS or w in STRUCTURAL or w in KEEP_WORDS or len(w) == 1 for w in parts):
            return ""
        if (headed or inside) and never <= PLAIN_IDS:
            return ""
    elif inside and never <= PLAIN_CLASSES:
        return ""
    if not sure:
        return "doubt"
    return "behind" if KEEP_WORDS.intersection(parts[:last]) else "never"


def _begins_with_heading(node: _Node) -> bool:
    for _ in range(4):
        first = next((c for c in node.children if not isinstance(c, str) or not c.isspace()), None)
        if first is None or isinstance(first, str):
            return False
        if first.tag in HEADINGS:
            return True
        node = first
    return False


def _paragraph_text(node: _Node) -> int:
    """Characters of paragraphs without their links. Every node of a page is counted once."""
    if node.plain is None:
        todo, order = [node], []
        while todo:
            at = todo.pop()
            order.append(at)
            todo += [c for c in at.children if not isinstance(c, str) and c.plain is None]
        for at in reversed(order):
            below = [c.plain for c in at.children if not isinstance(c, str) and c.tag != "a" and c.tag not in NEVER]
            whole = sum(len(c.strip()) for c in at.children if isinstance(c, str)) + sum(whole for whole, _ in below)
            at.plain = (whole, whole if at.tag in PARAGRAPHS else sum(counted for _, counted in below))
    return node.plain[1]


def _prune(root: _Node) -> None:
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _unwanted(c, inside)]
        if node.tag == "header":
            node.children = [c for c in node.children if not isinstance(c, str) and c.tag in HEADINGS]
        stack += [(c, inside) for c in node.children if not isinstance(c, str)]


def _in_order(root: _Node) -> list:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def _score(nodes: list) -> None:
    commas: dict[int, int] = {}
    for node in reversed(nodes):  # children come before their parents
        own = [c for c in node.children if isinstance(c, str)]
        node.text += sum(len(" ".join(c.split())) for c in own)
        commas[id(node)] = commas.get(id(node), 0) + sum(c.count(",") for c in own)
        if node.tag == "a":
            node.linked = node.text
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
            if node.tag not in BLOCKS:
                commas[id(node.parent)] = commas.get(id(node.parent), 0) + commas[id(node)]
    for node in nodes:
        holds_text = node.tag in PARAGRAPHS or any(isinstance(c, str) and not c.isspace() for c in node.children)
        if not node.text or not holds_text or node.tag not in BLOCKS:
            continue
        points = 1 + commas[id(node)] + min(node.text / 100, 3)
        up = node.parent if node.tag in PARAGRAPHS else node
        step = 1
        while up is not None and step <= 5:
            up.points += points / step
            up, step = up.parent, step + 1
    for node in nodes:
        if node.points:
            node.points = (node.points + BONUS.get(node.tag, 0.0)) * (1 - node.linked / max(node.text, 1)) * (DOUBT if node.doubt else 1)


def _kept(root: _Node) -> list:
    nodes = _in_order(root)
    _score(nodes)
    best = max(nodes, key=lambda n: n.points)
    if not best.points:
        return [root] if root.text and root.linked < root.text else []
    up, article = best, None
    while up is not None:  # the outermost article, or else the main element
        if up.tag == "article" or (up.tag == "main" and article is None):
            article = up
        up = up.parent
    best = article or best
    if best.parent is None:
        return [best]
    out = []
    for c in best.parent.children:
        if isinstance(c, str):
            continue
        plain = c.tag in PARAGRAPHS and c.text and c.linked * 4 < c.text
        alike = c.tag == best.tag != "article" and c.names == best.names and c.text
        if c is best or ((c.points >= 0.2 * best.points or alike) and c.linked * 2 < c.text) or plain:
            out.append(c)
    return out


def main_text(page: str) -> str:
    """The blocks of the main text, each on a line."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    blocks, line = [], []

    def end():
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in _kept(root):
        stack = [top]
        while stack:
            node = stack.pop()
            if node is None:
                end()
            elif isinstance(node, str):
                line.append(node)
            elif node.tag == "br":
                line.append(" ")
            elif node.tag in BLOCKS:
                end()
                stack.append(None)
                stack += reversed(node.children)
            else:
                stack += reversed(node.children)
        end()
    return "\n".join(blocks)


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    * A null or empty html, and a page of nothing but menus, scripts and the like, give an empty text.
    * Text that is not marked up at all is kept as one block. Null page_ids and urls are returned as they are; repeated rows
      are extracted one by one. An empty table gives an empty result. Other columns are ignored.
    """
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
