"""Main text of web pages by tag-path ratios.

A page is cut into tags and text. Every piece of text is a leaf whose path is
the list of its open block elements. Over the leaves of a path, text length and
sentence marks are added up; the ratio of each to the number of leaves tells
prose from menus. Both ratios are smoothed along the page and fused into one
score, less the share of linked text; the paths above a threshold are content.
The node that holds nearly all of their text (text inside ``article`` or
``main`` weighs more, but is no condition) is the main text, with the headings,
lists and cells between its paragraphs.

Names are evidence: an element whose class, id or role names a menu, a notice,
an advert or reader comments is left out, unless it holds most of the page's
content and so is a wrapper that is named after what stands in it.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import some, utf8

# fixed values: elements that start and end a block of text
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside"
    " form fieldset legend address blockquote pre figure figcaption details summary hr hgroup menu dir center dialog search".split()
)
#: Elements whose whole content is no text of the article.
SILENT = frozenset("head nav aside footer script style noscript template iframe object svg canvas audio video button select textarea datalist dialog menu".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold an article.
HOLDERS = frozenset(("article", "main"))
#: Words in class, id or role names of menus, sidebars, notices, adverts and forms.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " sidebar side aside complementary contentinfo footer foot masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe"
    " subscription signup login search share sharing social related recommended pagination pager widget toolbar skip".split()
)
#: Words in names of reader comments.
COMMENTS = frozenset("comment comments disqus respond reply replies discussion".split())
#: Words that turn a name around, and last words of the names of wrappers.
TURNED = frozenset("no non not has have with without hide".split())
WRAPS = frozenset("wrap wrapper container layout outer inner page site grid row main content article body entry post story".split())
HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
MARKS = ".,;:!?…。，、؟"

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
NAMED = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
HREF = re.compile(r"(?i)(?:^|\s)href\s*=")
WORD = re.compile(r"[a-z]+")
#: An element of the key ends open elements of the value inside the nearest of the last.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
#: End tags of other elements close nothing outside the nearest of these.
CELLS = frozenset("table caption td th".split())
#: Elements on a path; what lies deeper counts to the path it is in, and as side by side.
DEPTH = 200
#: Weight of a leaf's own path and of each neighbour in smoothing.
SMOOTH = (0.25, 0.5, 0.25)
#: Share of the page's mean score that a path needs to be content.
THRESHOLD = 0.6
#: Weight of text inside an article, and the share of the content's weight that a node must hold to be gone into.
HELD, CORE = 3.0, 0.8
#: Share of linked text above which a path that is no content is a menu.
LINKED = 0.6
#: Share of the content from which an element is a wrapper, whatever its name.
WRAPPER = 0.5
#: Elements that may be the node of the content.
NODES = frozenset("html body div section article main center td form dd".split())
HEADINGS = ("/h1", "/h2", "/h3", "/h4", "/h5", "/h6", "/hgroup")

#: What an element's names say: nothing, perhaps something to leave out, surely, reader comments.
PLAIN, MAYBE, SURELY, READERS = range(4)


class _Open:
    """An open element; ``held`` tells that an article is around it, ``wraps`` that one is in it."""

    __slots__ = ("parent", "name", "key", "silent", "held", "wraps", "says", "mass")

    def __init__(self, parent: _Open | None, name: str, key: str, silent: bool, held: bool, says: int):
        self.parent, self.name, self.key, self.silent, self.held, self.says = parent, name, key, silent, held, says
        self.wraps, self.mass = False, 0.0

    def line(self):
        """The element and all around it."""
        node = self
        while node is not None:
            yield node
            node = node.parent


#: An element (the nearest), its text, and its code points inside links.
Leaf = tuple[_Open, str, int]


def _silent(name: str, attributes: str, parent: _Open) -> bool:
    return parent.silent or name in SILENT or (name == "header" and not parent.held) or bool(attributes and HIDDEN.search(attributes))


def _says(name: str, attributes: str) -> int:
    """What the names of an element say, word by word for compound ones."""
    said = MAYBE if name == "form" else PLAIN
    if name in ("html", "body") or not attributes:
        return said
    for value in NAMED.findall(attributes):
        for token in value.strip("\"'").split():
            words = WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
            if not words or not TURNED.isdisjoint(words) or len(words) > 1 and words[-1] in WRAPS:
                continue
            if not COMMENTS.isdisjoint(words):
                return READERS
            if not NAMES.isdisjoint(words):
                said = max(said, SURELY if len(words) == 1 else MAYBE)
    return said


def blocks(page: str) -> list[Leaf]:
    """The page's text blocks that are not silent, in page order."""
    out: list[Leaf] = []
    stack = [_Open(None, "", "", False, False, PLAIN)]
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked, link, at = 0, 0, 0  # link: the open elements where a link began

    def end() -> None:
        nonlocal linked
        if text:
            top = stack[-1]
            whole = "" if top.silent else " ".join(references.unescape("".join(text)).split())
            if whole:
                out.append((top, whole, linked))
            text.clear()
        linked = 0

    def pop(names: set[str], within: frozenset | set[str]) -> None:
        """Closes the nearest open element of these names, unless one of ``within`` is nearer."""
        nonlocal link
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                end()
                opened.subtract(x.name for x in stack[i:])
                del stack[i:]
                if link > len(stack):  # a link that was never closed ends with its block
                    link = 0
                return
            if stack[i].name in within:
                return

    while True:
        tag = TAG.search(page, at)
        piece = page[at : tag.start() if tag else len(page)]
        if piece:
            text.append(piece)
            if link:
                linked += len(piece)
        if not tag:
            break
        at = tag.end()
        name = tag[1]
        if not name:
            continue
        name = name.lower()
        if tag[0][1] == "/":
            if name == "a":
                link = 0
            elif name == "br":
                text.append(" ")
            elif name in BLOCKS or name in SILENT:
                end()
                pop({name}, frozenset() if name in CELLS else CELLS)
            continue
        attributes = tag[2]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif name == "a":
            link = len(stack) if HREF.search(attributes) else 0
        elif name in VOID:
            text.append(" ")
            if name == "hr":
                end()
        elif name in BLOCKS or name in SILENT:
            end()
            if name != "head":
                pop({"head"}, BLOCKS)
            if name in BLOCKS:
                pop({"p"}, BLOCKS - {"p"})
            if name in ENDS:
                pop(*ENDS[name])
            if name == "svg" and attributes.endswith("/"):
                continue
            parent = stack[-1]
            key = f"{parent.key}/{name}" if len(stack) < DEPTH else parent.key
            silent, says = _silent(name, attributes, parent), _says(name, attributes)
            holds = name in HOLDERS and not silent and says < SURELY
            if holds:
                for x in parent.line():
                    if x.wraps:
                        break
                    x.wraps = True
            around = parent if len(stack) < DEPTH else parent.parent
            stack.append(_Open(around, name, key, silent, parent.held or holds, says))
            opened[name] += 1
    end()
    return out


def path_scores(leaves: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """Of each leaf the score of its path, and whether the path is linked text."""
    paths = {key: i for i, key in enumerate(dict.fromkeys(node.key for node, _, _ in leaves))}
    at = np.array([paths[node.key] for node, _, _ in leaves])
    size = np.array([len(text) for _, text, _ in leaves], float)
    marks = np.array([sum(text.count(m) for m in MARKS) for _, text, _ in leaves], float)
    linked = np.minimum([x[2] for x in leaves], size)
    n = np.bincount(at).astype(float)
    ratios = [np.bincount(at, v)[at] / n[at] for v in (size, marks)]
    smooth = [np.convolve(np.concatenate([r[:1], r, r[-1:]]), SMOOTH, "valid") for r in ratios]
    share = np.bincount(at, linked) / np.bincount(at, size)
    fused = np.bincount(at, smooth[0] * (1 + smooth[1])) / n * (1 - share)
    return fused[at], share[at] > LINKED


def _content(leaves: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """Which leaves are on content paths, and which on paths of links; the weight of the first is added up in all elements around them."""
    score, links = path_scores(leaves)
    chosen = (score > 0) & (score >= THRESHOLD * score.mean())
    for node, _, _ in leaves:
        for x in node.line():
            x.mass = 0.0
    for (node, text, _), yes in zip(leaves, chosen.tolist()):
        if yes:
            weight = len(text) * (HELD if node.held else 1.0)
            for x in node.line():
                x.mass += weight
    return chosen, links


def _left_out(node: _Open, whole: float) -> bool:
    """Whether the names of an element or of one around it tell that it is no part of the article."""
    return any(x.says and not (x.mass >= WRAPPER * whole and (x.says == MAYBE or x.wraps and x.says == SURELY)) for x in node.line())


def main_text(page: str) -> str:
    """The article's blocks in page order, one a line."""
    leaves = blocks(page)
    if leaves and any(x.says for node, _, _ in leaves for x in node.line()):
        _content(leaves)
        top = next(x for x in leaves[0][0].line() if x.parent is None)
        leaves = [x for x in leaves if not _left_out(x[0], top.mass)]
    if not leaves:
        return ""
    chosen, links = _content(leaves)
    node = _node(leaves)
    inside = [any(x is node for x in leaf[0].line()) for leaf in leaves]
    if node.name in ("", "html", "body"):
        # nothing but its place tells what stands beside the content
        first, last = int(np.argmax(chosen)), len(chosen) - 1 - int(np.argmax(chosen[::-1]))
        while first and leaves[first - 1][0].key.endswith(HEADINGS):
            first -= 1
        inside = [yes and first <= i <= last for i, yes in enumerate(inside)]
    menu = links & ~chosen
    return "\n".join(text for (at, text, _), yes, linked in zip(leaves, inside, menu) if yes and (at.held or not linked))


def _node(leaves: list[Leaf]) -> _Open:
    """The innermost element that holds nearly all of the content and its title; an article is not gone into, unless for one inside it."""
    children: dict[int, dict[int, _Open]] = {}
    titles = []
    for node, _, _ in leaves:
        for x in node.line():
            if x.parent is None:
                top = x
            else:
                children.setdefault(id(x.parent), {})[id(x)] = x
        if "/h1" in node.key:
            titles.append(node)
    at = top
    while True:
        best = max((x for x in children.get(id(at), {}).values() if x.name in NODES), key=lambda x: x.mass, default=None)
        if best is None or best.mass < CORE * top.mass or at.name == "article" and not best.wraps and best.name != "article":
            return at
        # a title beside the next element, and not in a larger one of its own, belongs to the content
        if at.name not in ("", "html", "body") and not best.held and any(not any(x is best for x in t.line()) and any(x is at for x in t.line()) for t in titles):
            return at
        at = best


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in the column ``out``.

    Character references are decoded, white space inside a block becomes one
    space, blocks without text are left out, and blocks are joined by a line
    end. Null and empty pages, and pages without text, give the empty text.
    Rows are read one by one, repeated ones alike. A column already named
    ``out`` is replaced; all others are kept, whatever their names.
    """

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(t.decode("utf-8", "replace")) for _, part in some(batch) for t in part.to_pylist()], pa.string())

    return pages.withColumn(out, run(utf8(F.col(f"`{html_col}`"))))


def report(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = extract(pages.select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
