"""Main text of web pages by tag-path ratios (operator 6).

A page is cut into text nodes.  Nodes with the same root-to-leaf tag path share
statistics: characters and punctuation marks for each block, where text of links counts
nothing.  The fused ratio of a path is (characters / blocks) x (1 + marks / blocks); it is
smoothed over neighbouring runs of one path, and paths above a share of the best one hold
content.  The smallest container that encloses nearly all of that content is the
article.  All of an article or main element is taken, captions, terms and references included; of another container
what lies between its first and last part with content, but for parts that are mostly links.  Lists of nothing but
short links, or before any text, are menus and left out.

Names of elements that are never main text (navigation, footers, forms, adverts, notices, reader comments: by tag, role,
or a class or id made of such words alone) only help: their text counts nothing in the ratios and is not taken.  Where a
page holds such parts beside the article, the ratios leave them out without any name.

Every step is linear in the page: open elements are counted, paths and elements have numbers.

Defined results: null or empty html, or a page without content, gives an empty
text; unclosed and stray tags are tolerated; rows, repeated or not, are independent of each other;
a column named exactly as the new one is replaced, other columns stay, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .anyname import field, kept_fields, map_arrow

RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|select|audio|video|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("nav footer aside form button menu dialog fieldset head".split())
OWN_SIBLING = frozenset("p li dt dd tr td th option".split())
# parts of class names and ids that say what is no main text; a name counts if all its parts are of one of the two kinds
_BAD = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot sponsor sponsors sponsored promo promos promotion banner nav navi navigation navbar menu menus breadcrumb breadcrumbs sidebar sidebars aside "
    "widget widgets footer footers foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager skip copyright hidden".split()
)
_PLAIN = frozenset("site page main top bottom left right inner outer list item items box container wrapper wrap block section area bar panel unit slot link links button buttons primary secondary global header text content form group row col column media icons sr only to google dfp thread area count title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_PUNCT = re.compile(r"[.,;:!?…、。，！？]")
SHARE, INSIDE = 0.08, 0.8
SHORT, SENTENCE = 25, 40


def _out(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not inside_article):
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in _NAMES.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "hidden" and not m[0].lower().startswith("hidden-") or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main", "article") and any(map(_bad, value.lower().split())):
            return True
    return False


def _bad(name: str) -> bool:
    parts = [x for x in re.split(r"[-_\d]+", name) if x]
    return any(x in _BAD for x in parts) and all(x in _BAD or x in _PLAIN for x in parts) or "sr-only" == name


class Node:
    """A text node: path and element numbers, block number, parts of its text, and whether it is in a link or a named part."""

    __slots__ = ("path", "element", "block", "parts", "linked", "named")

    def __init__(self, path: int, element: int, block: int, text: str, linked: bool, named: bool):
        self.path, self.element, self.block, self.parts, self.linked, self.named = path, element, block, [text], linked, named

    @property
    def text(self) -> str:
        return "".join(self.parts)


class Page:
    """Text nodes of a page and its block elements, numbered as they open: the elements inside e are e to end[e] - 1."""

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.parent, self.end, self.tag = [-1], [0], [""]
        self._paths: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # open elements: tag, element, path, named
        self._outer: list[int] = [0]  # places of the block elements in the stack
        self._open: dict[str, int] = defaultdict(int)
        self._block = 0
        for m in _TOKEN.finditer(page):
            if m["text"] is not None:
                self._text(m["text"])
            elif m["tag"]:
                self._tagged(m["tag"].lower(), m["attrs"], bool(m["close"]))
        self._cut(1)
        self.end[0] = len(self.parent)

    def _cut(self, at: int) -> None:
        """Closes the elements from that place of the stack on."""
        while len(self._stack) > at:
            tag, element, _, _ = self._stack.pop()
            self._open[tag] -= 1
            if self._outer[-1] == len(self._stack):
                self._outer.pop()
                self.end[element] = len(self.parent)

    def _text(self, text: str) -> None:
        _, element, path, named = self._stack[-1]
        shown = entities.unescape(text)
        if shown.strip():
            self.nodes.append(Node(path, element, self._block, shown, self._open["a"] > 0, named))
        elif self.nodes and self.nodes[-1].block == self._block:
            self.nodes[-1].parts.append(" ")

    def _tagged(self, tag: str, attrs: str, close: bool) -> None:
        if tag == "br" and self.nodes and self.nodes[-1].block == self._block:
            self.nodes[-1].parts.append(" ")
        if tag in VOID:
            self._block += tag == "hr"
            return
        inline = tag in INLINE
        if close:
            if not self._open[tag]:
                return
            at = len(self._stack) - 1
            while self._stack[at][0] != tag:
                at -= 1
            self._cut(at)
        else:
            if not inline:
                top = self._stack[self._outer[-1]][0]
                if top == "p" or (top == tag and tag in OWN_SIBLING):
                    self._cut(self._outer[-1])
            if not attrs.endswith("/") or tag in ("p", "div"):
                _, element, path, named = self._stack[-1]
                if not inline or tag == "a":
                    path = self._paths.setdefault((path, tag), len(self._paths) + 1)
                named = named or _out(tag, attrs, self._open["article"] > 0)
                if not inline:
                    self.parent.append(element)
                    self.end.append(0)
                    self.tag.append(tag)
                    element = len(self.parent) - 1
                    self._outer.append(len(self._stack))
                self._stack.append((tag, element, path, named))
                self._open[tag] += 1
        if not inline:
            self._block += 1


def path_ratios(found: list[Node]) -> dict[int, float]:
    """Fused ratio of every path: characters for each block times (1 + marks for each block)."""
    chars, marks, count, last = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for x in found:
        if last.get(x.path) != x.block:
            count[x.path] += 1
            last[x.path] = x.block
        if not (x.linked or x.named):
            chars[x.path] += len(x.text.strip())
            marks[x.path] += len(_PUNCT.findall(x.text))
    return {p: chars[p] / n * (1 + marks[p] / n) for p, n in count.items()}


def smoothed(found: list[Node], fused: dict[int, float]) -> list[float]:
    """For every node, the Gaussian mean of the ratios of its run of one path and two runs on either side."""
    run, values = [], []
    for i, x in enumerate(found):
        if not i or x.path != found[i - 1].path:
            values.append(fused[x.path])
        run.append(len(values) - 1)
    weights = [math.exp(-0.5 * k * k) for k in range(-2, 3)]
    mean = [sum(w * values[j] for w, j in zip(weights, range(i - 2, i + 3), strict=True) if 0 <= j < len(values)) / sum(weights) for i in range(len(values))]
    return [mean[r] for r in run]


def article(page: Page, core: list[Node], fused: dict[int, float]) -> int:
    """The smallest container of nearly all of the core's text, weighted by its ratios; an article or main element
    around it, if there is one."""
    held, containers, whole = [0.0] * len(page.parent), set(), 0.0
    for x in core:
        held[x.element] += len(x.text) * fused[x.path]
        whole += len(x.text) * fused[x.path]
    filled = {x.element for x in page.nodes}
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
        if e in filled or e in containers:
            containers.add(page.parent[e])
    best = 0
    for e in range(1, len(held)):
        if e in containers and held[e] >= INSIDE * whole:
            best = e  # those that hold so much lie in one another, the inner ones later
    e = best
    while e > 0:
        if page.tag[e] in ("article", "main"):
            return e
        e = page.parent[e]
    return best


def menus(page: Page, found: list[Node]) -> set[int]:
    """Blocks of lists that hold nothing but links, of two items or more, before any other text or short throughout."""
    text, linked, lists = defaultdict(int), defaultdict(int), {}
    around = [0] * len(page.parent)  # the list that an element belongs to, through its items
    for e in range(1, len(around)):
        around[e] = e if page.tag[e] in ("ul", "ol", "menu", "dl") else around[page.parent[e]] if page.tag[e] in ("li", "p", "div", "span") else 0
    for x in found:
        n = len(x.text.strip())
        text[x.block] += n
        linked[x.block] += n * x.linked
        lists.setdefault(x.block, around[x.element])
    first = min((b for b, n in text.items() if n != linked[b] and n >= SENTENCE), default=math.inf)
    members: dict[int, list[int]] = defaultdict(list)
    for block in sorted(text):
        members[lists[block]].append(block)
    out: set[int] = set()
    for e, mine in members.items():
        links_only = e and len(mine) > 1 and all(text[b] == linked[b] for b in mine)
        if links_only and (mine[0] < first or sum(text[b] for b in mine) < SHORT * len(mine)):
            out.update(mine)
    return out


def between(page: Page, top: int, inside: list[Node], core: set[int]) -> list[Node]:
    """Of a container that is not marked as article or main: its parts from the first with content to the last, and
    headings before; parts without content that are no paragraphs go if they are mostly links."""
    groups: list[tuple[int, list[Node]]] = []
    child = {top: top}
    for e in range(top + 1, page.end[top]):
        child[e] = e if page.parent[e] == top else child[page.parent[e]]
    for x in inside:
        e = child[x.element]
        if not groups or groups[-1][0] != e or e == top:
            groups.append((e, []))
        groups[-1][1].append(x)
    full = [any(id(x) in core for x in g) for _, g in groups]
    if not any(full):
        return []
    first, last = full.index(True), len(full) - 1 - full[::-1].index(True)
    while first and all(re.fullmatch("h[1-6]", page.tag[x.element]) for x in groups[first - 1][1]):
        first -= 1
    out = []
    for k in range(first, last + 1):
        mine = groups[k][1]
        size = sum(len(x.text) for x in mine)
        if full[k] or page.tag[groups[k][0]] == "p" or 2 * sum(len(x.text) for x in mine if x.linked) < size:
            out += mine
    return out


def selected(page: Page) -> list[Node]:
    """The ratios of paths, fused and smoothed, choose the article; of what lies in it, parts named as something else
    and menus go, and nothing else does."""
    fused = path_ratios(page.nodes)
    limit = SHARE * max(fused.values(), default=0.0)
    if limit <= 0:
        return []
    core = [x for x, s in zip(page.nodes, smoothed(page.nodes, fused), strict=True) if max(s, fused[x.path]) >= limit and fused[x.path] > 0 and not (x.linked or x.named)]
    top = article(page, core, fused)
    inside = [x for x in page.nodes if top <= x.element < page.end[top] and not x.named]
    if page.tag[top] not in ("article", "main"):
        inside = between(page, top, inside, {id(x) for x in core})
    links = menus(page, inside)
    return [x for x in inside if x.block not in links]


def main_text(page: str | None) -> str:
    """Content blocks in page order, one a line; white space inside a block is one space."""
    lines: list[list[str]] = []
    last = None
    for x in selected(Page(page or "")):
        if x.block != last:
            lines.append([])
            last = x.block
        lines[-1] += x.parts
    cleaned = (" ".join("".join(parts).split()) for parts in lines)
    return "\n".join(x for x in cleaned if x)


def extract(pages: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """Replaces the html column by the main text."""
    fields = kept_fields(pages, (html, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(batch.schema.names.index(html))], pa.string())
            kept = [i for i, c in enumerate(batch.schema.names) if c not in (html, column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), texts], names=[*(batch.schema.names[i] for i in kept), column])

    return map_arrow(pages, run, [*fields, field(column, "string")])
