"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

Pages of one host are made by one template. Their token streams are aligned, as
RoadRunner does (Crescenzi, Mecca and Merialdo, 2001): a string that differs
becomes a text slot; a run of like groups becomes a repeated group; what only
some pages have becomes an optional group. Streams are balanced first (end tags
that HTML implies are added), so groups are elements, and alignment goes element
by element from the outside in. A wrapper is a small tree, so partitions infer
their own in one pass and these are aligned with each other in two steps; all
pages take part and no host is gathered in one task.

The wrapper then says where the article is: in the text slots, that is strings
that differ from page to page and are not in links. From the root the region
narrows down to the one element that holds nearly all slot text (DOMINANT), and
up again to take in a headline that differs, too. Where elements are marked as
article or main (or named so), the mark decides between those that hold a fair
share of the slot text (FAIR). A page that has no text there is read by its own
article, main or named elements, or else whole. Always without menus, headers,
footers, asides, notices, adverts, forms and comments, and without named blocks of
one short string that all pages of the host share (two pages at least, since one
shares with none; plain paragraphs and headings stay).

Defined cases: null and empty html give an empty text; pages without url share
one wrapper; an unfinished tag or comment at the end is no text; on a host of one
page, or of equal pages, every string counts as a slot's; of elements with equal
slot text the first counts; elements below MAX_DEPTH are read into the deepest
above them; beyond MAX_CHILDREN runs of siblings, like ones are one group,
wherever they stand; repeated rows get equal results; an empty table gives an
empty result; no column but page_id, url and html is read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import bounded_batches, materialize, table

QUERY = "op10_html"

#: HTML's own facts, fixed values: elements without content, with raw text, and of blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Start tags that end an open element of these names, up to the scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
ENDS_P = BLOCK - {"br", "option", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "title"}
P_SCOPE = frozenset("article aside blockquote body button caption dd details div dl dt fieldset figure footer form header html li main nav ol section table tbody td th tr ul".split())

#: Elements that are never part of an article.
NEVER = frozenset("head title nav footer aside form script style noscript template iframe button select option textarea svg canvas object dialog menu input label".split())
#: Words of class, id or role that name what is no article, and what is one.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations more comment comments commentlist reply replies respond discussion disqus login search copyright legal pagination pager toolbar skip contentinfo complementary dialog byline-share".split()
)
#: Elements of an article's text, never a template's while they have no class, id or role.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that beside those of NOT_ARTICLE leave a token's meaning as it is.
NEUTRAL = frozenset("area bar block box button buttons container form inner list links panel posts section slot thread unit wrap wrapper".split())
#: Ids of sections are mostly chapters; only these name what is no article.
SECTION_IDS = frozenset("comments respond disqus".split())
IS_ARTICLE = frozenset("article main content story entry post maincontent articlebody".split())

MAX_DEPTH = 150
MAX_CHILDREN = 150
#: A string shorter than this that all pages of a host share may be the template's; a longer one of the article is kept.
CONSTANT_CHARS = 200
LINK_SHARE = 0.8
#: Share of the slot text that an element must hold for the region to narrow down to it, and for a mark to count.
DOMINANT, FAIR = 0.75, 0.2

_TOKEN = re.compile(
    r"(?P<text>[^<]+)|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?P<open>>|\Z)|</[^>]*(?:>|\Z)|(?P<stray><)",
    re.S,
)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ABOUT = re.compile(r"(?:has|with|no|is|without|not)[-_]")


class Node:
    """An element of a page: name, symbol (with the words of its class, id and role, and a mark if a whole token names no article), and its children, strings among them."""

    __slots__ = ("name", "symbol", "children")

    def __init__(self, name: str, symbol: str):
        self.name, self.symbol, self.children = name, symbol, []


@lru_cache(maxsize=50_000)
def _symbol(name: str, attrs: str) -> str:
    tokens = [(m[0][:2].lower() == "id", t) for m in _NAMED.finditer(attrs) for t in (m[1] or m[2] or m[3] or "").lower().split()]
    # "has-sidebar" and the like tell of the page around, not of the element.
    tokens = [(is_id, t, [w for w in re.split(r"[^a-z]+", t) if w]) for is_id, t in tokens if not _ABOUT.match(t)]
    # Numbers tell classes like c1 and c2 apart, but those of three digits or after a hyphen, and those of ids, number pages.
    words = sorted({w for is_id, t, own in tokens for w in (own if is_id else re.findall(r"[a-z]+(?:\d{1,2}(?!\d))?", t))})
    whole = name not in PLAIN and any(t in SECTION_IDS if is_id and name == "section" else _names_no_article(own) for is_id, t, own in tokens)
    return name + "." + ".".join(words) + "!" * whole if words else name


def _names_no_article(words: list[str]) -> bool:
    """Whether a whole token, of these words, names what is no article."""
    return any(w in NOT_ARTICLE for w in words) and all(w in NOT_ARTICLE or w in NEUTRAL for w in words)


def parse(page: str) -> Node:
    """The balanced tree of a page."""
    root = Node("#root", "#root")
    stack = [root]
    # Open elements below MAX_DEPTH, by name; they end with the deepest element of the stack. muted: of one that is no article, whose text goes, how often its name is open.
    deeper: Counter[str] = Counter()
    muted: list = ["", 0]
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"] or m["stray"]
        if text:
            if not (muted[1] and deeper):
                stack[-1].children.append(entities.unescape(text))
            continue
        name = m["name"] or m["name2"]
        if name is None or m["open"] == "":
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if deeper[name] > 0:
                deeper[name] -= 1
                muted[1] -= muted[1] > 0 and name == muted[0]
                if name in BLOCK:
                    stack[-1].children.append(Node("br", "br"))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    deeper.clear()
                    muted[1] = 0
                    break
            continue
        if name in ENDS_P:
            _end(stack, {"p"}, P_SCOPE, deeper)
        if name in CLOSES:
            _end(stack, CLOSES[name], SCOPE.get(name, frozenset()), deeper)
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        low = attrs.lower() if attrs else ""
        node = Node(name, _symbol(name, attrs) if "class" in low or "id" in low or "role" in low else name)
        stack[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif name not in VOID and not low.endswith("/"):
            if len(stack) < MAX_DEPTH:
                stack.append(node)
            else:
                deeper[name] += 1
                if muted[1] and name == muted[0]:
                    muted[1] += 1
                elif not muted[1] and (name in NEVER or node.symbol.endswith("!")):
                    muted[:] = [name, 1]
    _shaped(root)
    return root


#: Elements that say what a container without a name holds: blocks of text, or else lists.
_HOLDS = (frozenset("p h1 h2 h3 h4 h5 h6 article section main div blockquote pre table figure".split()), frozenset("ul ol menu dl nav".split()))


def _shaped(node: Node) -> None:
    """Containers without class, id and role are told apart by what they hold: div:b has blocks, div:l lists, div:t only text."""
    below = set()
    for child in node.children:
        if not isinstance(child, str):
            _shaped(child)
            below.add(child.name)
    if node.symbol in ("div", "section"):
        node.symbol += ":b" if below & _HOLDS[0] else ":l" if below & _HOLDS[1] else ":t"


def _end(stack: list[Node], names: set[str], scope: frozenset[str] | set[str], deeper: Counter[str]) -> None:
    for name in (n for n in names if deeper[n] > 0):
        deeper[name] -= 1
        if name in BLOCK:
            stack[-1].children.append(Node("br", "br"))
        return
    if any(n in scope for n, count in deeper.items() if count > 0):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            deeper.clear()
            return
        if stack[i].name in scope:
            return


# A wrapper node is a list: symbol, optional, repeated, children (None for text), constant string or None, characters, of these in links.
SYM, OPT, REP, KIDS, CONST, CHARS, LINKED = range(7)


def pattern(node: Node, in_link: bool = False) -> list:
    """The wrapper of one page: runs of like siblings are repeated groups from the start."""
    kids: list[list] = []
    chars = linked = 0
    in_link = in_link or node.name == "a"
    for child in node.children:
        if isinstance(child, str):
            if child.isspace():
                continue
            text = " ".join(child.split())
            # Of long strings a digest will do: they are the same on all pages, or a slot.
            text = text if len(text) < CONSTANT_CHARS else "\0" + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
            own = ["#", False, False, None, text, len(child), len(child) if in_link else 0]
        else:
            own = pattern(child, in_link)
        chars += own[CHARS]
        linked += own[LINKED]
        if kids and kids[-1][SYM] == own[SYM]:
            kids[-1] = aligned(kids[-1], own)
            kids[-1][REP] = True
        else:
            kids.append(own)
    return [node.symbol, False, False, kids, None, chars, linked]


def aligned(a: list, b: list) -> list:
    """One wrapper for what two wrappers of one symbol match."""
    out = [a[SYM], a[OPT] or b[OPT], a[REP] or b[REP], None, None, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED]]
    if a[KIDS] is None:
        out[CONST] = a[CONST] if a[CONST] == b[CONST] else None
        return out
    x, y = a[KIDS], b[KIDS]
    kids: list[list] = []

    def add(item: list, optional: bool) -> None:
        if optional and not item[OPT]:
            item = [*item]
            item[OPT] = True
        if kids and kids[-1][SYM] == item[SYM]:
            both = kids[-1][OPT] and item[OPT]
            kids[-1] = aligned(kids[-1], item)
            kids[-1][OPT], kids[-1][REP] = both, True
        else:
            kids.append(item)

    for i, j in _pairs([k[SYM] for k in x], [k[SYM] for k in y]):
        if i is None:
            add(y[j], True)
        elif j is None:
            add(x[i], True)
        else:
            add(aligned(x[i], y[j]), False)
    if len(kids) > MAX_CHILDREN:  # a list without order: like items become one
        by: dict[str, list] = {}
        for k in kids:
            if k[SYM] in by:
                k = aligned(by[k[SYM]], k)
                k[REP] = True
            k[OPT] = True
            by[k[SYM]] = k
        kids = list(by.values())
    out[KIDS] = kids
    return out


def _pairs(x: list[str], y: list[str]) -> list[tuple[int | None, int | None]]:
    """A longest common alignment of two symbol streams: matched places, or None on the side that lacks one."""
    if x == y:
        return [(i, i) for i in range(len(x))]
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    n, m = len(x) - lo - hi, len(y) - lo - hi
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[lo + i] == y[lo + j] else max(best[i + 1][j], best[i][j + 1])
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(lo)]
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[lo + i] == y[lo + j]:
            out.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((lo + i, None))
            i += 1
        else:
            out.append((None, lo + j))
            j += 1
    return out + [(len(x) - k, len(y) - k) for k in range(hi, 0, -1)]


def expression(w: list) -> str:
    """The wrapper as a regular expression over tags, with # for text slots and ... for long strings that all pages share."""
    if w[KIDS] is None:
        body = "#" if w[CONST] is None else "..." if w[CONST].startswith("\0") else w[CONST]
    else:
        tag = w[SYM].split(":")[0]
        inner = "".join(map(expression, w[KIDS]))
        body = inner if tag == "#root" else f"<{tag}>{inner}</{tag.split('.')[0]}>"
    mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[w[OPT], w[REP]]
    return f"({body}){mark}" if mark else body


def _no_article(symbol: str, inside: bool, marked: bool) -> bool:
    """marked: inside an element that is marked as the article, where only whole tokens count."""
    name, *words = symbol.rstrip("!").split(".")
    if name in NEVER or (name == "header" and not inside):
        return True
    if name in ("html", "body", "main", "article"):
        return False
    return symbol.endswith("!") if marked else _has_word(words)


def _has_word(words: list[str]) -> bool:
    return any(w in NOT_ARTICLE for w in words)


def _article(symbol: str) -> bool:
    name, *words = symbol.rstrip("!").split(".")
    return name in ("article", "main") or any(w in IS_ARTICLE for w in words)


class Extractor:
    """A host's wrapper with the places of its article: marks, symbols of marked elements, or node, a part of the wrapper."""

    def __init__(self, wrapper: list, pages: int):
        self.wrapper, self.pages = wrapper, pages
        self.slots: dict[int, int] = {}
        if not self._measure(wrapper, pages > 1) and pages > 1:
            self._measure(wrapper, False)
        self.node = self._narrowed()
        total = self.slots[id(wrapper)]
        fair = lambda of: self.slots.get(id(of), 0) >= FAIR * total
        self.region = next(self._regions(wrapper, lambda w: self.slots.get(id(w), 0), fair), frozenset()) if total else frozenset()
        self.drop_constants = pages > 1 and self._varies(wrapper)

    def _measure(self, w: list, differing: bool, marked: bool = False) -> int:
        """Characters of the text slots in w, not those of links and of what is no article. differing: strings that all pages share, none of them in an optional group, fill no slot."""
        differing = differing and not w[OPT]
        if w[KIDS] is None:
            own = 0 if differing and w[CONST] is not None else w[CHARS] - w[LINKED]
        elif _no_article(w[SYM], True, marked):
            own = 0
        else:
            own = sum(self._measure(k, differing, marked or _article(w[SYM])) for k in w[KIDS])
        self.slots[id(w)] = own
        return own

    def _narrowed(self) -> list:
        """The deepest part of the wrapper that holds nearly all slot text, and the headline among it."""
        path = [self.wrapper]
        total = self.slots[id(self.wrapper)]
        while total:
            inner = [k for k in path[-1][KIDS] or () if k[KIDS] is not None and k[SYM] not in PLAIN and not k[REP]]
            best = max(inner, key=lambda k: self.slots[id(k)], default=None)
            if best is None or self.slots[id(best)] < DOMINANT * total:
                break
            path.append(best)
        for i, w in enumerate(path):
            # A first headline beside the narrower part is the article's: no narrower than this.
            if i + 1 < len(path) and any(self._headline(k) for k in w[KIDS] if k is not path[i + 1]):
                return w
        return path[-1]

    def _headline(self, w: list) -> bool:
        name = w[SYM].split(".")[0]
        return w[KIDS] is not None and self.slots.get(id(w), 0) > 0 and (name in ("h1", "h2") or any(self._headline(k) for k in w[KIDS]))

    @staticmethod
    def _regions(wrapper: list, measure: Callable[[list], int], counts: Callable[[list], bool] = lambda w: True) -> Iterator[frozenset[str]]:
        """Symbols that mark the article, by kind: article elements, main elements, then the named element holding most text by measure. Only kinds with text, of elements that count."""
        total: dict[str, int] = {}

        def walk(w: list, marked: bool) -> None:
            if w[KIDS] is None or _no_article(w[SYM], True, marked):
                return
            if _article(w[SYM]) and counts(w):
                total[w[SYM]] = total.get(w[SYM], 0) + measure(w)
            for k in w[KIDS]:
                walk(k, marked or _article(w[SYM]))

        walk(wrapper, False)
        element = lambda s: s.split(".")[0]
        rank = lambda s: (2 if element(s) == "article" else 1 if element(s) == "main" else 0, total[s])
        left = {s for s in total if total[s]}
        while left:
            top = max(sorted(left), key=rank)
            # All of the same element: one host may mark its articles with differing classes.
            yield frozenset(s for s in total if element(s) == element(top))
            left = {s for s in left if element(s) != element(top)}

    def _varies(self, w: list) -> bool:
        """Whether some slot of the article differs between pages."""

        def walk(w: list, inside: bool) -> bool:
            if w[KIDS] is None:
                return inside and w[CONST] is None
            return not _no_article(w[SYM], inside, inside and bool(self.region)) and any(walk(k, inside or self._opens(w, w[SYM], self.region)) for k in w[KIDS])

        return walk(w, False)

    def _opens(self, w: list | None, symbol: str, region: frozenset[str]) -> bool:
        """Whether the article begins with an element: by its mark, or where there is none by its place in the wrapper."""
        return symbol in region if region else w is self.node

    def text(self, page: Node) -> str:
        """The page's text by the host's region, or where that gives none, by the page's own, and by the whole page at last."""
        if out := self._text(page, self.region):
            return out
        own = pattern(page)
        alone = Extractor.__new__(Extractor)
        alone.slots = {}
        alone._measure(own, False)
        for region in (*self._regions(own, lambda w: alone.slots.get(id(w), 0)), None):
            if out := self._text(page, region):
                return out
        return ""

    def _text(self, page: Node, region: frozenset[str] | None) -> str:
        """region: symbols that open the article; none, so its place in the wrapper does; None, so all of the page is it."""
        blocks, now = [], []

        def flush() -> None:
            block = " ".join("".join(now).split())
            if block:
                blocks.append(block)
            now.clear()

        def walk(node: Node, w: list | None, inside: bool, everywhere: bool) -> None:
            if _no_article(node.symbol, inside, inside and bool(region)):
                flush()
                return
            inside = inside or region is None or self._opens(w, node.symbol, region)
            listed = node.name in ("ul", "ol", "div", "section", "table") and w is not None and w[CHARS] > 0 and w[LINKED] >= LINK_SHARE * w[CHARS]
            # A list of links within a marked article goes only if it is named as no article, too.
            if listed and node.name != "#root" and (not (inside and region) or _has_word(node.symbol.rstrip("!").split(".")[1:])):
                flush()
                return
            block = node.name in BLOCK
            if block:
                flush()
            # A slot that is neither optional nor repeated, nor in a group that is, is filled once on each page.
            everywhere = everywhere and w is not None and not w[OPT] and not w[REP]
            if self.drop_constants and block and everywhere and node.symbol not in PLAIN and node.name not in HEADINGS and self._constant(w):
                return
            at = self._matched(node, w)
            for i, child in enumerate(node.children):
                own = at.get(i)
                if not isinstance(child, str):
                    walk(child, own, inside, everywhere)
                elif inside:
                    now.append(child)
            if block:
                flush()

        walk(page, self.wrapper, region is None, True)
        flush()
        return " ".join(blocks)

    @staticmethod
    def _constant(w: list) -> bool:
        """Whether an element that all pages have holds nothing but one short string, the same on all."""
        only = w[KIDS][0] if len(w[KIDS]) == 1 else None
        return only is not None and only[KIDS] is None and not only[OPT] and not only[REP] and only[CONST] is not None and not only[CONST].startswith("\0")

    @staticmethod
    def _matched(node: Node, w: list | None) -> dict[int, list]:
        """The wrapper's part for each child of node. A run of like siblings meets one repeated group."""
        if w is None or not w[KIDS]:
            return {}
        runs: list[tuple[str, list[int]]] = []
        for i, child in enumerate(node.children):
            if isinstance(child, str) and not child.strip():
                continue
            symbol = "#" if isinstance(child, str) else child.symbol
            if runs and runs[-1][0] == symbol:
                runs[-1][1].append(i)
            else:
                runs.append((symbol, [i]))
        if len(w[KIDS]) > MAX_CHILDREN // 2:
            by = {k[SYM]: k for k in w[KIDS]}
            return {i: by[s] for s, places in runs for i in places if s in by}
        return {i: w[KIDS][b] for a, b in _pairs([s for s, _ in runs], [k[SYM] for k in w[KIDS]]) if a is not None and b is not None for i in runs[a][1]}


@lru_cache(maxsize=512)
def _extractor(wrapper: str, pages: int) -> Extractor:
    return Extractor(json.loads(wrapper), pages)


#: Hosts whose wrappers a task holds before it hands them on.
HELD = 2000
#: Partial wrappers of a host are joined in so many groups, and these in one.
GROUPS = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, json.dumps(w), n) for h, (w, n) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["host", "wrapper", "pages"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            own = pattern(parse(page or ""))
            if not own[KIDS]:
                continue  # a page without content says nothing of the template
            if host in held:
                w, n = held[host]
                held[host] = [aligned(w, own), n + 1]
            else:
                held[host] = [own, 1]
        if len(held) > HELD:
            yield out()
    if held:
        yield out()


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(zip(pdf["wrapper"], pdf["pages"], strict=True))
    w = json.loads(rows[0][0])
    for other, _ in rows[1:]:
        w = aligned(w, json.loads(other))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(w)], "pages": [int(pdf["pages"].sum())]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) for each host, from all its pages."""
    bounded_batches(pages.sparkSession)
    keyed = pages.select(F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"), "html")
    row = "host string, wrapper string, pages long"
    parts = keyed.mapInArrow(_infer, row).withColumn("g", F.pmod(F.xxhash64("wrapper"), F.lit(GROUPS)))
    return materialize(parts.groupBy("host", "g").applyInPandas(_join, row).groupBy("host").applyInPandas(_join, row), "html-wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row for each of pages."""
    own = wrappers(pages)
    size = own.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    keyed = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("html", "wrapper", "pages"))
            texts = [_extractor(w, n).text(parse(page)) if page and w is not None else "" for page, w, n in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # Wrappers are broadcast up to 8 million characters, and joined by host beyond.
    kind = dict(pages.dtypes)["page_id"]
    return keyed.join(F.broadcast(own) if size <= 8_000_000 else own, "host", "left").select("page_id", "url", "html", "wrapper", "pages").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: Wrapper inference has no SQL form; it is tested on pages of known text.
ORACLE_SQL = None
