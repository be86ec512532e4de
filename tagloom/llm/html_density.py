"""Main text of HTML pages by composite text density.

A tolerant parser builds the tree of a page. Parts that are never article text (scripts, forms, navigation, adverts,
notices, reader comments) are cut by element and role, and boxes also by class or id where all of a name says so; headings
never are, and a box whose id is the slug of its own heading is not. For every node left, the density is
its characters per tag, adjusted for the share of link characters and link tags in it; the density
sum of a node is that of its children. The node of largest sum is the core. The least density on
the path from it to the body is the threshold. An article element around the core (else a main element, else the body) bounds the text;
with it go the articles next to it that reach the threshold. Inside, branches beside the path to the core
go where their density is below the threshold: in an article or main element blocks in which links prevail, elsewhere all blocks but headings and what holds the page's h1. Children of the core go only if
they are hardly anything but links.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices

_TOKEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))|([^\s=/>"']+)""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_CUT = frozenset("head title script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas audio video dialog menu noembed noframes search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tablist".split())
# Words of class names and ids.
#: Parts that are not the article, whatever else the name says.
_SURE = frozenset("adbox adsense adslot advert adverts advertisement advertising sponsored sidebar sidenav navbar breadcrumb breadcrumbs masthead topbar newsletter pagination searchbox paywall commentlist disqus".split())
#: Parts that are not the article if the name says nothing else.
_WORDS = _SURE | frozenset(
    "ad ads sponsor sponsors promo promos promotion promotions promoted banner banners menu menus nav navigation footer cookie cookies consent gdpr notice notices notification notifications announcement alert alerts popup modal overlay subscribe subscription signup login search share sharing social related recommended recommendations pager toolbar widget widgets disclaimer copyright".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that say only what kind of box it is, or where.
_PLACE = frozenset(
    "box block boxes blocks container wrapper wrap section sections area areas list lists link links bar bars item items inner outer top bottom left right center middle site page main global post posts article articles story stories form button buttons icon icons panel module modules region zone slot unit text message messages msg content body row col column group header head title js div id primary secondary sticky fixed mobile desktop small large new more read your user reader thread tree feed media us on off page pages entry news policy bottombar in by for".split()
)
#: Elements that a class or id may cut; others only by a class that is one such word, headings not at all.
_BOXES = frozenset("div section ul ol dl table figure header details center fieldset hgroup address form".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: An open element of the first kind ends when an element of the second starts.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _named(value: str, whole: bool) -> tuple[bool, bool]:
    """Whether a class or id names a part that is not the article, and whether it names reader comments. ``whole``: only by a name of one word."""
    cut = comments = False
    for name in value.split():
        words = [w.lower() for w in _PARTS.findall(name)]
        if not words or words[0] in ("has", "with", "no", "without") or whole and len(words) > 1:
            continue
        if all(w in _WORDS or w in _COMMENTS or w in _PLACE or w.isdigit() for w in words):
            comments |= any(w in _COMMENTS for w in words)
            cut |= any(w in _WORDS for w in words)
        cut |= any(w in _SURE for w in words) or words == ["header"] or words[-2:] in (["site", "header"], ["page", "header"])
    return cut, comments


def _slug(text: str) -> str:
    return "-".join(re.findall(r"\w+", text.lower()))


class Tree:
    """Nodes in page order: a node's children are node numbers and strings. Node 0 is the page."""

    def __init__(self, text: str):
        self.tag, self.parent, self.parts, self.cut = ["#page"], [0], [[]], [False]
        self.weak = set()  # nodes cut for their class or id only, and forms
        self.ids, self.classed = {}, set()  # of these, what names cut them
        self._read(text)
        hidden = list(self.cut)
        for i in range(1, len(hidden)):
            hidden[i] |= hidden[self.parent[i]]
        # What is cut for its class can't hold the page's only articles, its main element or its title.
        held = {"main", "h1", "body"} | ({"article"} if all(h for h, t in zip(hidden, self.tag) if t == "article") else set())
        inside = [t in held for t in self.tag]
        for i in range(len(inside) - 1, 0, -1):
            if inside[i]:
                inside[self.parent[i]] = True
        for i in self.weak:
            if inside[i] or i in self.ids and i not in self.classed and self.tag[i] != "form" and self._titled(i):
                self.cut[i] = False
        for i in range(1, len(inside)):
            if self.cut[self.parent[i]]:
                self.cut[i] = True

    def _titled(self, i: int) -> bool:
        """Whether the id of a node is the slug of the heading it starts with."""
        first = next((j for j in self.parts[i] if j.__class__ is int or j.strip()), None)
        if first.__class__ is not int or self.tag[first] not in _HEADINGS:
            return False
        words, todo = [], [first]
        while todo:
            x = todo.pop()
            words.append(x) if x.__class__ is str else todo.extend(reversed(self.parts[x]))
        return _slug("".join(words)) == _slug(self.ids[i])

    def _open(self, tag: str, attrs: str, stack: list[int]) -> int:
        i = len(self.tag)
        cut = tag in _CUT
        hard = False
        if tag == "header":
            cut = not any(self.tag[s] in ("article", "main") for s in stack)
        if attrs and (not cut or tag == "form"):
            for name, a, b, c, bare in _ATTR.findall(attrs):
                name, value = (name or bare).lower(), html.unescape(a or b or c)
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES or name == "style" and re.search(r"display\s*:\s*none", value):
                    cut = hard = True
                elif name == "class" or name == "id" and (tag in _BOXES or tag in ("article", "aside")):
                    plain, comments = _named(value, tag not in _BOXES and tag != "article")
                    if comments and tag not in ("html", "body", "main") and tag not in _HEADINGS:
                        cut = True
                        hard = True
                    elif plain and tag not in ("html", "body", "main", "article") and tag not in _HEADINGS:
                        cut = True
                        self.weak.add(i)
                        if name == "id":
                            self.ids[i] = value
                        else:
                            self.classed.add(i)
        if tag == "form" and not hard:
            self.weak.add(i)
        elif tag == "form":
            self.weak.discard(i)
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.parts.append([])
        self.cut.append(cut)
        self.parts[stack[-1]].append(i)
        return i

    def _read(self, text: str) -> None:
        stack, at, n = [0], 0, len(text)
        tag_of = self.tag

        def close(tags, stops=()) -> None:
            """End the innermost open element of these tags, unless one of stops is nearer."""
            for k in range(len(stack) - 1, 0, -1):
                t = tag_of[stack[k]]
                if t in tags:
                    del stack[k:]
                    return
                if t in stops:
                    return

        while at < n:
            m = _TOKEN.search(text, at)
            end = m.start() if m else n
            if end > at:
                self.parts[stack[-1]].append(html.unescape(text[at:end]))
            if not m:
                return
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag == "br":
                    self.parts[stack[-1]].append(" ")
                elif tag not in ("html", "body"):
                    close({tag}, () if tag in _BLOCK else _BLOCK)
                continue
            attrs = m[3] or m[6] or ""
            if tag in ("html", "body") and tag in tag_of:
                continue
            if tag in _BLOCK and tag_of[stack[-1]] != "#page":
                close({"p"}, _BLOCK - {"p"})
            if tag in _HEADINGS and tag_of[stack[-1]] in _HEADINGS:
                stack.pop()
            if tag == "body":
                close({"head"})
            if tag in _ENDS:
                close(*_ENDS[tag])
            i = self._open(tag, attrs, stack)
            if tag in _RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(text, at)
                at = stop.end()
            elif tag not in _VOID and not (attrs.endswith("/") and tag not in _BLOCK and tag not in ("a", "span", "b", "i")):
                stack.append(i)

    def density(self) -> tuple[list[float], list[float], list[float]]:
        """Composite density, density sum and share of link characters of each node; cut nodes have none."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
        for i in range(n - 1, -1, -1):
            if self.cut[i]:
                continue
            chars[i] += sum(len(x.strip()) for x in self.parts[i] if x.__class__ is str)
            if self.tag[i] == "a":
                link_chars[i] = chars[i]
                link_tags[i] += 1
            p = self.parent[i]
            if i:
                chars[p] += chars[i]
                tags[p] += tags[i] + 1
                link_chars[p] += link_chars[i]
                link_tags[p] += link_tags[i]
        whole = link_chars[0] / chars[0] if chars[0] else 0.0
        dens, sums = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            c = chars[i]
            if self.cut[i] or not c:
                continue
            t, lc, lt = max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + whole * c + math.e)
            dens[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base) if base > 1.0000001 else c / t * math.log(max(c / lc * t / lt, 1.0)) * 10
            sums[self.parent[i]] += dens[i]
        return dens, sums, [lc / c if c else 0.0 for lc, c in zip(link_chars, chars)]

    def blocks(self, roots: list[int], drop: frozenset | set = frozenset()) -> list[str]:
        out, text = [], []

        def flush() -> None:
            if text and (line := " ".join("".join(text).split())):
                out.append(line)
            text.clear()

        todo: list = [x for r in reversed(roots) for x in (r, None)]
        while todo:
            x = todo.pop()
            if x.__class__ is str:
                text.append(x)
            elif x is None:
                flush()
            elif x in roots or not (self.cut[x] or x in drop):
                if self.tag[x] == "br":
                    text.append(" ")
                    continue
                if self.tag[x] in _BLOCK:
                    flush()
                    todo.append(None)
                todo.extend(reversed(self.parts[x]))
            elif self.tag[x] in _BLOCK:
                flush()
            else:
                text.append(" ")
        flush()
        return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends; empty if there are none. A null or empty page has no text."""
    if not page:
        return ""
    tree = Tree(page)
    roots, drop = select(tree, *tree.density())
    return "\n".join(tree.blocks(roots, drop))


def select(tree: Tree, dens: list[float], sums: list[float], links: list[float]) -> tuple[list[int], set[int]]:
    """(the nodes whose text is the article's, in page order; the nodes inside them that are not)."""
    core = max(range(len(sums)), key=lambda i: (sums[i], -i))
    path = [core]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    least = min((dens[i] for i in path if i), default=0.0)
    around = [i for i in reversed(path) if tree.tag[i] == "article"] or [i for i in path if tree.tag[i] == "main"] or [0]
    scope, own = around[0], set(path)
    roots = [scope]
    if tree.tag[scope] == "article":
        roots = [j for j in tree.parts[tree.parent[scope]] if j == scope or j.__class__ is int and tree.tag[j] == "article" and not tree.cut[j] and dens[j] >= least > 0]
    drop, titled = set(), set()
    for i in range(len(tree.tag)):
        if tree.tag[i] == "h1" and not tree.cut[i]:
            while i and i not in titled:
                titled.add(i)
                i = tree.parent[i]
    if least > 0:
        for i in path[: path.index(scope) + 1]:
            for j in tree.parts[i]:
                if j.__class__ is int and j not in own and not tree.cut[j] and dens[j] < least and tree.tag[j] in _BLOCK and tree.tag[j] not in _HEADINGS and (links[j] > 0.8 if i == core else links[j] > 0.5 or not scope and j not in titled):
                    drop.add(j)
    return roots, drop


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` of each row.

    A null or empty page has an empty text. Repeated rows and null ids are kept; other columns are dropped, whatever their names. An empty
    table gives an empty one. A very long or deep page is read whole, by one task, without recursion. Of cores of equal sum the first counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    rows = pick(df, id=id_col, url=url_col, html=html_col).withColumn("html", F.col("html").cast("string"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string").withColumnsRenamed({"id": id_col, "url": url_col})
