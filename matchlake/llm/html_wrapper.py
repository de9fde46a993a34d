"""Main text of web pages by wrapper induction per host.

1. A host's pages are grouped by layout: the paths of their articles and of
   elements with classes.  Pages whose layout no other page of the host has form
   one more group.  One page of each group represents it.
2. Every page is aligned with its group's representative by simple tree
   matching: the largest mapping of nodes that keeps tags, parents and the order
   of children, of several that which pairs later children first; trees of any
   size and depth alike.  Texts are counted by path over all pages.  A text
   that all pages with its path have there is template, others fill slots.
3. The wrapper of a group is the deepest container that holds nearly all of the
   varying text, and the template texts.
4. Every page's blocks inside the wrapper's container are its main text, less
   template texts and regions whose tag, role or class marks them as menu,
   header, footer, sidebar, notice, advert, form or comments.

An article element, where a page has one, is the container whatever the
wrapper says, so that titles beside the longest texts stay and pages of hosts
with one page work too; template texts inside it are left out as elsewhere,
while lines that many but not all articles share stay.  A page that
lacks its group's container falls back to its body.  Pages are parsed once,
and their outlines written.  Up to SMALL layouts are sent to all tasks, and
only counts by path are shuffled; of more, outlines are dealt to shares of
their groups, each with its representative once, for the counts and again for
the texts.  A host or layout may have any number of pages.

Defined cases: null and empty html, and pages without text, give an empty
text; null urls share a wrapper of their own; unclosed and crossed tags,
comments and scripts that never end are read as browsers do, to the end;
repeated rows are alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.tables import bounded, same, saved
from matchlake.llm.url_filter import host_of

SHARE = 0.8
#: So many different pages settle a template text by themselves.
ENOUGH = 4
#: Numbers that a matching keeps, of subtrees and of the rows of one table; what goes beyond is computed again.
KEPT, TABLE = 8_000_000, 2_000_000
#: Layouts that may be broadcast with their groups' representatives; pages of a share where more are dealt out; references that a task keeps.
SMALL, PART, KNOWN = 5_000, 4_096, 2_000

# Element names of HTML, and words that name a page's regions.
_RAW = "script|style|noscript|template|iframe|textarea|svg|math|object|select"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter progress q rb ruby rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
_OUT_TAGS = frozenset("head title nav footer aside form button dialog menu fieldset input option datalist".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners cookie cookies consent gdpr notice notices notification popup modal overlay newsletter promo promotion sponsor sponsored "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist respond reply replies discussion share sharing social related recommended widget widgets "
    "login signup subscribe subscription pagination pager toolbar disqus alert skip".split()
)
_MAIN_WORDS = frozenset("header masthead topbar".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 li td tr blockquote pre".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "name", "out", "head", "children", "parent")

    def __init__(self, tag: str, name: str, out: bool, head: bool, parent: Node | None):
        self.tag, self.name, self.out, self.head, self.parent = tag, name, out, head, parent
        self.children: list = []


_MARKS: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def _marks(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's name with its classes, whether it is out of the main text, and whether it is if outside an article."""
    key = (tag, attributes)
    if key in _MARKS:
        return _MARKS[key]
    out, head, name = tag in _OUT_TAGS, tag == "header", tag
    if attributes:
        for kind, a, b, c in _ATTRIBUTE.findall(attributes):
            kind, value = kind.lower(), (a or b or c).lower()
            words = set(_WORD.findall(value))
            if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
                out = True
            elif kind == "role":
                out = out or bool(words & _OUT_ROLES)
            elif kind in ("class", "id"):
                if kind == "class":
                    name += "".join("." + w for w in sorted(value.split()))
                if tag not in ("html", "body", "main", "article") or "comment" in words or "comments" in words:
                    out = out or bool(words & _OUT_WORDS)
                    head = head or bool(words & _MAIN_WORDS)
    if len(_MARKS) < 20_000:
        _MARKS[key] = (name, out, head)
    return name, out, head


def parse(page: str) -> Node:
    """A tree of elements and texts, with the ends that HTML implies."""
    root = at = Node("", "", False, False, None)
    last = 0
    for m in _TOKEN.finditer(page):
        begin = m.start()
        if begin > last:
            at.children.append(page[last:begin])
        last = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            up = at
            while up.parent is not None and up.tag != tag:
                if up.tag in ("td", "th", "table", "article") and tag in _INLINE:
                    break
                up = up.parent
            if up.parent is not None and up.tag == tag:
                at = up.parent
            continue
        if tag in _CLOSES_P:
            up = at
            while up.tag in _INLINE and up.parent is not None:
                up = up.parent
            if up.tag == "p":
                at = up.parent
        elif tag in _CLOSES:
            up = at
            found = None
            while up.parent is not None and up.tag not in _SCOPE[tag]:
                if up.tag in _CLOSES[tag]:
                    found = up
                up = up.parent
            if found is not None:
                at = found.parent
        if tag == "body":
            up = at
            while up.parent is not None:
                if up.tag == "head":
                    at = up.parent
                    break
                up = up.parent
        name, out, head = _marks(tag, m[4] or m[7] or "")
        node = Node(tag, name, out, head, at)
        at.children.append(node)
        if tag not in _VOID:
            at = node
    if last < len(page):
        at.children.append(page[last:])
    return root


class Outline:
    """A page's elements outside inline ones and outside the regions that are out, in page order, and its blocks (element, text)."""

    __slots__ = ("above", "names", "blocks", "tags", "inside", "shapes")

    def __init__(self, above: list[int], names: list[str], blocks: list[tuple[int, str]]):
        self.above, self.names, self.blocks, self.shapes = above, names, blocks, None
        self.tags, self.inside = [n.split(".")[0] for n in names], [False] * len(names)
        for k in range(1, len(names)):
            self.inside[k] = self.inside[above[k]] or self.tags[k] == "article"


def blocks(root: Node) -> tuple[list[int], list[str], list[tuple[int, str]]]:
    """An outline's parts: parents and names of elements, and the blocks, without the regions that are out."""
    above, names, found = [-1], [""], []
    parts: list[str] = []

    def flush(at: int) -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append((at, text))
            parts.clear()

    stack = [(root, 0, 0, False)]
    while stack:
        node, k, at, inside = stack.pop()
        children = node.children
        while k < len(children):
            child = children[k]
            k += 1
            if type(child) is str:
                parts.append(child)
            elif child.tag == "br":
                parts.append(" ")
            elif child.out or (child.head and not inside):
                flush(at)
            elif child.tag in _INLINE:
                stack.append((node, k, at, inside))
                node, k, children = child, 0, child.children
            else:
                flush(at)
                stack.append((node, k, at, inside))
                above.append(at)
                names.append(child.name)
                at, inside = len(names) - 1, inside or child.tag == "article"
                node, k, children = child, 0, child.children
        if node.tag not in _INLINE:
            flush(at)
    return above, names, found


def layout(above: list[int], names: list[str]) -> int:
    """A 64-bit key of the paths of a page's articles and elements with classes outside articles; classes with digits don't count."""
    paths, found = [b""], set()
    for k in range(1, len(names)):
        up = paths[above[k]]
        if up is None:
            paths.append(None)
            continue
        tag, *classes = names[k].split(".")
        classes = [c for c in classes if not any(x.isdigit() for x in c)]
        path = hashlib.blake2b(up + ".".join((tag, *classes)).encode("utf-8", "replace"), digest_size=8).digest()
        if classes or tag == "article":
            found.add(path)
        paths.append(None if tag == "article" else path)
    return int.from_bytes(hashlib.blake2b(b"".join(sorted(found)), digest_size=8).digest(), "big", signed=True)


class Level:
    """The shapes at one depth of a tree and, in one row, a gap and the children of each as places in the next level (a gap: -1; the first gap is not listed)."""

    def __init__(self, tree: Shapes, nodes: list[int], place: dict[int, int], below: dict[int, int]):
        row: list[int] = []
        ends, self.place = [], place
        for k in nodes:
            row += [-1, *(below[tree.shapes[c]] for c in tree.kids[k])]
            ends.append(len(row) - 1)
        self.tags, self.row, self.ends = np.array([tree.words[tree.tags[k]] for k in nodes]), np.array(row[1:], np.int64), np.array(ends)
        # Each shape's part of a row starts higher than any number in the part before, so that running maxima end there.
        apart = max(tree.sizes[k] for k in nodes) + 1
        self.start = np.arange(len(nodes), dtype=np.int32 if len(nodes) * apart < 2**31 else np.int64) * apart
        self.base = self.start[np.cumsum(np.array(row) < 0) - 1]
        self.present = set(self.tags.tolist())


class Shapes:
    """A tree with its subtrees numbered by shape: those of the same tags at the same places are one, also if they are in `like`, whose levels the tree is matched with."""

    def __init__(self, above: list[int], tags: list[str], like: Shapes | None = None):
        self.tags, self.kids = tags, [[] for _ in tags]
        for k in range(1, len(tags)):
            self.kids[above[k]].append(k)
        self.shapes, self.sizes = [0] * len(tags), [1] * len(tags)
        self.known: dict[tuple, int] = {}
        old = like.known if like else {}
        for k in range(len(tags) - 1, -1, -1):
            key = (tags[k], *(self.shapes[c] for c in self.kids[k]))
            found = old.get(key)
            self.shapes[k] = self.known.setdefault(key, len(old) + len(self.known)) if found is None else found
            if k:
                self.sizes[above[k]] += self.sizes[k]
        self.like, self.made, self.words = like, [], {}
        self.kept: dict[tuple[int, int], np.ndarray] = {}
        self.room = KEPT

    def levels(self) -> list[Level]:
        if not self.made:
            self.words = {t: n for n, t in enumerate(dict.fromkeys(self.tags))}
            nodes, place = [0], {self.shapes[0]: 0}
            while nodes:
                below: dict[int, int] = {}
                for k in nodes:
                    for c in self.kids[k]:
                        below.setdefault(self.shapes[c], c)
                following, below = list(below.values()), {shape: n for n, shape in enumerate(below)}
                self.made.append(Level(self, nodes, place, below))
                nodes, place = following, below
        return self.made

    def against(self, k: int, depth: int) -> np.ndarray | None:
        """Sizes of the largest matchings of the subtree at k with each shape at that depth of the other tree, and 0 for a gap; None: all are 0."""
        levels, words = self.like.levels(), self.like.words
        open_, done = [], self._known(k, depth, levels, words)
        if done is not False:
            return done
        open_.append((k, depth, iter(self.kids[k]), levels[depth].base.copy()))
        while open_:
            k, depth, rest, row = open_[-1]
            level = levels[depth]
            if done is not False and done is not None:
                # The table's next row of all shapes at once: leave the child, leave theirs, or pair both.
                paired = row[:-1] + done.take(level.row)
                np.maximum.accumulate(np.maximum(paired, row[1:], out=paired), out=row[1:])
            c = next(rest, None)
            if c is not None:
                done = self._known(c, depth + 1, levels, words)
                if done is False:
                    open_.append((c, depth + 1, iter(self.kids[c]), levels[depth + 1].base.copy()))
            else:
                open_.pop()
                done = np.append(np.where(level.tags == words[self.tags[k]], row[level.ends] - level.start + 1, 0), 0).astype(np.int32)
                self._keep(k, depth, done)
        return done

    def _known(self, k: int, depth: int, levels: list[Level], words: dict[str, int]) -> np.ndarray | None | bool:
        """What is known of `against` without a look at children; False: nothing."""
        if depth >= len(levels) or words.get(self.tags[k]) not in levels[depth].present:
            return None
        found = self.kept.get((depth, self.shapes[k]))
        if found is None and (not self.kids[k] or depth + 1 == len(levels)):
            found = np.append(levels[depth].tags == words[self.tags[k]], False).astype(np.int32)
            self._keep(k, depth, found)
        return False if found is None else found

    def _keep(self, k: int, depth: int, found: np.ndarray) -> None:
        if len(found) <= self.room:
            self.room -= len(found)
            self.kept[(depth, self.shapes[k])] = found

    def pairs(self, xs: list[int], ys: list[int], depth: int) -> list[tuple[int, int]]:
        """The pairs of children of two paired nodes, xs and the other tree's ys, both at that depth.

        Equal shapes at both ends belong together, so that the table is only
        made of what is between.
        """
        other, out = self.like, []
        i, j, low = len(xs), len(ys), 0
        while i and j and self.shapes[xs[i - 1]] == other.shapes[ys[j - 1]]:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
        while low < i and low < j and self.shapes[xs[low]] == other.shapes[ys[low]]:
            low += 1
        if i == j == low + 1:
            i = low
            if self.tags[xs[low]] == other.tags[ys[low]]:
                j = low
                out.append((xs[low], ys[low]))
        elif i > low and j > low:
            place = other.levels()[depth].place
            at = np.array([place[other.shapes[y]] for y in ys[low:j]])

            def sizes(n: int) -> np.ndarray:
                found = self.against(xs[low + n], depth)
                return np.zeros(len(at), np.int32) if found is None else found.take(at)

            found, i, j = best_in_order(i - low, j - low, sizes)
            out += [(xs[low + p], ys[low + q]) for p, q in found]
            i, j = low + i, low + j
        # One list's rest is equal to the start of the other's rest: a later child may hold all of an equal one.
        while i != j and i and j:
            if self._holds(xs[i - 1], ys[j - 1], depth, self.sizes[xs[i - 1]] if i < j else other.sizes[ys[j - 1]]):
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
            elif i < j:
                j -= 1
            else:
                i -= 1
        return out + list(zip(xs[:i], ys[:j], strict=True)) if i == j else out

    def _holds(self, x: int, y: int, depth: int, size: int) -> bool:
        other = self.like
        if self.shapes[x] == other.shapes[y]:
            return True
        if self.tags[x] != other.tags[y] or min(self.sizes[x], other.sizes[y]) < size:
            return False
        return size == 1 or int(self.against(x, depth)[other.levels()[depth].place[other.shapes[y]]]) == size

    def matched(self) -> list[int]:
        """For each node its node of the other tree, or -1, by a largest simple tree matching."""
        to, todo = [-1] * len(self.tags), [(0, 0, 0)] if self.tags[0] == self.like.tags[0] else []
        while todo:
            x, y, depth = todo.pop()
            to[x] = y
            if self.kids[x] and self.like.kids[y]:
                todo += [(p, q, depth + 1) for p, q in self.pairs(self.kids[x], self.like.kids[y], depth + 1)]
        return to


def best_in_order(n: int, m: int, sizes: Callable[[int], np.ndarray]) -> tuple[list[tuple[int, int]], int, int]:
    """Pairs (i, j) of n and m children, both falling, of the largest sum of sizes(i)[j], and how many of both are before the last pair's side ran out.

    The table's rows are kept up to TABLE numbers, else every so many, and those
    between computed again; rows of small tables are lists.
    """
    small = n * m <= 100

    def following(row, found):
        if small:
            out = [0]
            for q, size in enumerate(found):
                out.append(max(out[q], row[q + 1], row[q] + size))
            return out
        out = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + found), out=out[1:])
        return out

    step = max(TABLE // (m + 1), math.isqrt(n)) + 1
    last = (n - 1) // step
    marks = [[0] * (m + 1) if small else np.zeros(m + 1, np.int32)]
    row = marks[0]
    for i in range(last * step):
        row = following(row, sizes(i).tolist() if small else sizes(i))
        if (i + 1) % step == 0:
            marks.append(row)
    pairs, i, j = [], n, m
    for low in range(last * step, -1, -step):
        if not j:
            break
        rows, found = [marks.pop()], []
        for p in range(low, i):
            found.append(sizes(p).tolist() if small else sizes(p))
            rows.append(following(rows[-1], found[-1]))
        while i > low and j:
            size, now, before = found[i - 1 - low][j - 1], rows[i - low][j], rows[i - 1 - low]
            if size and now == before[j - 1] + size:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif now == before[j]:
                i -= 1
            else:
                j -= 1
    return pairs, i, j


def matching(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The node pairs of a largest simple tree matching of a and b (empty if their tags differ)."""

    def flat(root: Node) -> tuple[list[Node], list[int]]:
        nodes, above = [root], [-1]
        for k, node in enumerate(nodes):
            some = [c for c in node.children if type(c) is not str]
            nodes += some
            above += [k] * len(some)
        return nodes, above

    (xs, above_x), (ys, above_y) = flat(a), flat(b)
    to = Shapes(above_x, [x.tag for x in xs], Shapes(above_y, [y.tag for y in ys])).matched()
    return [(x, ys[j]) for x, j in zip(xs, to, strict=True) if j >= 0]


def aligned(a: Outline, b: Outline) -> list[int]:
    """For each element of a its element of b, or -1, by simple tree matching."""
    if b.shapes is None:
        b.shapes = Shapes(b.above, b.tags)
    return Shapes(a.above, a.tags, b.shapes).matched()


class Reference:
    """A group's representative page: its paths (elements of equal names under one path are one), and its items (path, text)."""

    def __init__(self, page: Outline):
        self.page, self.above, self.known, self.path = page, [-1], {}, [0]
        for k in range(1, len(page.names)):
            key = (self.path[page.above[k]], page.names[k])
            if key not in self.known:
                self.known[key] = len(self.above)
                self.above.append(key[0])
            self.path.append(self.known[key])
        self.tags, self.inside = ["", *(n.split(".")[0] for _, n in self.known)], [False] * len(self.above)
        for p in range(1, len(self.above)):
            self.inside[p] = self.inside[self.above[p]] or self.tags[p] == "article"
        self.items = list(dict.fromkeys((self.path[k], t) for k, t in page.blocks))

    def paths(self, page: Outline) -> list[int]:
        """The path of each element of a page: that of the element aligned with it, else the one its name has under its parent's path, else -1."""
        out = []
        for k, j in enumerate(aligned(page, self.page)):
            out.append(self.path[j] if j >= 0 else self.known.get((out[page.above[k]], page.names[k]), -1) if k else 0)
        return out


class Counts:
    """Of a group's pages: sizes of text by path; for each item its pages' text, up to ENOUGH different pages, and whether a page has the path without the text."""

    def __init__(self, of: Reference):
        self.of, self.sizes = of, [0] * len(of.above)
        self.held, self.pages, self.refuted = [0] * len(of.items), [set() for _ in of.items], [False] * len(of.items)

    def add(self, page: Outline, doc: int) -> None:
        paths, seen = self.of.paths(page), {}
        for k, text in page.blocks:
            path = paths[k]
            seen.setdefault(path, []).append(text)
            while path < 0:
                k = page.above[k]
                path = paths[k]
            self.sizes[path] += len(text)
        for n, (path, text) in enumerate(self.of.items):
            if path in seen:
                hits = seen[path].count(text)
                self.held[n] += hits * len(text)
                if not hits:
                    self.refuted[n] = True
                if len(self.pages[n]) < ENOUGH:
                    self.pages[n].add(doc)

    def rows(self) -> list[tuple[int, bool, int, list[int]]]:
        """(item, refuted, size, pages); sizes of paths have items from -1 down."""
        out = [(-1 - p, False, n, []) for p, n in enumerate(self.sizes) if n]
        return out + [(n, self.refuted[n], self.held[n], sorted(self.pages[n])) for n in range(len(self.held)) if self.pages[n]]


def wrapper_of(of: Reference, rows: list[tuple[int, bool, int, list[int]]]) -> dict:
    """The path of the container and the template items.

    An item is template if all pages with its path have its text there: ENOUGH
    different pages, or at least two of a group most of whose text varies
    (pages that are mostly alike may be copies of one text).  Where most of the
    text of a group's articles is constant, no text inside them is template.
    """
    sizes, constant = [0] * len(of.above), []
    for item, refuted, size, pages in rows:
        if item < 0:
            sizes[-1 - item] += size
        elif not refuted and len(set(pages)) > 1:
            constant.append((item, size, len(set(pages))))
    inside = [of.inside[of.items[item][0]] for item, _, _ in constant]
    varies = 2 * sum(n for _, n, _ in constant) <= sum(sizes)
    article = 2 * sum(c[1] for c, i in zip(constant, inside, strict=True) if i) <= sum(n for n, i in zip(sizes, of.inside, strict=True) if i)
    template = [(item, size) for (item, size, n), i in zip(constant, inside, strict=True) if (article and (varies or n >= ENOUGH) if i else varies or n >= ENOUGH)]
    for item, size in template:
        sizes[of.items[item][0]] -= size
    for p in range(len(sizes) - 1, 0, -1):
        sizes[of.above[p]] += sizes[p]
    below: dict[int, list[int]] = {}
    for p in range(1, len(sizes)):
        below.setdefault(of.above[p], []).append(p)
    container = 0
    while container in below and sizes[0] > 0:
        best = max(below[container], key=sizes.__getitem__)
        if sizes[best] < SHARE * sizes[0] or of.tags[best] in _TEXT_TAGS:
            break
        container = best
    return {"container": container, "template": sorted(item for item, _ in template)}


def induce(pages: list[str]) -> dict:
    """The wrapper of pages of one group, the first being its representative; template as texts."""
    outlines = [Outline(*blocks(parse(p))) for p in dict.fromkeys(pages)]
    if not outlines:
        return {"container": 0, "template": []}
    counts = Counts(Reference(outlines[0]))
    for n, page in enumerate(outlines):
        counts.add(page, n)
    made = wrapper_of(counts.of, counts.rows())
    return {"container": made["container"], "template": sorted(counts.of.items[n][1] for n in made["template"])}


def text_of(page: Outline, of: Reference | None = None, wrapper: dict | None = None) -> str:
    """The main text of one page, of its group's reference and wrapper if it has them."""
    found = page.blocks
    article = any(page.inside[k] for k, _ in found)
    if article:
        found = [b for b in found if page.inside[b[0]]]
    if wrapper and (wrapper["template"] or not article):
        paths, container, template = of.paths(page), wrapper["container"], {of.items[n] for n in wrapper["template"]}
        if not article:
            held = [False] * len(paths)
            for k, p in enumerate(paths):
                held[k] = p == container or (k > 0 and held[page.above[k]])
            found = [b for b in found if held[b[0]]] or found
        found = [(k, t) for k, t in found if (paths[k], t) not in template]
    return "\n\n".join(t for _, t in found)


def extract(page: str | None, wrapper: dict | None = None, of: Reference | None = None) -> str:
    """The main text of one page."""
    return text_of(Outline(*blocks(parse(page))), of, wrapper) if page else ""


def _outlines(pages: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with the page's layout and its outline as JSON (both null without html), for the column _html."""
    kinds = [f for f in pages.schema.fields if f.name in columns]
    schema = T.StructType([*kinds, T.StructField("layout", T.LongType()), T.StructField("page", T.StringType())])

    def run(batches):
        for b in batches:
            keys, made = [], []
            for raw in b.column("_html").to_pylist():
                found = blocks(parse(raw)) if raw else None
                keys.append(layout(*found[:2]) if found else None)
                made.append(json.dumps(found) if found else None)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kinds), pa.array(keys, pa.int64()), pa.array(made, pa.string())], names=schema.names)

    return pages.select(*(f.name for f in kinds), "_html").mapInArrow(run, schema)


def groups(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups of pages, which are a host's pages of one layout (kind) or those whose layout no other page has (null), of outlines (host, doc, layout, page).

    Two tables: (host, layout, kind, parts) names the group of each layout,
    (host, kind, parts, rep) has each group's representative once; parts is
    into how many shares of about PART pages it is dealt.
    """
    size = F.ceil(F.sum("n") / PART).cast("int").alias("parts")
    each = saved(read.where("layout is not null").groupBy("host", "layout").agg(F.min("doc").alias("doc"), (F.min("doc") < F.max("doc")).alias("many"), F.count("*").alias("n")))
    single = each.where("not many")
    rest = single.groupBy("host").agg(F.min("doc").alias("doc"), F.count("*").alias("layouts"), size).where("layouts > 1").drop("layouts")
    kinds = each.where("many").groupBy("host", F.col("layout").alias("kind")).agg(F.min("doc").alias("doc"), size)
    named = saved(kinds.unionByName(rest.withColumn("kind", F.lit(None).cast("long"))))
    layouts = kinds.select("host", F.col("kind").alias("layout"), "kind", "parts").union(single.select("host", "layout").join(rest, "host").select("host", "layout", F.lit(None).cast("long"), "parts"))
    texts = read.select("doc", "page").join(bounded(named.select("doc").distinct()), "doc").groupBy("doc").agg(F.max("page").alias("rep"))
    return saved(layouts), saved(named.join(texts, "doc").drop("doc"))


def _beside(read: DataFrame, layouts: DataFrame, reps: DataFrame) -> DataFrame:
    """The outlines with their group's kind and the columns of reps, which has a row for each group.

    Up to SMALL layouts these columns are on every row.  Beyond, outlines are
    dealt to shares of groups, in which a row without a page, ahead of all
    others, has these columns once; see Beside.
    """
    values = [c for c in reps.columns if c not in ("host", "kind", "parts")]
    if layouts.limit(SMALL + 1).count() <= SMALL:
        both = layouts.alias("l").join(reps.alias("r"), same((F.col("l.host"), F.col("r.host")), (F.col("l.kind"), F.col("r.kind"))))
        return read.join(F.broadcast(both.select("l.host", "l.layout", "l.kind", *values)), ["host", "layout"], "left")
    pages = read.join(bounded(layouts), ["host", "layout"], "left").withColumn("part", F.pmod("doc", F.coalesce("parts", F.lit(1))).cast("int"))
    heads = reps.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return pages.unionByName(heads, allowMissingColumns=True).repartition("host", "kind", "part").sortWithinPartitions("host", "kind", "part", F.col("rep").isNull())


class Beside:
    """The reference and wrapper of the row at hand: its own, or those of the row ahead of its share."""

    def __init__(self):
        self.known, self.last, self.at = {}, None, (None, None)

    def of(self, host: str, kind: int | None, rep: str | None, wrapper: str | None = None) -> tuple[Reference | None, dict | None]:
        if rep is None:
            return self.at if self.last == (host, kind) else (None, None)
        if (host, kind) != self.last:
            self.last = (host, kind)
            if self.last not in self.known:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[self.last] = Reference(Outline(*json.loads(rep))), json.loads(wrapper) if wrapper else None
            self.at = self.known[self.last]
        return self.at


def wrappers(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, layout, kind, parts) of each layout, and (host, kind, parts, rep, wrapper): a JSON wrapper of each group of outlines."""
    layouts, reps = groups(read)
    joined = _beside(read.where("page is not null").select("host", "doc", "layout", "page"), layouts, reps).select("host", "kind", "doc", "page", "rep")

    def count(batches):
        at: dict[tuple, Counts] = {}
        beside, names = Beside(), ["host", "kind", "item", "refuted", "size", "pages"]

        def made() -> pa.RecordBatch:
            out = [(*key, *row) for key, c in at.items() for row in c.rows()]
            at.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [[]] * 6, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=names)

        for b in batches:
            for host, kind, doc, page, rep in zip(*(b.column(c).to_pylist() for c in ("host", "kind", "doc", "page", "rep")), strict=True):
                of, _ = beside.of(host, kind, rep)
                if of is None or page is None:
                    continue
                if (host, kind) not in at:
                    if len(at) >= KNOWN:
                        yield made()
                    at[(host, kind)] = Counts(of)
                at[(host, kind)].add(Outline(*json.loads(page)), doc)
        yield made()

    counted = joined.mapInArrow(count, "host string, kind long, item int, refuted boolean, size long, pages array<long>")
    items = counted.groupBy("host", "kind", "item").agg(F.max("refuted").alias("refuted"), F.sum("size").alias("size"), F.array_distinct(F.flatten(F.collect_list("pages"))).alias("pages"))
    items = items.withColumn("pages", F.slice("pages", 1, ENOUGH))
    held = items.groupBy("host", "kind").agg(F.to_json(F.collect_list(F.array(F.col("item").cast("long"), F.col("refuted").cast("long"), F.col("size"), F.size("pages").cast("long")))).alias("rows"))
    pair = reps.alias("r").join(held.alias("h"), same((F.col("r.host"), F.col("h.host")), (F.col("r.kind"), F.col("h.kind")))).select("r.host", "r.kind", "parts", "rep", "rows")

    def make(batches):
        for b in batches:
            out = []
            for rep, raw in zip(b.column("rep").to_pylist(), b.column("rows").to_pylist(), strict=True):
                out.append(json.dumps(wrapper_of(Reference(Outline(*json.loads(rep))), [(i, bool(r), n, list(range(p))) for i, r, n, p in json.loads(raw)])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("host", "kind", "parts", "rep")), pa.array(out, pa.string())], names=["host", "kind", "parts", "rep", "wrapper"])

    return layouts, saved(pair.mapInArrow(make, "host string, kind long, parts int, rep string, wrapper string"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, url, text and n_chars."""
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("_url")), F.lit(" "))).withColumn("doc", F.coalesce(F.xxhash64("_html"), F.lit(0)))
    read = saved(_outlines(rows, ["_key", "_url", "host", "doc"]))
    joined = _beside(read.withColumn("row", F.lit(True)), *wrappers(read)).select("_key", "_url", "host", "kind", "page", "rep", "wrapper", "row")
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField(url, pages.schema[url].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        beside = Beside()
        for b in batches:
            texts, real = [], b.column("row").is_valid()
            for host, kind, page, rep, raw in zip(*(b.column(c).to_pylist() for c in ("host", "kind", "page", "rep", "wrapper")), strict=True):
                of, wrapper = beside.of(host, kind, rep, raw)
                texts.append(text_of(Outline(*json.loads(page)), of, wrapper) if page else "")
            made = pa.RecordBatch.from_arrays([b.column("_key"), b.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)
            yield made.filter(real)

    return joined.mapInArrow(run, schema)
