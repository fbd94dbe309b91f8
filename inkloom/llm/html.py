"""Operator 3: main text of web pages by wrapper induction.

For every host a few pages are its pivots, one for each layout that they happen to show. All pages of the host are aligned
with the pivot that fits best, by simple tree matching: the largest number of node pairs with equal labels that keeps
order and ancestry. What the alignments of all pages say is counted for every node of a pivot: nodes whose kind (the
chain of labels from the root) carries one and the same text on all pages are template, the others are slots, with as
much varying text as they held. The wrapper is the smallest element of the pivot that holds the varying text, and the
template kinds. It decides what is content: a page's text is that of the element aligned with the wrapper's, less
template, and less what HTML itself or an element's name marks as menu, advert, form, comment and the like.

A page without a wrapper (the only page of its host, copies only, or another layout) is read by itself: marked articles,
else the smallest element with all blocks that aren't links. The column `way` says which way was taken.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import common

PIVOTS = 3  # pages of a host that all others are aligned with, at most
BROADCAST_BYTES = 64 << 20  # wrappers and pivots are broadcast up to this size, else joined by a shuffle
LAYOUT = 0.5  # pages of one layout share so much of their kinds of elements, however many of each there are
COPY = 0.8  # pages that share more of their text with the pivot are copies and tell nothing
MATRIX = 4_000_000  # cells of a table that is kept to trace an alignment; beyond, it is halved and traced in parts

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes")}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul #root".split()
)
#: A start tag that ends open elements of these tags, up to the nearest element of the second set.
CLOSES = {
    **{t: ({"p"}, {"button", "td", "th", "table", "object"}) for t in BLOCKS - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "#root"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}),
    "th": ({"td", "th", "p"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "p"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input iframe object embed canvas audio video map "
    "dialog menu datalist noframes xmp frameset applet fieldset".split()
)
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus "
    "dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion "
    "recommended recommendations related reply respond rss search share sharing shares sidebar sidenav signup skip social sponsor sponsored subscribe subscription tagcloud toc "
    "toolbar topbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
#: Elements that only hold others; the text of any other block is text of its own.
CONTAINERS = frozenset("#root html body main article section div center table tbody thead tfoot tr td header".split())
MARKED = frozenset(("article", "main"))


class Tree:
    """A page's elements in document order, by number; element 0 is the root.

    items: the page from start to end: n opens element n, -n-1 closes it, a string is text.
    """

    def __init__(self):
        self.tag, self.attrs, self.parent = ["#root"], [{}], [-1]
        self.items: list[int | str] = [0]
        self._kinds: list[int] | None = None

    def __len__(self) -> int:
        return len(self.tag)

    def finish(self) -> Tree:
        """Labels, block children, own texts and structures; everything in loops, so any depth will do."""
        n = len(self)
        self.label = [_label(t, a.get("class", "")) if a else t for t, a in zip(self.tag, self.attrs)]
        #: the nearest block around (for a block: itself); -1 inside something that is no text
        self.owner = [0] * n
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            up, tag = self.owner[self.parent[i]], self.tag[i]
            if up < 0 or tag in DROPPED and tag not in BLOCKS:
                self.owner[i] = -1
            elif tag in BLOCKS:
                self.owner[i] = i
                self.kids[up].append(i)
            else:
                self.owner[i] = up
        parts: list[list[str]] = [[] for _ in range(n)]
        links, self.linked, at, deep = 0, [0] * n, 0, []
        for x in self.items:
            if isinstance(x, str):
                if self.owner[at] >= 0:
                    parts[self.owner[at]].append(x)
                    if links:
                        self.linked[self.owner[at]] += len(x.strip())
            elif x >= 0:
                deep.append(at)
                at = x
                links += self.tag[x] == "a"
                if self.tag[x] == "br" and self.owner[x] >= 0:
                    parts[self.owner[x]].append(" ")
            else:
                links -= self.tag[at] == "a"
                at = deep.pop()
        #: for each block, the text in it and its inline elements
        self.own = ["" if not p else " ".join(entities.unescape("".join(p)).split()) for p in parts]
        self.shape, self.size = [0] * n, [1] * n
        for i in range(n - 1, -1, -1):
            kids = self.kids[i]
            self.shape[i] = hash((self.label[i], *[self.shape[k] for k in kids]))
            self.size[i] += sum([self.size[k] for k in kids])
        return self

    def kinds(self) -> list[int]:
        """A hash of the chain of labels from the root to each block; 0 for other elements."""
        if self._kinds is None:
            out = [0] * len(self)
            for i in range(len(self)):
                for k in self.kids[i]:
                    out[k] = zlib.crc32(self.label[k].encode("utf-8", "surrogatepass"), out[i])
            self._kinds = out
        return self._kinds


@lru_cache(maxsize=4096)
def _label(tag: str, classes: str) -> str:
    """The tag and up to three class names, without digits (post-17 and post-18 are alike)."""
    return tag + "".join(f".{c}" for c in sorted(re.sub(r"\d+", "", x) for x in classes.split())[:3])


@lru_cache(maxsize=4096)
def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(raw)}


def parse(text: str) -> Tree:
    """A tree for any text: void, optional and missing end tags as HTML has them; end tags without a start are ignored."""
    t = Tree()
    stack, opened, at, n = [0], {"#root": 1}, 0, len(text)

    def cut(place: int) -> None:
        while len(stack) > place:
            x = stack.pop()
            opened[t.tag[x]] -= 1
            t.items.append(-x - 1)

    while at < n:
        m = TOKEN.search(text, at)
        if m is None:
            t.items.append(text[at:])
            break
        if m.start() > at:
            t.items.append(text[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if opened.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if t.tag[stack[i]] == tag:
                        cut(i)
                        break
                    if tag not in BLOCKS and t.tag[stack[i]] in BLOCKS:
                        break
            continue
        ends, limits = CLOSES.get(tag, ((), ()))
        if any(opened.get(e) for e in ends):
            for i in range(len(stack) - 1, 0, -1):
                name = t.tag[stack[i]]
                if name in ends:
                    cut(i)
                    if tag in ("tr", "tbody", "td", "th", "li", "dt", "dd"):
                        continue
                    break
                if name in limits:
                    break
        raw = m[3] or m[6] or ""
        x = len(t)
        t.tag.append(tag)
        t.attrs.append(_attributes(raw) if raw else {})
        t.parent.append(stack[-1])
        t.items.append(x)
        if tag in RAW:
            end = RAW[tag].search(text, at)
            at = end.end() if end else n
            t.items.append(-x - 1)
        elif tag in VOID or (m[3] or "").endswith("/"):
            t.items.append(-x - 1)
        else:
            stack.append(x)
            opened[tag] = opened.get(tag, 0) + 1
    cut(0)
    return t.finish()


class Matching:
    """Simple tree matching of the blocks of two pages, exact for lists of any length.

    Equal subtrees at both ends of two lists of children are matched with each other, which never loses a pair. Sizes of
    matchings are kept by the subtrees' structures, so repeated structures are compared once.
    """

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b = a, b
        self.sizes: dict[tuple[int, int], int] = {}

    def trimmed(self, x: int, y: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """The children of x and y without equal ends, and the pairs at the ends."""
        p, q, sa, sb = self.a.kids[x], self.b.kids[y], self.a.shape, self.b.shape
        i, n, m = 0, len(p), len(q)
        while i < n and i < m and sa[p[i]] == sb[q[i]]:
            i += 1
        j = 0
        while j < n - i and j < m - i and sa[p[n - 1 - j]] == sb[q[m - 1 - j]]:
            j += 1
        return p[i : n - j], q[i : m - j], list(zip(p[:i], q[:i])) + list(zip(p[n - j :], q[m - j :]))

    def size(self, x: int, y: int) -> int:
        """Pairs of a largest matching of two elements with equal labels."""
        a, b, sizes, todo = self.a, self.b, self.sizes, [(x, y)]
        while todo:
            u, v = todo[-1]
            key = a.shape[u], b.shape[v]
            if key in sizes:
                todo.pop()
                continue
            if key[0] == key[1]:
                sizes[key] = a.size[u]
                continue
            p, q, ends = self.trimmed(u, v)
            some = {a.shape[c]: c for c in p}, {b.shape[d]: d for d in q}
            open_ = [(c, d) for s, c in some[0].items() for z, d in some[1].items() if a.label[c] == b.label[d] and (s, z) not in sizes]
            if open_:
                todo.extend(open_)
                continue
            last = self.row(p, q)
            sizes[key] = 1 + sum(a.size[c] for c, _ in ends) + int(last[-1])
        return sizes[a.shape[x], b.shape[y]]

    def weights(self, p: list[int], q: list[int]) -> Iterator[np.ndarray]:
        """For each of p its matching size with each of q; 0 where labels differ."""
        a, b = self.a, self.b
        shapes = sorted({b.shape[d] for d in q})
        place = {s: i for i, s in enumerate(shapes)}
        rep = {b.shape[d]: b.label[d] for d in q}
        column, known = np.array([place[b.shape[d]] for d in q], np.int64), {}
        for c in p:
            s = a.shape[c]
            if s not in known:
                known[s] = np.array([self.sizes.get((s, z), 0) if a.label[c] == rep[z] else 0 for z in shapes], np.int64)[column]
            yield known[s]

    def row(self, p: list[int], q: list[int]) -> np.ndarray:
        """Largest matchings of all of p with each beginning of q."""
        best = np.zeros(len(q) + 1, np.int64)
        if p and q:
            for w in self.weights(p, q):
                best[1:] = np.maximum(best[1:], np.where(w > 0, best[:-1] + w, 0))
                np.maximum.accumulate(best, out=best)
        return best

    def lists(self, p: list[int], q: list[int]) -> list[tuple[int, int]]:
        """The pairs of a largest matching of two lists of children."""
        out, todo = [], [(p, q)]
        while todo:
            p, q = todo.pop()
            if not p or not q:
                continue
            if len(p) > 1 and len(p) * len(q) > MATRIX:
                half = len(p) // 2
                front, back = self.row(p[:half], q), self.row(p[half:][::-1], q[::-1])
                at = int(np.argmax(front + back[::-1]))
                todo += [(p[:half], q[:at]), (p[half:], q[at:])]
                continue
            table, each = np.zeros((len(p) + 1, len(q) + 1), np.int64), list(self.weights(p, q))
            for i, w in enumerate(each):
                table[i + 1, 1:] = np.maximum(table[i, 1:], np.where(w > 0, table[i, :-1] + w, 0))
                np.maximum.accumulate(table[i + 1], out=table[i + 1])
            i, j = len(p), len(q)
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((p[i], q[j]))
        return out

    def pairs(self) -> list[tuple[int, int]]:
        """All pairs of a largest matching."""
        a, b, found, todo = self.a, self.b, [], [(0, 0)]
        self.size(0, 0)
        while todo:
            x, y = todo.pop()
            found.append((x, y))
            if a.shape[x] == b.shape[y]:
                todo.extend(zip(a.kids[x], b.kids[y]))
                continue
            p, q, ends = self.trimmed(x, y)
            todo.extend(ends)
            if p and q:
                todo.extend(self.lists(p, q))
        return found


def crc(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def fitting(pivots: list[Tree], page: Tree) -> list[tuple[int, Matching]]:
    """(pivot, its matching with the page) of the pivots of the page's layout, that of the largest share of matched nodes first."""
    found, mine = [], set(page.kinds())
    for k, pivot in enumerate(pivots):
        others = set(pivot.kinds())
        if 2 * len(mine & others) < LAYOUT * (len(mine) + len(others)) or len(mine & others) < 2:
            continue
        m = Matching(pivot, page)
        found.append((-2 * m.size(0, 0) / (pivot.size[0] + page.size[0]), k, m))
    return [(k, m) for _, k, m in sorted(found, key=lambda x: x[:2])]


def observed(pivots: list[Tree], page: Tree) -> list[tuple[int, int, int, int]]:
    """(pivot, its element, 1 if the aligned text is the same, characters that differ) of the texts of a page.

    The pivot is the one that fits best without being a copy. A page that shares over COPY of its aligned text with a
    pivot is that pivot itself, or a copy, and tells nothing about it.
    """
    for k, m in fitting(pivots, page):
        out, same, total = [], 0, 0
        for x, y in m.pairs():
            s, t = m.a.own[x], page.own[y]
            if s or t:
                n = max(len(s), len(t))
                total += n
                same += n * (s == t)
                out.append((k, x, int(s == t), 0 if s == t else len(t)))
        if total and same <= COPY * total:
            return out
    return []


def induced(pivot: Tree, counts: dict[int, tuple[int, int, int]]) -> tuple[int, dict[int, list[int]]] | None:
    """(content element, template: checksums of texts by kind) from (pages, same, differing characters) of elements.

    Template: kinds of which every text was the same on all pages. The content element: from the root down, as long as
    one child that only holds others has at least nine tenths of the varying text and what stands beside it is neither a
    heading, nor text of its own, nor a marked article. None if no text varies.
    """
    kinds, varies, fixed = pivot.kinds(), set(), {}
    for x, (pages, same, _) in counts.items():
        if same < pages:
            varies.add(kinds[x])
    for x, (pages, _, _) in counts.items():
        if pivot.own[x] and kinds[x] not in varies:
            fixed.setdefault(kinds[x], []).append(crc(pivot.own[x]))
    noise = noisy(pivot)
    weight = [0] * len(pivot)
    for x, (_, _, chars) in counts.items():
        if kinds[x] in varies and not noise[x] and 2 * pivot.linked[x] <= len(pivot.own[x]):
            weight[x] = chars
    total, speaks = weight[:], [False] * len(pivot)
    for x in range(len(pivot) - 1, -1, -1):
        for k in pivot.kids[x]:
            total[x] += total[k]
            speaks[x] |= speaks[k]
        speaks[x] |= pivot.tag[x] in HEADINGS and weight[x] > 0 or pivot.tag[x] in MARKED and total[x] > 0
    at = 0
    if not total[0]:
        return None
    while not weight[at]:
        best = max(pivot.kids[at], key=total.__getitem__, default=None)
        if best is None or pivot.tag[best] not in CONTAINERS or 10 * total[best] < 9 * total[at]:
            break
        if any(total[k] and (speaks[k] or pivot.tag[k] not in CONTAINERS) for k in pivot.kids[at] if k != best):
            break
        at = best
    return at, fixed


def noisy(t: Tree) -> list[int]:
    """Whether an element is left out, by itself or with an element around it: 0 if it stays.

    What holds a marked article is never left out for its name. Of a header inside an article the headings stay (2: in
    such a header); a header outside goes.
    """
    n = len(t)
    holds = [False] * n
    for x in range(n - 1, 0, -1):
        if holds[x] or t.tag[x] in MARKED:
            holds[t.parent[x]] = True
    out, inside = [0] * n, [False] * n
    for x in range(1, n):
        up, tag = t.parent[x], t.tag[x]
        inside[x] = inside[up] or tag == "article"
        if out[up] == 1 or _named(tag, t.attrs[x], inside[x]) and not (tag not in DROPPED and holds[x]):
            out[x] = 1
        elif out[up] == 2:
            out[x] = 0 if tag in HEADINGS else 2
        elif tag == "header" and not holds[x]:
            out[x] = 2 if inside[x] else 1
    return out


def _named(tag: str, a: dict[str, str], inside: bool) -> bool:
    """Whether an element's tag, role or names mark it as no content; inside: it stands in an article."""
    if tag in DROPPED:
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    if a.get("role", "").lower() in ROLES:
        return True
    words = {w.lower() for w in WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    return bool(words & NOISE) or not inside and "header" in words


def blocks(t: Tree, regions: list[int], muted: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The texts of blocks below the regions, in page order, without noise; `muted`: blocks whose own text goes."""
    noise, chosen = noisy(t), set(regions)
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        s = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if s:
            out.append(s)

    depth, at, deep = 0, 0, []
    for x in t.items:
        if isinstance(x, str):
            if depth and not noise[at] and t.owner[at] not in muted:
                held.append(x)
            continue
        if x >= 0:
            deep.append(at)
            at = x
            depth += x in chosen
            if t.tag[x] == "br":
                held.append(" ")
        else:
            depth -= at in chosen
        if t.tag[at] in BLOCKS:
            end()
        if x < 0:
            at = deep.pop()
    end()
    return out


def alone(t: Tree) -> list[int]:
    """The content elements of a page read by itself: all marked ones, else the smallest with all blocks that aren't links."""
    noise = noisy(t)
    text = [len(s) if not n and o == x else 0 for x, (s, n, o) in enumerate(zip(t.own, noise, t.owner))]
    plain = [n if not n or 2 * k <= n or tag == "h1" else 0 for n, k, tag in zip(text, t.linked, t.tag)]
    total = text[:]
    for x in range(len(t) - 1, 0, -1):
        up = t.owner[t.parent[x]]
        if up >= 0 and t.owner[x] == x:
            total[up] += total[x]
            plain[up] += plain[x]
    for test in (lambda x: t.attrs[x].get("itemprop", "").lower() == "articlebody" or t.tag[x] == "article", lambda x: t.tag[x] == "main" or t.attrs[x].get("role", "").lower() == "main"):
        found, covered = [], [False] * len(t)
        for x in range(1, len(t)):
            covered[x] = covered[t.parent[x]]
            if not covered[x] and not noise[x] and test(x):
                covered[x] = True
                if t.owner[x] != x or total[x]:
                    found.append(x)
        if found:
            return found
    at = 0
    while plain[at]:
        inner = next((k for k in t.kids[at] if plain[k] == plain[at]), None)
        if inner is None:
            break
        at = inner
    return [at]


class Wrapper:
    """A host's pivots, and for each the content element and the template; empty: nothing is content."""

    def __init__(self, pivots: list[str], learnt: list[tuple[int, dict[int, list[int]]] | None]):
        self.pivots = [parse(p) for p in pivots]
        self.kinds = [p.kinds() for p in self.pivots]
        self.learnt = learnt

    @classmethod
    def of(cls, pivots: list[str], counts: dict[tuple[int, int], tuple[int, int, int]]) -> Wrapper:
        out = cls(pivots, [])
        for k, p in enumerate(out.pivots):
            out.learnt.append(induced(p, {x: n for (q, x), n in counts.items() if q == k}))
        return out

    def read(self, t: Tree) -> list[str] | None:
        """The blocks of a page's content; None if the wrapper doesn't know its layout."""
        if not self.learnt:
            return []
        for k, m in fitting(self.pivots, t):
            if self.learnt[k] is None:
                continue
            region, template = self.learnt[k]
            pairs, pivot = m.pairs(), self.pivots[k]
            chosen = next((y for x, y in pairs if x == region), None)
            if chosen is None:
                continue
            # further parts of an article stand beside the first
            parts = [y for y in t.kids[t.owner[t.parent[chosen]]] if t.label[y] == t.label[chosen]] if chosen and t.tag[chosen] in MARKED else [chosen]
            muted = {y for x, y in pairs if pivot.own[x] and pivot.own[x] == t.own[y] and crc(t.own[y]) in template.get(self.kinds[k][x], ())}
            return blocks(t, parts, muted)
        return None


def main_text(page: str | None, wrapper: Wrapper | None = None) -> tuple[str, str]:
    """(text, way): way is "wrapper", or "page" for a page read by itself."""
    if not page:
        return "", "page"
    t = parse(page)
    found = wrapper.read(t) if wrapper else None
    if found is not None:
        return "\n\n".join(found), "wrapper"
    return "\n\n".join(blocks(t, alone(t))), "page"


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)))


def pivots_of(pages: DataFrame, most: int = PIVOTS) -> DataFrame:
    """_host, pivots: for each host with two different pages or more, at most `most` of them (those of least hash in as many parts)."""
    some = with_host(pages).where((F.col("_host") != "") & (F.length("html") > 0)).withColumn("_h", F.xxhash64("html"))
    # one page of each of a host's parts: pre-aggregated, whatever the host's size
    some = some.groupBy("_host", F.pmod("_h", F.lit(most)).alias("_part")).agg(F.min_by("html", "_h").alias("html"), F.min("_h").alias("_a"), F.max("_h").alias("_b"))
    groups = some.groupBy("_host").agg(F.array_sort(F.collect_list("html")).alias("pivots"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return groups.where("_a <> _b").select("_host", "pivots", F.xxhash64("pivots").alias("_key"))


def _sized(df: DataFrame, size) -> DataFrame:
    """df, broadcast if its rows add up to less than BROADCAST_BYTES."""
    held = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


class _Kept(dict):
    """What a worker process has made of the last `most` keys."""

    def get_or(self, key: int, make, most: int = 400):
        if key not in self:
            if len(self) >= most:
                self.clear()
            self[key] = make()
        return self[key]


_trees, _wrappers = _Kept(), _Kept()


def counted(pages: DataFrame, pivots: DataFrame) -> DataFrame:
    """_host, pivot, element, pages, same, chars: what the alignments of all pages say of the pivots' elements."""
    names = ["_host", "pivot", "element", "pages", "same", "chars"]

    def batch(sums: dict) -> pa.RecordBatch:
        host, k, x = zip(*sums)
        return pa.RecordBatch.from_arrays([pa.array(host), *(pa.array(c, pa.int64()) for c in (k, x, *zip(*sums.values())))], names=names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], list[int]] = {}
        for b in common.in_slices(batches):
            held = b.column("pivots")
            for i, (host, page, key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_host", "html", "_key")))):
                trees = _trees.get_or(key, lambda i=i: [parse(p) for p in held[i].as_py()])
                for k, x, same, chars in observed(trees, parse(page)):
                    s = sums.setdefault((host, k, x), [0, 0, 0])
                    s[0] += 1
                    s[1] += same
                    s[2] += chars
            if len(sums) > 200_000:
                yield batch(sums)
                sums.clear()
        if sums:
            yield batch(sums)

    rows = with_host(pages).where(F.length("html") > 0).select("_host", "html").join(pivots, "_host").select("_host", "html", "pivots", "_key")
    found = rows.mapInArrow(look, "_host string, pivot long, element long, pages long, same long, chars long")
    return found.groupBy("_host", "pivot", "element").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"), F.sum("chars").alias("chars"))


def wrappers(pages: DataFrame, most: int = PIVOTS) -> DataFrame:
    """_host, pivots, counts (JSON: what counted() found of the host), _key (of both): one row for each host with two pages or more."""
    pivots = common.written(pivots_of(pages, most), "pivots")
    size = F.aggregate("pivots", F.lit(0), lambda n, p: n + F.length(p))
    found = counted(pages, _sized(pivots, size))
    # a host has no more of these than its pivots have elements
    lists = found.groupBy("_host").agg(F.to_json(F.array_sort(F.collect_list(F.array("pivot", "element", "pages", "same", "chars")))).alias("counts"))
    out = common.written(pivots.join(lists, "_host").select("_host", "pivots", "counts", F.xxhash64("pivots", "counts").alias("_key")), "wrappers")
    common.release(pivots)
    return out


def _learnt(pivots: list[str], counts: str) -> Wrapper:
    return Wrapper.of(pivots, {(k, x): (n, same, chars) for k, x, n, same, chars in json.loads(counts)})


def extract(pages: DataFrame, most: int = PIVOTS, learnt: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars, way of every row of pages(page_id, url, html).

    `most`: pages of a host that the others are aligned with; what the alignments say is counted over all pages. `learnt`:
    wrappers() of these pages, found here otherwise. Null or empty html: the empty text. Null or odd urls: read by
    themselves. Repeated rows are read each; null page_ids stay; an empty table gives no rows; other columns are ignored.
    Whole pages are read, however long, wide or deep.
    """
    learnt = wrappers(pages, most) if learnt is None else learnt
    size = F.length("counts") + F.aggregate("pivots", F.lit(0), lambda n, p: n + F.length(p))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_slices(batches):
            held, counts, found = b.column("pivots"), b.column("counts"), []
            for i, (page, key) in enumerate(zip(b.column("html").to_pylist(), b.column("_key").to_pylist())):
                wrapper = None if key is None else _wrappers.get_or(key, lambda i=i: _learnt(held[i].as_py(), counts[i].as_py()))
                found.append(main_text(page, wrapper))
            text, way = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(way, pa.string())], names=["page_id", "url", "text", "way"])

    out = with_host(pages.select("page_id", "url", "html")).join(_sized(learnt, size), "_host", "left").select("page_id", "url", "html", "pivots", "counts", "_key")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = out.mapInArrow(read, f"page_id {kind}, url string, text string, way string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "way")


def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
