"""Operator 10, main text of pages by wrapper induction.

Pages of one host that share a layout (the kinds of elements down to LAYOUT_DEPTH levels) come from one template.

1. One page of each layout is its pivot. Every page's tree is aligned with its layout's pivot by simple tree matching, so
   a block of text stands at a node of the pivot.
2. A node that holds the same text in nearly all of a layout's pages is template. What varies is a slot; the content
   region is the deepest container whose slots hold most of the layout's varying text. Both are judged on all pages.
3. A page's main text is what lies in the region's slots, in the article where HTML names one, less the parts that
   HTML itself names as something else: menus, headers, footers, sidebars, adverts, forms and comments. Pages of a layout
   with too few pages to tell have these rules alone.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marketloom.llm.common import BROADCAST_ROWS, HOT_KEYS, in_shards, joined, written

#: Distinct pages that a layout needs for a template, and their share that must agree on a node's text.
LEAST_PAGES, AGREE = 3, 0.8
#: Share of the varying text that the content region holds at least.
REGION = 0.67
LAYOUT_DEPTH = 3
SHARD_BYTES = 4 << 20
#: Elements nested deeper belong to the node at this depth when trees are aligned; texts are not concerned.
DEEPEST = 150
#: A page of at most so many bytes is a layout's pivot where there is one, else the layout's shortest page.
PIVOT_BYTES = 1 << 16
#: Pivots' trees of at most so many bytes in all are broadcast, and a task keeps so many bytes of them unpacked.
PIVOTS_BYTES, UNPACKED_BYTES = 16 << 20, 2 << 20
#: Lists of children with more pairs than this are matched by rows of arrays, with at most about CELLS cells of the table held at once;
#: subtrees of like build are weighed together from so many pairs on.
MOST_PAIRS, CELLS, LIKE_PAIRS = 40_000, 1 << 23, 64

# Element names of HTML by what they do.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
    "button", "select", "option", "optgroup", "svg", "canvas", "object", "video", "audio", "map", "math",
}
NOT_TEXT = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "optgroup", "svg", "canvas", "object", "video", "audio", "map", "search", "dir"}
NOT_TEXT_NAMES = {
    "ad", "ads", "adbox", "adsense", "adslot", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus",
    "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "reactions", "related", "replies", "reply",
    "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
NOT_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: What an opening tag ends if it is still open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: A tag goes on to its > outside of quoted values, a tag without one to the end of the page: so each is read once. Quotes
#: count after = alone, and one that is never closed doesn't count.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: What may stand beside one of NOT_TEXT_NAMES in a name: site-header, ad-slot-2, comment-list.
BESIDE = {"area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "container", "group", "inner", "items", "left", "links", "list", "outer", "page", "panel", "right", "site", "slot", "thread", "top", "wrap", "wrapper"}
#: Of NOT_TEXT_NAMES those that say so beside more words too (user-comments, main-nav), as these words seldom name text.
PLAIN_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "gdpr", "menu", "nav", "navbar", "navigation", "newsletter",
    "pagination", "promo", "related", "sidebar", "social", "sponsored",
}
BESIDE_PLAIN = BESIDE | {
    "article", "articles", "column", "content", "desktop", "entry", "footer", "full", "global", "header", "item", "main", "message", "mobile", "module", "news", "post", "posts", "primary", "reader", "readers", "secondary", "section",
    "sections", "sticky", "stories", "story", "sub", "tertiary", "text", "title", "unit", "units", "user", "users", "view", "zone",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What only a page as a whole has: a form around one of these is the page's frame and no form.
PAGE_PARTS = {"article", "main", "nav", "header", "footer"}
UPPER_KINDS = NOT_TEXT | {"html", "body", "main", "article", "section", "div", "center", "table", "tbody", "tr", "td", "dl", "fieldset"}
CONTAINERS = {"#page", "html", "body", "main", "article", "section", "div", "center", "table", "tbody", "tr", "td", "dl", "fieldset"}


@dataclass(slots=True)
class Node:
    """An element, or a leaf with the hash of its text."""

    label: str
    children: list = field(default_factory=list)
    text: int = 0
    up: Node | None = None


@dataclass(slots=True)
class Run:
    """Text between two block borders."""

    text: str
    dropped: bool
    article: bool
    node: Node


def _names(value: str, whole: bool) -> bool:
    """Does one of the names say that this isn't text? A name does if each of its parts is such a word or stands beside one."""
    for name in value.split():
        parts = [x.lower() for x in NAME_PART.findall(name)]
        if whole:
            found = len(parts) == 1 and parts[0] in NOT_TEXT_NAMES
        else:
            beside = BESIDE_PLAIN if any(x in PLAIN_NAMES for x in parts) else BESIDE
            found = any(x in NOT_TEXT_NAMES for x in parts) and all(x in NOT_TEXT_NAMES or x in beside or x.isdigit() for x in parts)
        if found:
            return True
    return False


def _drops(tag: str, attributes: dict[str, str], article: bool) -> str | bool:
    """Whether an element is something else than text; the tag's name where that hangs on what the element holds."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag == "form" and not article or tag == "header" and article:
        return attributes.get("role", "").lower() in NOT_TEXT_ROLES or tag
    if tag in NOT_TEXT:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if attributes.get("role", "").lower() in NOT_TEXT_ROLES:
        return True
    # headings and paragraphs are text unless a name of one word says otherwise
    return _names(f"{attributes.get('class', '')} {attributes.get('id', '')}", tag == "p" or tag in HEADINGS)


class Form:
    """A form outside of articles, which may be the frame of a page."""

    wraps = False


def parse(page: str) -> tuple[list[Run], Node]:
    """A page's text runs in order, and its tree of block elements with the runs as leaves.

    A form that holds the page's menu, header, footer or article is its frame, and what it holds is judged as if there were
    no form. Of an article's header the headings are text. A tag that the page's end cuts off isn't text.
    """
    runs: list[Run] = []
    root = Node("#page")
    # of each open block: tag, dropped (True, False, "header" or a form), within article, node
    open_: list[tuple] = [("#page", False, False, root)]
    times: Counter[str] = Counter()
    held: list[str] = []

    def close(down_to: int) -> None:
        while len(open_) > down_to:
            times[open_.pop()[0]] -= 1

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                _, dropped, article, node = open_[-1]
                leaf = Node("#text", text=xxhash.xxh3_64_intdigest(text), up=node)
                node.children.append(leaf)
                runs.append(Run(text, dropped, article, leaf))

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                if times[tag]:
                    close(next(k for k in range(len(open_) - 1, 0, -1) if open_[k][0] == tag))
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.IGNORECASE).search(page, at)
            if end is None:
                break
            at = page.find(">", end.start()) + 1 or n
            continue
        if tag == "br":
            held.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if tag == "hr":
            continue
        if tag not in ("option", "optgroup") and open_[-1][0] == "p":
            close(len(open_) - 1)
        ends = ENDS.get(tag, ())
        while open_[-1][0] in ends:
            close(len(open_) - 1)
        attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[3])} if m[3].strip(" /\n\t\r") else {}
        name = attributes.get("class", "") or attributes.get("id", "")
        label = f"{tag}.{name}" if name else tag
        _, dropped, article, node = open_[-1]
        main = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        own = Node(label, up=node) if len(open_) < DEEPEST else node
        if own is not node:
            node.children.append(own)
        if dropped is not True:
            if isinstance(dropped, Form) and (main or tag in PAGE_PARTS):
                dropped.wraps, dropped = True, False
            elif dropped == "header" and tag in HEADINGS:
                dropped = False
            inner = _drops(tag, attributes, article)
            dropped = (bool(dropped) or Form()) if inner == "form" else inner or dropped
        open_.append((tag, dropped, article or main, own))
        times[tag] += 1
        if m[3].endswith("/") and tag in ("svg", "math"):
            close(len(open_) - 1)
    flush()
    for r in runs:
        r.dropped = not r.dropped.wraps if isinstance(r.dropped, Form) else bool(r.dropped)
    return runs, root


def main_text(page: str) -> str:
    """Blocks of the article (of the whole page where none holds text) that HTML doesn't name as something else."""
    runs = [r for r in parse(page)[0] if not r.dropped]
    return "\n".join(r.text for r in [r for r in runs if r.article] or runs)


def layout(root: Node, depth: int = LAYOUT_DEPTH) -> int:
    """A name for the kinds of elements of the upper levels, each kind once a parent."""

    def kinds(node: Node, left: int) -> str:
        inside = sorted({kinds(c, left - 1) for c in node.children if c.label != "#text" and c.label.split(".")[0] in UPPER_KINDS}) if left else ()
        return f"{node.label}({' '.join(inside)})"

    return xxhash.xxh3_64_intdigest("".join(sorted({kinds(c, depth) for c in root.children if c.label != "#text"}))) >> 1


def _trimmed(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many children agree in label and text from the front and from the back: they are pairs of a best matching."""
    most = min(len(a), len(b))

    def alike(x: Node, y: Node) -> bool:
        return x.label == y.label == "#text" and x.text == y.text

    front = next((k for k in range(most) if not alike(a[k], b[k])), most)
    return front, next((k for k in range(most - front) if not alike(a[-1 - k], b[-1 - k])), most - front)


class Builds:
    """Kinds of trees that differ in texts alone: label, children's kinds and number of texts, by number."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.kinds: list[tuple] = []

    def number(self, node: Node, texts: list[int]) -> int:
        """The number of a tree's kind; its texts are added in order."""
        before = len(texts)
        if node.label == "#text":
            texts.append(node.text)
        inner = tuple(self.number(c, texts) for c in node.children)
        kind = (node.label, inner, len(texts) - before)
        if kind not in self.numbers:
            self.numbers[kind] = len(self.kinds)
            self.kinds.append(kind)
        return self.numbers[kind]

    def weights(self, s: int, t: int, a: np.ndarray, b: np.ndarray) -> np.ndarray | int:
        """_sizes() of all trees of kind s with the texts a (a row each) and of kind t with the texts b, by the same table."""
        (label, inner, _), (other, others, _) = self.kinds[s], self.kinds[t]
        if label != other:
            return 0
        if not inner or not others:
            return (a[:, :1] == b[:, 0]) + np.int32(1) if label == "#text" else 1
        starts = np.cumsum([0] + [self.kinds[v][2] for v in others])
        row, at = [0] * (len(others) + 1), 0
        for u in inner:
            now = [0]
            for j, v in enumerate(others):
                w = self.weights(u, v, a[:, at:], b[:, starts[j] :])
                now.append(np.maximum(np.maximum(row[j + 1], now[j]), row[j] + w))
            row, at = now, at + self.kinds[u][2]
        return row[-1] + 1


class Weights:
    """_sizes() of each of one list's trees with each of another's, by rows. Trees that differ only in texts that the other list hasn't
    are weighed once if there are few others, and of trees of like build all pairs together."""

    def __init__(self, x: list[Node], y: list[Node]) -> None:
        self.builds, self.held = Builds(), (0, 0, 0, 0)
        read = []
        for nodes in (x, y):
            texts: list[list[int]] = [[] for _ in nodes]
            read.append(([self.builds.number(n, held) for n, held in zip(nodes, texts)], texts))
        shared = {h: k for k, h in enumerate({h for held in read[0][1] for h in held} & {h for held in read[1][1] for h in held})}
        self.of, self.trees, self.keys = [], [], []
        for nodes, (kinds, texts), none in zip((x, y), read, (-1, -2)):
            first: dict[tuple, int] = {}
            keys = [(kind, *(shared.get(h, none) for h in held)) for kind, held in zip(kinds, texts)]
            self.of.append(np.array([first.setdefault(key, len(first)) for key in keys], np.int64))
            self.trees.append([nodes[i] for i in np.unique(self.of[-1], return_index=True)[1]])
            self.keys.append(list(first))
        # the most that a tree can weigh, and what the rest of a list can from each place on
        sizes: list[int] = []
        for _, inner, _ in self.builds.kinds:
            sizes.append(1 + sum(sizes[v] for v in inner))
        self.rest = []
        for k in (0, 1):
            labels = {self.builds.kinds[key[0]][0] for key in self.keys[1 - k]}
            most = np.array([(sizes[key[0]] + sum(h >= 0 for h in key[1:])) * (self.builds.kinds[key[0]][0] in labels) for key in self.keys[k]], np.int64)[self.of[k]]
            self.rest.append(np.append(np.cumsum(most[::-1])[::-1], 0))
        few = len(self.keys[0]) * len(self.keys[1]) <= CELLS
        if not few:
            self.keys[1], self.trees[1] = [self.keys[1][k] for k in self.of[1]], y
        like: dict[int, list[int]] = defaultdict(list)
        for k, key in enumerate(self.keys[1]):
            like[key[0]].append(k)
        self.like = {kind: (np.array(ks), np.array([self.keys[1][k][1:] for k in ks], np.int64).reshape(len(ks), -1)) for kind, ks in like.items()}
        self.all = self.between(np.arange(len(self.keys[0])), 0, len(self.keys[1])) if few else None

    def between(self, classes: np.ndarray, start: int, stop: int) -> np.ndarray:
        out = np.zeros((len(classes), stop - start), np.int32)
        rows: dict[int, list[int]] = defaultdict(list)
        for r, k in enumerate(classes):
            rows[self.keys[0][k][0]].append(r)
        for kind, rs in rows.items():
            texts = np.array([self.keys[0][classes[r]][1:] for r in rs], np.int64).reshape(len(rs), -1)
            for other, (ks, beside) in self.like.items():
                if self.builds.kinds[kind][0] != self.builds.kinds[other][0]:
                    continue
                lo, hi = np.searchsorted(ks, (start, stop))
                if len(rs) * (hi - lo) >= LIKE_PAIRS:
                    found = self.builds.weights(kind, other, texts, beside[lo:hi])
                    if hi - lo == stop - start:
                        out[rs] = found
                    else:
                        out[np.ix_(rs, ks[lo:hi] - start)] = found
                else:
                    for r in rs:
                        for k in ks[lo:hi]:
                            out[r, k - start] = _sizes(self.trees[0][classes[r]], self.trees[1][k], {})
        return out

    def row(self, i: int, start: int, stop: int, until: int) -> np.ndarray:
        """Row i at the places from start to stop; rows up to `until` are wanted next."""
        if self.all is not None:
            return self.all[self.of[0][i]].take(self.of[1][start:stop])
        a, b, c, d = self.held
        if not (a <= i < b and c <= start and stop <= d):
            n = max(1, min((CELLS >> 4) // max(1, stop - start), math.isqrt(CELLS >> 5)))
            a, b, c, d = self.held = i, min(until, i + n), start, min(len(self.of[1]), stop + 2 * n)
            classes, self.at = np.unique(self.of[0][a:b], return_inverse=True)
            self.found = self.between(classes, c, d)
        return self.found[self.at[i - a], start - c : stop - c]


def _in_order(x: list[Node], y: list[Node]) -> int:
    """What pairing the next two of one label in turn gives; of the longer list one is left out where labels differ."""
    i = j = total = 0
    while i < len(x) and j < len(y):
        w = _sizes(x[i], y[j], {})
        if w:
            total, i, j = total + w, i + 1, j + 1
        elif len(x) - i > len(y) - j:
            i += 1
        else:
            j += 1
    return total


def _long(x: list[Node], y: list[Node]) -> tuple[int, list[tuple[int, int]]]:
    """What the table of _sizes() gives for two lists, its total and pairs from the last on: row by row, and for the way back the rows
    between kept ones are made again, a few at a time.

    A row is held from the first place to the last that may lie on a best way: what a place has and the most that can follow reach what
    some matching gives. Any other place is worth less on every way, so the way back is the same as in the whole table.
    """
    weights = Weights(x, y)
    after_x, after_y = weights.rest
    least = max(_in_order(x, y), _in_order(x[::-1], y[::-1]))
    pairs: list[tuple[int, int]] = []
    total = 0

    def within(i: int, lo: int, row: np.ndarray) -> tuple[int, np.ndarray]:
        good = np.flatnonzero(row + np.minimum(after_x[i], after_y[lo : lo + len(row)]) >= least)
        return (lo + int(good[0]), row[good[0] : good[-1] + 1]) if len(good) else (lo, row)

    def rows(lo: int, top: np.ndarray, start: int, stop: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """Of the rows after `start`, where the first is, and the values up to the place `end`."""
        for i in range(start, stop):
            last = min(lo + len(top), end)
            now = np.empty(last - lo + 1, np.int32)
            now[: len(top)] = top[: len(now)]
            now[len(top) :] = top[-1]
            np.maximum(now[1:], top[: last - lo] + weights.row(i, lo, last, stop), out=now[1:])
            np.maximum.accumulate(now, out=now)
            # beyond, nothing is better than leaving out the other list's next
            need = least - int(now[-1])
            if last < end and after_x[i + 1] >= need:
                more = min(end, len(y) - int(np.searchsorted(after_y[::-1], need))) - last
                now = np.append(now, np.full(max(0, more), now[-1], np.int32))
            lo, top = within(i + 1, lo, now) if i % 16 == 0 else (lo, now)
            yield lo, top

    def back(lo: int, top: np.ndarray, start: int, stop: int, end: int) -> int:
        """From the place `end` of the row `stop` back to the row `start`, which is `top`; the place there."""
        nonlocal total
        parts = max(2, CELLS // (end - lo + 1))
        if stop - start > max(1, parts - 1):
            step = -(-(stop - start) // parts)
            marks = range(start, stop, step)
            kept = [(lo, top), *(row for i, row in enumerate(rows(lo, top, start, marks[-1], end), start + 1) if i in marks)]
            while kept:
                lo, top = kept.pop()
                end = back(lo, top[: max(1, end - lo + 1)], marks[len(kept)], min(stop, marks[len(kept)] + step), end)
            return end
        table = [(lo, top), *rows(lo, top, start, stop, end)]
        value = lambda i, j: table[i][1][j - table[i][0]] if table[i][0] <= j < table[i][0] + len(table[i][1]) else -1
        i, j = stop - start, end
        while i and j:
            if value(i, j) == value(i - 1, j):
                i -= 1
            elif value(i, j) == value(i, j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                total += int(value(i + 1, j + 1) - value(i, j))
                pairs.append((start + i, j))
        return j

    back(*within(0, 0, np.zeros(len(y) + 1, np.int32)), 0, len(x), len(y))
    return total, pairs


def _sizes(a: Node, b: Node, seen: dict) -> int:
    """Simple tree matching: the most nodes that an order-preserving, top-down matching of the two trees pairs, equal texts
    counting twice. Of several such matchings the one that the way back through the table meets first."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children:
        return 2 if a.label == "#text" and a.text == b.text else 1
    key = (id(a), id(b))
    if key in seen:
        return seen[key][0]
    front, back = _trimmed(a.children, b.children)
    x, y = a.children[front : len(a.children) - back], b.children[front : len(b.children) - back]
    pairs = [(k, k) for k in range(front)] + [(len(a.children) - 1 - k, len(b.children) - 1 - k) for k in range(back)]
    if len(x) * len(y) > MOST_PAIRS:
        total, found = _long(x, y)
        pairs += [(front + i, front + j) for i, j in found]
    else:
        row = [0] * (len(y) + 1)
        table = [row]
        for u in x:
            now = [0]
            for j, v in enumerate(y):
                w = _sizes(u, v, seen)
                now.append(max(row[j + 1], now[j], row[j] + w))
            table.append(now)
            row = now
        total, i, j = row[-1], len(x), len(y)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((front + i, front + j))
    seen[key] = (total + 2 * (front + back) + 1, pairs)
    return seen[key][0]


def matched(a: Node, b: Node) -> dict[int, Node]:
    """Nodes of a that the matching pairs with nodes of b, by identity of the nodes of b."""
    seen: dict = {}
    out, stack = {}, [(a, b)] if a.label == b.label else []
    while stack:
        a, b = stack.pop()
        out[id(b)] = a
        if a.children and b.children and _sizes(a, b, seen):
            stack += [(a.children[i], b.children[j]) for i, j in seen[id(a), id(b)][1]]
    return out


def pack(node: Node) -> str:
    """A tree as text: elements in brackets, texts as numbers."""
    if node.label == "#text":
        return f"{node.text} "
    return f"<{html.escape(node.label)}\t" + "".join(map(pack, node.children)) + ">"


PACKED = re.compile(r"<([^\t]*)\t|(\d+) |>")


def unpack(text: str) -> list[Node]:
    """The tree's nodes in the order of their starts, the root first."""
    open_, nodes = [Node("")], []
    for m in PACKED.finditer(text):
        if m[0] == ">":
            open_.pop()
            continue
        nodes.append(Node(html.unescape(m[1])) if m[1] is not None else Node("#text", text=int(m[2])))
        nodes[-1].up = open_[-1] if len(open_) > 1 else None
        open_[-1].children.append(nodes[-1])
        if m[1] is not None:
            open_.append(nodes[-1])
    return nodes


def placed(runs: list[Run], root: Node, pivot: list[Node]) -> list[tuple[int, int]]:
    """For each run the number of its node in the pivot, -1 if it has none, and that of the least container around it."""
    number = {id(n): i for i, n in enumerate(pivot)}
    partner = matched(pivot[0], root)
    out = []
    for r in runs:
        own = partner.get(id(r.node))
        around = r.node.up
        while around is not None and id(around) not in partner:
            around = around.up
        out.append((number[id(own)] if own is not None else -1, number[id(partner[id(around)])] if around is not None else 0))
    return out


def region(pivot: list[Node], chars: dict[int, int], share: float = REGION) -> set[int]:
    """Numbers of the pivot's nodes in the content region, given how much varying text stands at each node.

    From the root it goes down into the container that holds the share of all text, as long as there is one, and never
    into an article.
    """
    number = {id(n): i for i, n in enumerate(pivot)}
    below = [chars.get(i, 0) for i in range(len(pivot))]
    for i in range(len(pivot) - 1, 0, -1):  # children come after their parents
        below[number[id(pivot[i].up)]] += below[i]
    at = pivot[0]
    while at.label.split(".")[0] != "article":
        inner = [c for c in at.children if c.label.split(".")[0] in CONTAINERS and below[number[id(c)]] >= share * max(1, below[0])]
        if not inner:
            break
        at = inner[0]
    out, stack = set(), [at]
    while stack:
        n = stack.pop()
        out.add(number[id(n)])
        stack += n.children
    return out


def laid_out(root: Node, host: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{layout(root)}\n{host}") >> 1


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


BLOCKS = "array<struct<text:string,slot:int,around:int,kept:boolean,article:boolean>>"


def beside_pivots(rows: DataFrame, pivots: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Pages with the trees of their layouts' pivots, null where a layout has none. Pages of a layout with more than
    total / HOT_KEYS pages are dealt to parts of about so many, each of which gets the tree."""
    most = max(1, total // HOT_KEYS)
    hot = counts.where(F.col("k") > most).select("lay", F.ceil(F.col("k") / most).alias("parts"))
    # by id and text alike, so that a task that runs again deals alike
    part = F.pmod(F.xxhash64("page_id", "name"), F.coalesce("parts", F.lit(1)))
    dealt = rows.join(F.broadcast(hot), "lay", "left").withColumn("part", part).drop("parts")
    trees = pivots.select("lay", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("k") / most) - 1)).alias("part"))
    return dealt.join(trees, ["lay", "part"], "left").drop("part")


class Trees:
    """Unpacked trees by layout, as many as UNPACKED_BYTES allow."""

    def __init__(self) -> None:
        self.held: dict[int, list[Node]] = {}
        self.bytes = 0

    def get(self, lay: int, tree: str) -> list[Node]:
        if lay not in self.held:
            if self.bytes + len(tree) > UNPACKED_BYTES:
                self.held, self.bytes = {}, 0
            self.held[lay] = unpack(tree)
            self.bytes += len(tree)
        return self.held[lay]


def aligned(pages: DataFrame, least: int = LEAST_PAGES, most_bytes: int = PIVOTS_BYTES) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, name, lay, blocks) of all pages, and (lay, n, k, pivot) of the layouts with enough distinct pages."""

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in in_shards(batches, SHARD_BYTES, "html"):
            lays = [laid_out(parse(page or "")[1], host) for host, page in zip(shard.column("host").to_pylist(), shard.column("html").to_pylist())]
            yield from shard.drop_columns(["host"]).append_column("lay", pa.array(lays, pa.int64())).to_batches()

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [pack(parse(page)[1]) for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lay"), b.column("n"), b.column("k"), pa.array(trees, pa.string())], ["lay", "n", "k", "pivot"])

    known = pages.select("page_id", "url", "html", F.xxhash64("html").alias("name"))
    kind = known.schema["page_id"].dataType.simpleString()
    hosted = known.withColumn("host", host_of("url"))
    laid = hosted.mapInArrow(lay_out, f"page_id {kind}, url string, html string, name long, lay long")
    # pages aren't written again: the layouts' names are, and are found anew where pages are aligned
    bytes_ = F.octet_length("html")
    first = F.struct(F.when(bytes_ <= PIVOT_BYTES, 0).otherwise(bytes_).alias("over"), F.col("name").alias("name"))
    names = written(laid.select("lay", "name", F.when(bytes_ > 0, first).alias("first")), "layouts")
    layouts = names.groupBy("lay").agg(F.count_distinct("name").alias("n"), F.count("*").alias("k"), F.min("first")["name"].alias("name"))
    counts = written(layouts.where((F.col("n") >= least) & F.col("name").isNotNull()), "layout-counts")
    # few names go to the pages, which aren't shuffled for them
    chosen = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    pivots = known.where(bytes_ > 0).join(chosen, "name").groupBy("lay").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.min("html").alias("html"))
    pivots = written(pivots.select("lay", "n", "k", "html").mapInArrow(planted, "lay long, n long, k long, pivot string"), "pivots")

    size, total = pivots.agg(F.coalesce(F.sum(F.octet_length("pivot")), F.lit(0))).first()[0], names.count()
    sent = pages.sparkSession.sparkContext.broadcast({r["lay"]: r["pivot"] for r in pivots.select("lay", "pivot").collect()}) if size <= most_bytes else None

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees()
        kind = pa.list_(pa.struct([("text", pa.string()), ("slot", pa.int32()), ("around", pa.int32()), ("kept", pa.bool_()), ("article", pa.bool_())]))
        for b in (x for shard in in_shards(batches, SHARD_BYTES, "html") for x in shard.to_batches()):
            lays, out = [], []
            beside = b.column("host" if sent else "pivot").to_pylist()
            known_lays = [None] * b.num_rows if sent else b.column("lay").to_pylist()
            for page, other, lay in zip(b.column("html").to_pylist(), beside, known_lays):
                runs, root = parse(page or "")
                lay = laid_out(root, other) if sent else lay
                tree = sent.value.get(lay) if sent else other
                places = placed(runs, root, trees.get(lay, tree)) if tree else [(-1, 0)] * len(runs)
                lays.append(lay)
                out.append([{"text": r.text, "slot": s, "around": c, "kept": not r.dropped, "article": r.article} for r, (s, c) in zip(runs, places)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "url", "name")), pa.array(lays, pa.int64()), pa.array(out, kind)], ["page_id", "url", "name", "lay", "blocks"])

    # few trees go to where the pages are, which are read again and never shuffled; of many each goes to its layout's pages
    rows = hosted if sent else beside_pivots(laid, pivots, layouts, total)
    return written(rows.mapInArrow(align, f"page_id {kind}, url string, name long, lay long, blocks {BLOCKS}"), "blocks"), pivots


def templates(blocks: DataFrame, pivots: DataFrame, agree: float = AGREE) -> DataFrame:
    """(lay, k, region, constant): a layout's content region, as nodes of its pivot, and its constant texts as slot:hash."""
    texts = blocks.select("lay", "name", F.explode("blocks").alias("b")).select("lay", "name", "b.slot", F.xxhash64("b.text").alias("hash"), "b.around", F.length("b.text").alias("chars"))
    # copies of a page count once
    told = texts.where("slot >= 0").select("lay", "name", "slot", "hash").distinct().groupBy("lay", "slot", "hash").count()
    constant = written(joined(told, pivots.select("lay", "n", "k"), "lay", told.count()).where(F.col("count") >= agree * F.col("n")).select("lay", "slot", "hash"), "constants")
    varying = texts.join(constant, ["lay", "slot", "hash"], "left_anti").groupBy("lay", "around").agg(F.sum("chars").alias("chars"))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"lay": pa.array([], pa.int64()), "region": pa.array([], pa.list_(pa.int32()))})
        found = region(unpack(left.column("pivot")[0].as_py()), dict(zip(right.column("around").to_pylist(), right.column("chars").to_pylist())))
        return pa.table({"lay": left.column("lay").slice(0, 1), "region": pa.array([sorted(found)], pa.list_(pa.int32()))})

    regions = pivots.select("lay", "pivot").groupBy("lay").cogroup(varying.groupBy("lay")).applyInArrow(judge, "lay long, region array<int>")
    constants = constant.groupBy("lay").agg(F.collect_list(F.concat_ws(":", "slot", "hash")).alias("constant"))
    return written(pivots.select("lay", "k").join(regions, "lay").join(constants, "lay", "left"), "templates")


def extract(pages: DataFrame, *, least: int = LEAST_PAGES, agree: float = AGREE, most_bytes: int = PIVOTS_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_template), one row per row of pages.

    n_blocks counts the page's blocks of text, n_template those that the template alone takes out: constant texts and what
    lies outside the content region. A null or empty page, or one without main text, gives the empty string. A null url or
    one without a host belongs to the host "". Layouts with fewer than `least` distinct pages have no template, and nothing
    of theirs is held to be one; repeated pages count once in finding it. Pivots' trees of at most `most_bytes` in all are
    broadcast, more are joined to the pages. Texts are whole. No rows give no rows; other
    columns are not read.
    """
    blocks, pivots = aligned(pages, least, most_bytes)
    found = templates(blocks, pivots, agree)
    both = joined(blocks, found, "lay", blocks.count()).drop("k")
    alone = blocks.join(pivots.select("lay"), "lay", "left_anti").withColumn("region", F.lit(None).cast("array<int>")).withColumn("constant", F.lit(None).cast("array<string>"))
    rows = both.unionByName(alone)
    told = F.expr("transform(blocks, b -> struct(b.text as text, b.kept as kept, b.article as article, region is not null and (not array_contains(region, b.around) or coalesce(array_contains(constant, concat_ws(':', b.slot, xxhash64(b.text))), false)) as template))")
    rows = rows.withColumn("told", told).withColumn("kept", F.expr("filter(told, b -> b.kept and not b.template)"))
    # an article that the region leaves out is the page's own word about its text
    rows = rows.withColumn("kept", F.expr("case when exists(kept, b -> b.article) then filter(kept, b -> b.article) when exists(told, b -> b.kept and b.article) then filter(told, b -> b.kept and b.article) else kept end"))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size("told").cast("long").alias("n_blocks"), F.size(F.filter("told", lambda b: b["template"])).cast("long").alias("n_template"))
