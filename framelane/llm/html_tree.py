"""Block trees of HTML pages, and their alignment by simple tree matching."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np

#: Elements that start and end a block of text; all others are inside one.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre "
    "section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is text up to their own end tag.
RAW = frozenset("script style textarea title xmp noframes".split())
#: A start tag ends these open elements, looked for up to the nearest of the second set.
_P_ENDERS = BLOCKS - frozenset("body button caption dd dt head html iframe legend li noscript object optgroup option select svg tbody td template tfoot th thead title tr video audio canvas".split())
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dd": (frozenset("dd dt".split()), frozenset(["dl"])), "dt": (frozenset("dd dt".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select optgroup".split())), "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])), "thead": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
}
_SCOPE = frozenset("html body table td th caption button object template article section div main aside nav header footer form li dd dt blockquote".split())

NEVER = frozenset("head script style noscript template iframe svg canvas button select textarea object embed nav footer aside form dialog menu option audio video title fieldset".split())
#: Outside the article only.
OUTER = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager "
    "pagination paywall popup promo promotion recommended related replies reply respond rail search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe taboola tagcloud toolbar topbar widget widgets".split()
)
OUTER_NAMES = frozenset("header masthead".split())
#: Words that may stand next to such a name in one class or id without changing what it says.
PLAIN = frozenset(
    "area bar block bottom box col column container div first global group inner item items last left link links list main menu page panel post posts "
    "primary region right row secondary section site small the top unit wrap wrapper zone".split()
)
#: Elements that are left out like names: unless they wrap the article or most of the text.
WRAPPERS = frozenset("form fieldset".split())
_OPENER = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[/!?])")
_MARKS = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    name: str
    parent: int
    #: left out whatever is in it; left out by name, form or fieldset; the same outside the article
    bad: bool = False
    named: bool = False
    outer: bool = False
    outer_named: bool = False
    children: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    #: (node, text, characters of it inside links) in page order
    segments: list[tuple[int, str, int]]


def says(token: str, names: frozenset[str]) -> bool:
    """Whether a class or id as a whole is one of the names, alone or among PLAIN words and numbers."""
    parts = {p.lower() for p in _PART.findall(token)}
    return token.lower() in names or not parts.isdisjoint(names) and all(p in names or p in PLAIN or p.isdigit() for p in parts)


def _judge(tag: str, raw: str) -> tuple[str, bool, bool, bool, bool]:
    """Class names of a start tag; whether it is left out, or only by name; the same outside the article."""
    bad, outer, names = tag in NEVER and tag not in WRAPPERS, tag in OUTER, ""
    named, outer_named = tag in WRAPPERS, False
    if raw and ("=" in raw or "hidden" in raw):
        tokens: set[str] = set()
        for m in _ATTR.finditer(raw):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                tokens.update(value.split())
                if key == "class":
                    names = " ".join(sorted(value.lower().split()))
            elif key == "role":
                bad |= value.strip().lower() in ROLES
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                bad = True
            elif key == "style":
                bad |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE) is not None
        if tag not in ("body", "html"):
            named |= any(says(t, NAMES) for t in tokens)
            outer_named |= any(says(t, OUTER_NAMES) for t in tokens)
    return names, bad, named, outer, outer_named


class Tags:
    """Ends of tags, in time linear in the page whatever its quotes are.

    A tag ends at the first > outside quotes; if its quotes never close, at the first > of all.
    Where quotes before the first > are not plainly in pairs, every mark (>, " and ') is listed
    once, and a walk over quotes that ends without a tag leaves behind which marks lead
    nowhere, so no walk passes them again.
    """

    def __init__(self, source: str):
        self.source = source
        self.marks: list[int] | None = None

    def end(self, at: int) -> int:
        """Place of the > that ends the tag with attributes from ``at`` on, or -1."""
        stop = self.source.find(">", at)
        if stop < 0 or stop == at:
            return stop
        double, single = self.source.count('"', at, stop), self.source.count("'", at, stop)
        if not double and not single or not single and double % 2 == 0 or not double and single % 2 == 0:
            return stop
        return self._walk(at, stop)

    def _list(self) -> None:
        source = self.source
        self.marks = [m.start() for m in _MARKS.finditer(source)]
        self.after: dict[str, list[int]] = {}  # per mark, the next one of its kind
        for kind in "\"'":
            nearest, out = -1, [-1] * len(self.marks)
            for i in range(len(self.marks) - 1, -1, -1):
                out[i] = nearest
                if source[self.marks[i]] == kind:
                    nearest = i
            self.after[kind] = out
        self.dead: set[int] = set()

    def _walk(self, at: int, stop: int) -> int:
        if self.marks is None:
            self._list()
        i = bisect_left(self.marks, at)
        walked = []
        while i < len(self.marks) and i not in self.dead:
            walked.append(i)
            mark = self.source[self.marks[i]]
            if mark == ">":
                return self.marks[i]
            closer = self.after[mark][i]
            if closer < 0:
                break
            i = closer + 1
        self.dead.update(walked)
        return stop


def parse(source: str) -> Page:
    """Blocks of a page. Markup that is cut off or unbalanced ends where the standard would end it, about."""
    nodes, segments = [Node("#page", "", -1)], []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements, with the block that they are or are in
    still_open: dict[str, int] = {}
    buffer: list[str] = []
    linked, at, n = 0, 0, len(source)
    tag_end = Tags(source).end

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                block = stack[-1][1]
                segments.append((block, text, min(linked, len(text))))
                nodes[block].text.append(text)
            buffer.clear()
        linked = 0

    def close(k: int) -> None:
        for i in range(len(stack) - 1, k - 1, -1):
            if stack[i][1] != stack[i - 1][1]:  # it has a node of its own
                flush()
                break
        for tag, _ in stack[k:]:
            still_open[tag] -= 1
        del stack[k:]

    while at < n:
        m = _OPENER.search(source, at)
        cut = n if m is None else m.start()
        if cut > at:
            text = source[at:cut]
            if "&" in text:
                text = html.unescape(text)
            buffer.append(text)
            if still_open.get("a"):
                linked += len(text.strip())
        if m is None:
            break
        tag = m[2]
        if tag is None:  # a comment, a doctype, or bogus
            if source.startswith("<!--", cut):
                if source.startswith((">", "->"), cut + 4):
                    at = source.find(">", cut) + 1
                    continue
                stop = source.find("-->", cut + 4)
                at = n if stop < 0 else stop + 3
                continue
            stop = source.find(">", cut)
            at = n if stop < 0 else stop + 1
            continue
        name_end = m.end()
        stop = tag_end(name_end)
        if stop < 0:  # a tag that never ends hides the rest
            break
        at, tag = stop + 1, tag.lower()
        if m[1]:
            if stack[-1][0] == tag and len(stack) > 1:
                close(len(stack) - 1)
            elif still_open.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag == "p" and stack[k][0] in _SCOPE:
                        break
            continue
        if tag == "br":
            buffer.append("\n")
            continue
        if tag in _P_ENDERS and still_open.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in _SCOPE:
                    break
        if tag in _CLOSES and any(still_open.get(t) for t in _CLOSES[tag][0]):
            ends, scope = _CLOSES[tag]
            found = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in scope:
                    break
                if stack[k][0] in ends:
                    found = k
            if found:
                close(found)
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        attributes = source[name_end:stop]
        names, *judged = _judge(tag, attributes)
        if tag in BLOCKS or judged[0] or judged[1]:
            flush()
            parent = stack[-1][1]
            nodes[parent].children.append(len(nodes))
            nodes.append(Node(tag, names, parent, *judged))
            stack.append((tag, len(nodes) - 1))
            still_open[tag] = still_open.get(tag, 0) + 1
        elif not attributes.endswith("/") or tag in ("a", "b", "i", "span", "em", "strong"):
            stack.append((tag, stack[-1][1]))
            still_open[tag] = still_open.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(source, at)
            body_end = end.start() if end else n
            if tag not in ("script", "style"):
                buffer.append(html.unescape(source[at:body_end]))
            at = body_end
    flush()
    return Page(nodes, segments)


class Shapes:
    """Numbers for tree shapes (labels and children), and how well two shapes match."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[np.ndarray] = []
        self.size: list[int] = []
        self.memory: dict[tuple[int, int], int] = {}

    def of(self, page: Page) -> list[int]:
        out = [0] * len(page.nodes)
        for k in range(len(page.nodes) - 1, -1, -1):  # children come after their parents
            node = page.nodes[k]
            kids = tuple(out[c] for c in node.children)
            key = (node.tag, node.name, kids)
            shape = self.number.get(key)
            if shape is None:
                shape = self.number[key] = len(self.label)
                self.label.append(f"{node.tag} {node.name}")
                self.kids.append(np.array(kids, np.int64))
                self.size.append(1 + sum(self.size[c] for c in kids))
            out[k] = shape
        return out

    def known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.size[a]
        if self.label[a] != self.label[b]:
            return 0
        return self.memory.get((a, b))

    def match(self, a: int, b: int) -> int:
        """Simple tree matching: pairs of nodes that two trees have in common, in order, under equal labels."""
        found = self.known(a, b)
        return self._solve(self._match(a, b)) if found is None else found

    def table(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Best totals of aligning the first i of x with the first j of y, without crossing."""
        return self._solve(self._table(x, y))

    def last_row(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Last row of the table, in memory linear in y."""
        return self._solve(self._last_row(x, y))

    def _solve(self, whole: Generator):
        """Run a step that asks for matches of smaller trees; these wait on a stack of their own, so depth has no limit."""
        waiting, value = [whole], None
        while waiting:
            try:
                a, b = waiting[-1].send(value)
            except StopIteration as done:
                waiting.pop()
                value = done.value
            else:
                waiting.append(self._match(a, b))
                value = None
        return value

    def _match(self, a: int, b: int) -> Generator:
        x, y = self.kids[a], self.kids[b]
        small = len(x) * len(y) <= PIECE * PIECE
        best = (yield from self._table(x, y))[-1, -1] if small else (yield from self._last_row(x, y))[-1]
        got = self.memory[a, b] = 1 + int(best)
        return got

    def _row(self, p: int, ys: list[int]) -> Generator:
        row = np.empty(len(ys), np.int64)
        for k, q in enumerate(ys):
            found = self.known(p, q)
            row[k] = (yield p, q) if found is None else found
        return row

    def _table(self, x: np.ndarray, y: np.ndarray) -> Generator:
        if len(x) * len(y) <= FEW:
            return (yield from self._small_table(x.tolist(), y.tolist()))
        ux, ix = np.unique(x, return_inverse=True)
        uy, iy = np.unique(y, return_inverse=True)
        weight = np.zeros((len(ux), len(uy)), np.int64)
        for k, p in enumerate(ux.tolist()):
            weight[k] = yield from self._row(p, uy.tolist())
        out = np.zeros((len(x) + 1, len(y) + 1), np.int64)
        for i in range(len(x)):
            out[i + 1, 1:] = np.maximum.accumulate(np.maximum(out[i, 1:], out[i, :-1] + weight[ix[i], iy]))
        return out

    def _small_table(self, x: list[int], y: list[int]) -> Generator:
        rows, above = [[0] * (len(y) + 1)], [0] * (len(y) + 1)
        for p in x:
            row = [0]
            for j, q in enumerate(y):
                found = self.known(p, q)
                if found is None:
                    found = yield p, q
                row.append(max(above[j + 1], row[j], above[j] + found))
            rows.append(row)
            above = row
        return np.array(rows)

    def _last_row(self, x: np.ndarray, y: np.ndarray) -> Generator:
        uy, iy = np.unique(y, return_inverse=True)
        rows: dict[int, np.ndarray] = {}
        out = np.zeros(len(y) + 1, np.int64)
        for p in x.tolist():
            row = rows.get(p)
            if row is None:
                if len(rows) * len(uy) > PIECE * PIECE:
                    rows.clear()
                if len(self.memory) > MEMORY:
                    self.memory.clear()
                row = rows[p] = yield from self._row(p, uy.tolist())
            out[1:] = np.maximum.accumulate(np.maximum(out[1:], out[:-1] + row[iy]))
        return out


#: Lists of children are aligned by one table up to this length (squared, in cells), longer ones are halved first.
PIECE = 1500
#: Tables of at most so many cells are filled cell by cell.
FEW = 256
#: Matches of two shapes that are remembered while long lists are aligned.
MEMORY = 1 << 21


def align(a: Page, b: Page, shapes: Shapes, a_shapes: list[int], b_shapes: list[int]) -> list[tuple[int, int]]:
    """Pairs (node of a, node of b) of a best simple tree matching.

    Equal shapes at both ends of two lists of children are matched first, which never
    loses a pair. What is left is aligned by the table; where that would be large, one list
    is halved and the best place to cut the other is found in linear memory (Hirschberg).
    The time is the product of the lengths that differ.
    """
    pairs, todo = [(0, 0)], [(0, 0)]
    while todo:
        p, q = todo.pop()
        x, y = a.nodes[p].children, b.nodes[q].children
        lo = 0
        while lo < min(len(x), len(y)) and a_shapes[x[lo]] == b_shapes[y[lo]]:
            lo += 1
        hi = 0
        while hi < min(len(x), len(y)) - lo and a_shapes[x[-1 - hi]] == b_shapes[y[-1 - hi]]:
            hi += 1
        found = list(zip(x[:lo], y[:lo])) + (list(zip(x[-hi:], y[-hi:])) if hi else [])
        x, y = x[lo: len(x) - hi], y[lo: len(y) - hi]
        sx, sy = np.array([a_shapes[c] for c in x], np.int64), np.array([b_shapes[c] for c in y], np.int64)
        parts = [(0, len(x), 0, len(y))]
        while parts:
            i0, i, j0, j = parts.pop()
            if i == i0 or j == j0:
                continue
            if (i - i0) * (j - j0) > PIECE * PIECE and i - i0 > 1:
                mid = (i0 + i) // 2
                before = shapes.last_row(sx[i0:mid], sy[j0:j])
                after = shapes.last_row(sx[mid:i][::-1], sy[j0:j][::-1])[::-1]
                cut = j0 + int(np.argmax(before + after))
                parts += [(i0, mid, j0, cut), (mid, i, cut, j)]
                continue
            t = shapes.table(sx[i0:i], sy[j0:j])
            while i > i0 and j > j0:
                if t[i - i0, j - j0] == t[i - i0 - 1, j - j0]:
                    i -= 1
                elif t[i - i0, j - j0] == t[i - i0, j - j0 - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((x[i], y[j]))
        pairs += found
        todo += found
    return pairs
