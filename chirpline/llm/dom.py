"""A tolerant reader of HTML blocks, and features of its nodes.

Nodes are block elements and runs of text between block borders (``#text``). Inline elements only
count towards their block's links. Unclosed and misnested tags, missing ends and broken references
are read as browsers show them, as far as blocks go.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np

# fixed values: element kinds
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article main section nav aside header footer "
    "form fieldset blockquote pre figure figcaption address details summary dialog menu center hgroup search button select option label hr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style textarea title noscript iframe template svg".split())
PARAGRAPH_ENDS = BLOCKS - {"button", "select", "option", "label"}
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer aside form header menu dialog button select option label fieldset address search".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td figcaption".split())
SAME_END = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*)>?""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label|data-mark)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_STOPS = re.compile(r"[.,;:!?。，]")

FEATURES = (
    "good_tag bad_tag prose_tag above_bad_tags above_good_tags words_against words_for above_against above_for log_chars link_share density "
    "depth siblings place parent_share stops words_per_run log_sibling_chars before prose_share page_share bad_share heading item text_run"
).split()


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "mark", "kids", "parts", "linked")

    def __init__(self, tag, parent, depth, words=(), mark=None):
        self.tag, self.parent, self.depth, self.words, self.mark = tag, parent, depth, words, mark
        self.kids, self.parts, self.linked = [], None, 0


def attribute_words(raw: str) -> tuple[list[str], str | None]:
    words, mark = [], None
    for name, value in _ATTR.findall(raw):
        value = value.strip("\"'")
        if name.lower() == "data-mark":
            mark = value
        else:
            words += [w.lower() for w in _PART.findall(html.unescape(value))]
    return words, mark


class _Stack:
    """The open elements, with the places of each tag, so that no search walks the stack.

    An inline element that ends out of turn leaves an empty place behind. Every place is pushed and
    popped once, so reading is linear in the page.
    """

    def __init__(self):
        self.tags: list = ["#root"]
        self.blocks = [(0, 0)]  # place and node of the open blocks
        self.at: dict[str, list[int]] = {}
        self.links = 0

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if node >= 0:
            self.blocks.append((len(self.tags), node))
        self.tags.append(tag)
        self.links += tag == "a"

    def place(self, *tags: str) -> int:
        """The highest place of any of the tags; 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)

    def pop_to(self, place: int) -> bool:
        """Close the element at a place and all above it; was a block among them?"""
        for tag in reversed(self.tags[place:]):
            if tag is not None:
                self.at[tag].pop()
                self.links -= tag == "a"
        del self.tags[place:]
        closed = False
        while self.blocks[-1][0] >= place:
            self.blocks.pop()
            closed = True
        return closed

    def drop(self, place: int) -> None:
        """Close an inline element alone."""
        tag, self.tags[place] = self.tags[place], None
        self.at[tag].pop()
        self.links -= tag == "a"
        while self.tags[-1] is None:
            self.tags.pop()

    def top(self) -> str:
        return self.tags[-1]


def read(page: str) -> list[Node]:
    """The nodes of a page in page order; the first is the root. Time is linear in the page."""
    nodes, stack = [Node("#root", -1, 0)], _Stack()
    run, at, end = None, 0, len(page)

    def text(s):
        nonlocal run
        if not s or (run is None and s.isspace()):
            return
        if run is None:
            block = stack.blocks[-1][1]
            run = Node("#text", block, nodes[block].depth + 1)
            run.parts = []
            nodes[block].kids.append(len(nodes))
            nodes.append(run)
        run.parts.append(s)
        if stack.links:
            run.linked += len(s)

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(html.unescape(page[at:]))
            break
        if m.start() > at:
            text(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                run = None
            if place := stack.place(tag):
                if tag in BLOCKS:
                    stack.pop_to(place)
                else:
                    stack.drop(place)
            continue
        if tag == "br":
            text(" ") if run is not None else None
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCKS:
            run = None
            if tag in PARAGRAPH_ENDS and stack.tags[stack.blocks[-1][0]] == "p":
                stack.pop_to(stack.blocks[-1][0])
            while tag in SAME_END and (place := stack.place(*SAME.get(tag, (tag,)))) > stack.place(*SAME_END[tag]):
                stack.pop_to(place)
                if tag != "tr" or stack.top() != "tr":
                    break
            if tag == "hr":
                continue
            words, mark = attribute_words(m[3]) if m[3] else ((), None)
            block = stack.blocks[-1][1]
            nodes[block].kids.append(len(nodes))
            nodes.append(Node(tag, block, nodes[block].depth + 1, words, mark))
            stack.push(tag, len(nodes) - 1)
        elif not m[3].rstrip().endswith("/"):
            stack.push(tag, -1)
    return nodes


def block_text(node: Node) -> str:
    return " ".join("".join(node.parts).split())


def features(nodes: list[Node], weights: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for each node. ``weights``: log-odds of attribute words, as learnt."""
    n = len(nodes)
    chars, linked, stops, words, runs, prose, bad, elements = ([0] * n for _ in range(8))
    before = [0] * n
    seen = 0
    for i, v in enumerate(nodes):
        before[i] = seen
        if v.parts is not None:
            s = "".join(v.parts)
            chars[i] = len(s)
            linked[i] = v.linked
            stops[i] = len(_STOPS.findall(s))
            words[i] = s.count(" ") + 1
            runs[i] = 1
            prose[i] = len(s) if nodes[v.parent].tag in PROSE_TAGS else 0
            seen += len(s)
    odds = [[weights.get(w, 0.0) for w in v.words] for v in nodes]
    against = [-sum(x for x in o if x < 0) for o in odds]
    support = [sum(x for x in o if x > 0) for o in odds]
    for i in range(n - 1, 0, -1):
        v, p = nodes[i], nodes[i].parent
        if against[i] > 1 or v.tag in BAD_TAGS:
            bad[i] = chars[i]
        for x in (chars, linked, stops, words, runs, prose, bad):
            x[p] += x[i]
        elements[p] += elements[i] + (v.parts is None)
    out = np.zeros((n, len(FEATURES)), np.float32)
    above = [(0, 0, 0, 0)] * n
    total = max(1, chars[0])
    place = [0.0] * n
    for v in nodes:
        for k, c in enumerate(v.kids):
            place[c] = k / len(v.kids)
    log1p = math.log1p
    for i, v in enumerate(nodes):
        t = v.tag
        a = above[v.parent] if i else (0, 0, 0, 0)
        above[i] = a = (a[0] + (t in BAD_TAGS), a[1] + (t in GOOD_TAGS), a[2] + against[i], a[3] + support[i])
        p = nodes[v.parent] if i else v
        c = max(1, chars[i])
        out[i] = (
            t in GOOD_TAGS, t in BAD_TAGS, t in PROSE_TAGS, a[0], a[1], against[i], support[i], a[2], a[3], log1p(chars[i]), linked[i] / c, log1p(chars[i] / (elements[i] + 1)),
            v.depth, len(p.kids), place[i], chars[i] / max(1, chars[v.parent if i else 0]), stops[i] / c, words[i] / max(1, runs[i]),
            log1p(chars[v.parent if i else 0] / max(1, len(p.kids))), before[i] / total, prose[i] / c, chars[i] / total, bad[i] / c, t[0] == "h" and len(t) == 2, t == "li", v.parts is not None,
        )
    return out


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """Which nodes stay: the best labelling in which nothing below a dropped node stays."""
    n = len(nodes)
    drop, keep = [0.0] * n, logits.tolist()
    for i in range(n - 1, -1, -1):
        drop[i] -= float(logits[i])
        if i:
            p = nodes[i].parent
            drop[p] += drop[i]
            keep[p] += max(keep[i], drop[i])
    stay = [True] * n
    for i in range(1, n):
        stay[i] = stay[nodes[i].parent] and keep[i] > drop[i]
    return stay


def main_text(nodes: list[Node], stay: list[bool]) -> str:
    blocks = (block_text(v) for v, s in zip(nodes, stay) if s and v.parts is not None)
    return "\n".join(b for b in blocks if b)
