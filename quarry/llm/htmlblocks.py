"""Leaf blocks of a web page: runs of text between block boundaries, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Element names of HTML by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template iframe title".split())                # no text; without an end tag they run to the page's end
SKIPPED = set("svg annotation annotation-xml".split())                  # drawings, and formulas written out a second time
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select
summary table tbody td textarea tfoot th thead tr ul""".split())
P_STAYS = set("button option optgroup select textarea legend caption tbody thead tfoot tr td th body head html noscript".split())
P_SCOPE = set("table td th caption button html body template".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

MARK = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[^\s/>]+")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(r"[a-z]+")


RULES = [({"p"}, P_SCOPE), *SIBLINGS.values()]
P_RULE, SIBLING_RULE = 0, {tag: 1 + i for i, tag in enumerate(SIBLINGS)}


class Node:
    """An open element: its own features, and what holds for all that stands inside it, from its parent's."""

    __slots__ = ("tag", "own", "parent", "near", "block", "article", "header", "scopes")

    def __init__(self, tag: str, own: list[str], parent: Node | None):
        self.tag, self.own, self.parent = tag, own, parent
        self.near = ((parent.near if parent else ()) + tuple(own))[-4:]  # the last features of the path
        self.block = tag if tag in BLOCK else parent.block if parent else ""
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.header = parent.header if parent else None  # whether the outermost header stands in the article
        if tag == "header" and self.header is None:
            self.header = bool(parent and parent.article)
        self.scopes = parent.scopes if parent else 0  # bit r: an element that rule r may close is open in scope
        for r, (names, until) in enumerate(RULES):
            if tag in names:
                self.scopes |= 1 << r
            elif tag in until:
                self.scopes &= ~(1 << r)


@dataclass
class Block:
    text: str
    linked: int                      # characters inside links
    node: Node | None                # the element around it
    tag: str = ""                    # the nearest block element

    @property
    def path(self) -> list[str]:
        """Features of the ancestors, outermost first."""
        out, node = [], self.node
        while node:
            out.append(node.own)
            node = node.parent
        return [f for own in reversed(out) for f in own]


def attribute_features(attributes: str) -> list[str]:
    out = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and "none" in value:
            out.append("a:hidden")
        elif name in ("class", "id", "role", "itemprop"):
            out += [f"c:{t}" for t in TOKEN.findall(CAMEL.sub(" ", value).lower())]
    return out


class _Builder:
    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[Node] = []
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.linked = 0

    @property
    def top(self) -> Node | None:
        return self.stack[-1] if self.stack else None

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.linked, self.top, self.top.block if self.stack else ""))
            self.parts, self.linked = [], 0

    def pop_to(self, names: set[str]) -> None:
        while self.stack:
            name = self.stack.pop().tag
            self.open[name] -= 1
            if name in names:
                return

    def in_scope(self, rule: int) -> bool:
        return bool(self.stack and self.top.scopes >> rule & 1)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            if tag in SIBLINGS:
                while self.in_scope(rule := SIBLING_RULE[tag]):
                    self.pop_to(RULES[rule][0])
            elif tag not in P_STAYS and self.in_scope(P_RULE):
                self.pop_to(RULES[P_RULE][0])
        if tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            self.stack.append(Node(tag, [f"t:{tag}", *(attribute_features(attributes) if attributes else [])], self.top))
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.open[tag] > 0:
            self.pop_to({tag})

    def add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.open["a"] > 0:
            self.linked += len(text)


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order.  Comments, RAW and SKIPPED elements are no text, but a SKIPPED element without an
    end tag hides nothing; white space in a block becomes single spaces; any input is read to its end, in time that grows with
    its length."""
    page = page or ""
    b, at, n = _Builder(), 0, len(page)
    ends: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()  # SKIPPED elements of which no end tag follows any more
    while at < n:
        m = MARK.search(page, at)
        if not m:
            b.add(page[at:])
            break
        if m.start() > at:
            b.add(page[at:m.start()])
        mark, at = m.group(), m.end()
        if mark == "<!--":
            stop = page.find("-->", at)
            at = n if stop < 0 else stop + 3
            continue
        if mark in ("<!", "<?"):
            stop = page.find(">", at)
            at = n if stop < 0 else stop + 1
            continue
        name = NAME.match(page, at - 1)
        rest = REST.match(page, name.end())
        stop = rest.end() if rest else page.find(">", name.end()) + 1 or n
        tag, inside = name.group().lower(), page[name.end():stop - 1]
        at = stop
        if mark[1] == "/":
            b.end(tag)
        elif tag in RAW or tag in SKIPPED:
            if not inside.endswith("/") and tag not in unclosed:
                if tag not in ends:
                    ends[tag] = re.compile(f"</{tag}[\\s/>]", re.I)
                close = ends[tag].search(page, at)
                if close:
                    at = close.start()
                elif tag in RAW:
                    at = n
                else:
                    unclosed.add(tag)
        else:
            b.start(tag, inside)
    b.flush()
    return b.blocks
