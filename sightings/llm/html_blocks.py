"""Pages cut into leaf blocks: runs of text between block tags, each with what its ancestors and its text tell.

The reader takes tag soup in one pass, in time that grows with the page's length: tags left open are closed by what
follows them, end tags of nothing open are passed over, and a page may end anywhere.  An element's features are
its tag and the words of its class, id and role; an element hands them on to all blocks below it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log2

# Elements of HTML whose tags end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
# Elements without content, and elements whose content is no text of the page.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript script style svg template textarea title".split())
# Which open elements a start tag ends, and at which elements the search for them stops.
_BLOCKS_END_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre search section summary table ul".split()
)
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
# Elements that hold parts of a page; the nearest of them is a feature of its own.
PARTS = frozenset("article aside body dialog div fieldset footer form header main menu nav section table td".split())
# The attribute by which labelled pages mark the elements of their main text (1) and others inside them (0).
LABEL = "data-main"

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attributes>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>"""
    r"""|</?(?P<torn>[A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for name in RAW_TAGS}


@dataclass
class Block:
    """A leaf block: its text, with white space as single spaces, its features, and its label in a labelled page."""

    text: str
    features: list[str]
    label: int | None = None


@dataclass
class _Element:
    name: str
    handed_on: frozenset[str]  # features of the element and its ancestors
    part: frozenset[str]  # features of the nearest part of the page
    label: int | None


@dataclass
class _Run:
    """The text gathered since the last block tag."""

    texts: list[str] = field(default_factory=list)
    linked: int = 0


def attributes(text: str) -> dict[str, str]:
    """Names in lower case with their values, the first of a repeated name."""
    out: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(text):
        value = match[2] or ""
        if value[:1] in "\"'":
            value = value[1:-1]
        out.setdefault(match[1].lower(), unescape(value))
    return out


def _names(values: dict[str, str]) -> set[str]:
    """Features of an element's class, id and role: their words and how longer words begin."""
    out = set()
    for key in ("class", "id", "role", "aria-label"):
        for word in _WORD.findall(values.get(key, "")):
            word = word.lower()
            out.add(f"name {word}")
            if len(word) > 5:
                out.add(f"begin {word[:5]}")
    if "hidden" in values or re.search(r"display\s*:\s*none", values.get("style", "")) or values.get("aria-hidden") == "true":
        out.add("hidden")
    return out


def _size(n: int) -> int:
    return min(8, int(log2(n))) if n > 0 else -1


def text_features(text: str, linked: int) -> list[str]:
    """What a block's own text tells; ``linked`` is how many of its characters are in links."""
    n_words = text.count(" ") + 1
    share = linked / len(text)
    out = [f"words {_size(n_words)}", f"linked {0 if share == 0 else 1 if share < 0.34 else 2 if share < 0.8 else 3}"]
    if text[-1] in ".!?…。:;":
        out.append("stop")
    if n_words > 1 and ", " in text:
        out.append("comma")
    if "©" in text or "|" in text or "»" in text or "→" in text:
        out.append("sign")
    if sum(c.isdigit() for c in text[:200]) * 4 > len(text[:200]):
        out.append("digits")
    return out


def leaf_blocks(html: str) -> Iterator[Block]:
    """The page's leaf blocks with text, in order."""
    root = _Element("", frozenset(["any"]), frozenset(), None)
    stack, opened, run = [root], Counter(), _Run()
    at = 0

    def text(begin: int, end: int) -> None:
        if end > begin:
            piece = unescape(html[begin:end])
            run.texts.append(piece)
            if opened["a"]:
                run.linked += sum(map(len, piece.split()))

    def block() -> Iterator[Block]:
        if run.texts:
            joined = " ".join("".join(run.texts).split())
            linked = run.linked
            run.texts, run.linked = [], 0
            if joined:
                own = stack[-1]
                leaf = next((e.name for e in reversed(stack[-4:]) if e.name in BLOCK_TAGS), "")
                yield Block(joined, [*own.handed_on, *own.part, f"leaf {leaf}", *text_features(joined, linked)], own.label)

    def pop_to(place: int) -> None:
        while len(stack) > place:
            opened[stack.pop().name] -= 1

    def close(names: frozenset[str], barrier: frozenset[str]) -> None:
        """Ends the nearest open element of these names, unless a barrier stands before it."""
        if any(opened[name] for name in names):
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].name in names:
                    pop_to(place)
                    return
                if stack[place].name in barrier:
                    return

    while match := _TOKEN.search(html, at):
        text(at, match.start())
        at = match.end()
        name = (match["name"] or match["torn"] or "").lower()
        if not name:
            continue
        ends = html[match.start() + 1] == "/"
        if name in RAW_TAGS:
            if not ends and not (match["attributes"] or "").endswith("/"):
                found = _RAW_END[name].search(html, at)
                at = found.end() if found else len(html)
            continue
        if name == "br":
            run.texts.append(" ")
            continue
        if name in BLOCK_TAGS:
            yield from block()
        if ends:
            if opened[name]:
                place = len(stack) - 1
                while stack[place].name != name:
                    place -= 1
                pop_to(place)
            continue
        if name in _BLOCKS_END_P:
            close(frozenset({"p"}), frozenset({"td", "th", "caption", "button"}))
        if name in CLOSES:
            close(*CLOSES[name])
        if name in VOID_TAGS or (name not in BLOCK_TAGS and name != "a"):
            continue
        if name == "a":  # links don't nest
            close(frozenset({"a"}), BLOCK_TAGS)
        values = attributes(match["attributes"]) if match["attributes"] else {}
        above = stack[-1]
        own = {f"tag {name}"} | (_names(values) if values else set()) if name != "a" else set()
        handed_on = above.handed_on if own <= above.handed_on else above.handed_on | own
        part = frozenset(f"in {x}" for x in own) if name in PARTS else above.part
        label = int(values[LABEL]) if LABEL in values else above.label
        stack.append(_Element(name, handed_on, part, label))
        opened[name] += 1
    text(at, len(html))
    yield from block()
