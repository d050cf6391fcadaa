"""Leaf blocks of an HTML page: the runs of text between the starts and ends of block
elements, each with what encloses it. One linear pass; any markup gives a result."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

# Names of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th "
    "thead tr ul".split()
)
# Elements whose content is not shown, or is part of a form's controls.
HIDDEN_TAGS = frozenset("button select option datalist svg math template noscript object canvas audio video map".split())
RAW_TAGS = frozenset("script style title textarea iframe xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag ends these open elements, up to the nearest container.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
# The usual end of a tag, past a few quoted values; the others are searched step by step.
_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+){0,16}+>""")
_STOP = re.compile(r"""[>"']""")
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TAGS}


class Block(NamedTuple):
    text: str
    tag: str
    around: frozenset[str]  # tags of all ancestors and parts of their class, id and role
    near: frozenset[str]  # the same of the two innermost alone
    linked: int  # characters inside links
    hidden: bool


class _TagEnds:
    """Ends of the tags of a page. What a search past quoted values came to is kept for
    every stop it passed, so that no stop is passed twice, however tags are broken."""

    def __init__(self, page: str) -> None:
        self.page, self.ends = page, {}

    def after(self, at: int) -> int:
        """Place after the tag whose attributes begin at ``at``; 0 if it never ends."""
        if found := _REST.match(self.page, at):
            return found.end()
        # with quotes that do not close, the tag ends at the next bracket
        return self._past_quotes(at) or self.page.find(">", at) + 1

    def _past_quotes(self, at: int) -> int:
        passed, end = [], 0
        while found := _STOP.search(self.page, at):
            stop = found.start()
            if stop in self.ends:
                end = self.ends[stop]
                break
            passed.append(stop)
            if found[0] == ">":
                end = stop + 1
                break
            at = self.page.find(found[0], stop + 1) + 1
            if not at:
                break
        self.ends.update(dict.fromkeys(passed, end))
        return end


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", content, ""), ("open", name, attributes) and ("close", name, "")."""
    at, size, tag_ends = 0, len(page), _TagEnds(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
        elif m := _NAME.match(page, start + 1):
            end = tag_ends.after(m.end())
            if not end:
                return  # a tag that never ends takes the rest along
            name = m[1].lower()
            if page[start + 1] == "/":
                yield "close", name, ""
            else:
                yield "open", name, page[m.end() : end - 1]
                if name in RAW_TAGS:
                    stop = _RAW_END[name].search(page, end)
                    end = stop.start() if stop else size
            at = end
        else:
            yield "text", "<", ""
            at = start + 1


def _own_marks(name: str, attributes: str) -> frozenset[str]:
    found = {f"<{name}>"}
    if "=" in attributes:
        for _, *values in _MARKS.findall(attributes):
            found.update(p.lower() for p in _PARTS.findall(html.unescape("".join(values))) if len(p) < 24)
    return frozenset(found)


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order; white space is one space, character references decoded."""
    found: list[Block] = []
    nothing: frozenset[str] = frozenset()
    open_tags: list[tuple[str, frozenset[str], bool, frozenset[str]]] = [("", nothing, False, nothing)]
    places: dict[str, list[int]] = {}  # of the open elements, by name
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                tag, around, hidden, own = open_tags[-1]
                found.append(Block(text, tag, around, own | open_tags[-2][3] if tag else own, min(linked, len(text)), hidden))
            parts.clear()
        linked = 0

    def pop() -> None:
        places[open_tags.pop()[0]].pop()

    def innermost(names: Iterable[str]) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    for kind, name, attributes in _tokens(page):
        if kind == "text":
            text = html.unescape(name) if "&" in name else name
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        elif name == "br":
            parts.append("\n")
        elif name == "a":
            in_link = kind == "open"
        elif name in BLOCK_TAGS or name in HIDDEN_TAGS:
            flush()
            if kind == "close":
                if places.get(name):
                    while open_tags[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in BLOCK_TAGS and open_tags[-1][0] == "p":
                pop()
            ended, container = ENDS.get(name, ((), ()))
            depth = innermost(ended)
            if depth > innermost(container):
                while len(open_tags) > depth:
                    pop()
            if name not in VOID_TAGS:
                own, above = _own_marks(name, attributes), open_tags[-1]
                around = above[1] if own <= above[1] else above[1] | own
                places.setdefault(name, []).append(len(open_tags))
                open_tags.append((name, around, above[2] or name in HIDDEN_TAGS, own))
    flush()
    return found
