"""Leaf blocks of web pages, with what stands around them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Elements that stand within a line of text; all others part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is no text of the page.
UNSEEN = frozenset("iframe noembed noframes noscript object script select style svg template textarea title xmp".split())
#: An opening tag ends an open element of its list, within the elements that bound it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+")
_NAMED = re.compile(r"class|id|role|hidden|style|aria", re.I)
_SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """Text between block boundaries, the tags and names around it, and how much of it is in links."""

    text: str
    tags: tuple[str, ...]
    names: frozenset[str]
    nearest: frozenset[str]  # names of the innermost element that has any
    linked: int = 0


@dataclass
class _Open:
    tag: str
    names: frozenset[str] = field(default_factory=frozenset)


def _names(attributes: str) -> frozenset[str]:
    """Words of the attributes that say what an element is for."""
    if not _NAMED.search(attributes):
        return frozenset()
    found = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(next(filter(None, values), ""))
        if name in ("class", "id", "role", "aria-label"):
            found.update(_NAMES.findall(_SPLIT_CASE.sub(" ", value).lower()))
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)) or (
            name == "aria-hidden" and value.lower() == "true"
        ):
            found.add("hidden")
    return frozenset(found)


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page in page order, character references decoded, white space made single.

    Tags need not be closed: a block element ends an open paragraph, an item the
    item before it, and an end tag all that was opened within. End tags of
    nothing open are left out, as are comments, declarations and what is not shown.
    """
    blocks: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    links: list[str] = []
    depth = 0  # of open links

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                names = frozenset().union(*(o.names for o in stack))
                nearest = next((o.names for o in reversed(stack) if o.names), frozenset())
                linked = len(" ".join(unescape("".join(links)).split()))
                blocks.append(Block(text, tuple(o.tag for o in stack), names, nearest, linked))
            parts.clear()
        links.clear()

    def close(at: int) -> None:
        nonlocal depth
        depth -= sum(o.tag == "a" for o in stack[at:])
        del stack[at:]

    position, size = 0, len(html)
    while position < size:
        at = html.find("<", position)
        if at < 0:
            at = size
        if at > position:
            parts.append(html[position:at])
            if depth:
                links.append(html[position:at])
        if at == size:
            break
        tag = _TAG.match(html, at)
        if not tag:
            parts.append("<")
            position = at + 1
            continue
        position = tag.end()
        if tag["raw"]:
            parts.append(tag["raw"].replace("&", "&amp;"))
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        inline = name in INLINE
        if tag["end"]:
            if not inline:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == name:
                    close(k)
                    break
                if inline and stack[k].tag not in INLINE:
                    break
            continue
        if name in UNSEEN:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, position)
            position = end.end() if end else size
            continue
        if inline:
            if name == "br":
                parts.append(" ")
        else:
            flush()
            ended, bounds = ENDS.get(name, ({"p"}, {"td", "th", "table", "li", "dd"}))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ended or stack[k].tag == "p":
                    close(k)
                    if name not in ENDS:
                        break
        if name not in VOID and not tag["attributes"].endswith("/"):
            stack.append(_Open(name, _names(tag["attributes"])))
            depth += name == "a"
    flush()
    return blocks
