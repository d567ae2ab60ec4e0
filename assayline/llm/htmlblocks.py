"""HTML into leaf blocks: the text between block-level tags, with the tag path it stands in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

#: Elements whose content is never shown as text of the page.
SKIPPED = frozenset("script style template head title desc iframe noscript textarea select option datalist canvas audio video".split())
#: Elements with a language of their own, whose words belong to the line they stand in.
FOREIGN = frozenset("math svg".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a line of text.
INLINE = frozenset(
    "a abbr acronym area b base bdi bdo big br button cite code data del dfn em embed font i img input ins kbd label link map mark meta meter object output param picture progress"
    " q rp rt ruby s samp slot small source span strike strong sub sup time track tt u var wbr".split()
)
#: Elements whose end tags may be left out, with the open elements that they end.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
RAW = frozenset("script style textarea title iframe noscript".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    """path: tag names and the words of class, id and role, outermost element first. linked: characters inside links."""

    text: str
    path: tuple[tuple[str, ...], ...]
    linked: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    for m in _NAMES.finditer(attributes):
        found += _PART.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(found)


def _inner(stack: list[tuple[str, tuple[str, ...]]]) -> int:
    """Where the outermost hidden or foreign element lies in the stack."""
    return next((k for k, (tag, _) in enumerate(stack) if tag in SKIPPED or tag in FOREIGN), len(stack))


def blocks(html: str) -> Iterator[Block]:
    """Blocks with text in page order. Unclosed elements end where an outer one does; stray end tags are ignored."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = links = hidden = foreign = 0
    lower = None
    at = 0

    def flush() -> Iterator[Block]:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                yield Block(text, tuple(n for _, n in stack), linked)
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            text = unescape(raw) if "&" in raw else raw
            held.append(text)
            if links:
                linked += len(text.strip())

    def drop(depth: int) -> None:
        nonlocal links, hidden, foreign
        while len(stack) > depth:
            tag = stack.pop()[0]
            links -= tag == "a"
            hidden -= tag in SKIPPED
            foreign -= tag in FOREIGN

    while True:
        m = _MARKUP.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        # What is not shown ends neither a line nor a paragraph, nor does what lies inside it or in a formula or drawing.
        inline = tag in INLINE or tag in SKIPPED or tag in FOREIGN or hidden > 0 or foreign > 0
        if m[1] and inline and tag not in INLINE and tag not in SKIPPED and tag not in FOREIGN:
            inline = any(t == tag for t, _ in stack[_inner(stack) :])  # the end of something outside ends what is inside
        if not inline:
            yield from flush()
        elif tag == "br" or tag == "img" or foreign and tag == "text":
            held.append(" ")
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    drop(depth)
                    break
            continue
        if tag == "body":
            drop(0)
        elif not inline:
            ends = IMPLIED.get(tag, ())
            for depth in range(len(stack) - 1, -1, -1):
                open_tag = stack[depth][0]
                if open_tag == "p" or open_tag in ends:
                    drop(depth)
                    break
                if open_tag not in INLINE and open_tag not in ("thead", "tbody", "tfoot"):
                    break
        if tag in VOID or m[3].endswith("/") and (foreign or tag in FOREIGN):
            continue
        stack.append((tag, _names(tag, m[3])))
        links += tag == "a"
        hidden += tag in SKIPPED
        foreign += tag in FOREIGN
        if tag in RAW:
            if lower is None:
                lower = html.lower() if html.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            end = lower.find(f"</{tag}", at)
            raw = html[at : end if end >= 0 else len(html)]
            if tag not in SKIPPED:
                add(raw)
            at = end if end >= 0 else len(html)
    yield from flush()
