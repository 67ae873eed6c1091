"""Leaf text blocks of an HTML page, in page order, with their tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: HTML elements by the way their text is laid out.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup: it ends at the end tag only, or with the page.
RAW_TAGS = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: Inside these a closing slash ends an element; their text, like that of object, is text of the block around them.
FOREIGN_TAGS = frozenset(["svg", "math"])
#: A start tag of the key closes an open element of the values, up to the nearest scope element.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div dl fieldset figure footer form header html main nav ol section table td th ul blockquote".split())

_TOKEN = re.compile(r"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)(?:>|\Z)")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_TEMPLATE = re.compile(r"<(/?)template(?=[\s/>])[^>]*>", re.IGNORECASE)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int


def _names(attributes: str) -> tuple[str, ...]:
    found: list[str] = []
    for _, value in _NAMED.findall(attributes):
        found += _PART.findall(value.lower())
    return tuple(found)


def _after_template(page: str, at: int) -> int:
    """Behind the end tag of the template opened before at, nested ones counted; at itself if it is never closed."""
    depth = 1
    for tag in _TEMPLATE.finditer(page, at):
        depth += -1 if tag[1] else 1
        if not depth:
            return tag.end()
    return at


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with text, references decoded, white space turned into single spaces; comments, scripts and styles are no text."""
    page = page or ""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    links = open_links = foreign = at = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(text, stack[-1][1] if stack else (), links))
            pieces.clear()
        links = 0

    while True:
        token = _TOKEN.search(page, at)
        upto = token.start() if token else len(page)
        if upto > at:
            pieces.append(page[at:upto])
            if open_links:
                links += upto - at
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag == "a":
                open_links = 0
            elif tag in FOREIGN_TAGS:
                foreign = max(0, foreign - 1)
            elif tag in BLOCK_TAGS:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        closed = token[3].endswith("/")
        if tag in FOREIGN_TAGS:
            foreign += not closed
            pieces.append(" ")
        elif foreign and closed and tag not in BLOCK_TAGS:
            continue
        elif tag == "template":
            at = _after_template(page, at)
            pieces.append(" ")
        elif tag in RAW_TAGS:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]|\\Z", re.IGNORECASE).search(page, at)
            stop = page.find(">", end.start())
            at = len(page) if stop < 0 or end.start() == len(page) else stop + 1
            pieces.append(" ")
        elif tag == "a":
            open_links = 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK_TAGS:
            foreign = 0
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
            if tag not in VOID_TAGS:
                names = _names(token[3])
                above = stack[-1][1] if stack else ()
                stack.append((tag, (*above, tag, *(f"{tag}.{n}" for n in names), *(f".{n}" for n in names))))
    flush()
    return blocks
