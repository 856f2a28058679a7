"""Blocks of a web page: leaf texts in page order, each with the elements it stands in.

A block ends where an element other than an inline one begins or ends. Comments, scripts, styles, titles and
other content that is never shown are no text. Paragraphs, list items, cells and options are closed by what follows them; an end tag closes
everything opened since its start tag, and is ignored without one. ``br`` is white space. Character references are decoded
after the tags are gone, then runs of white space (``\\x20``, ``\\x09``-``\\x0D``) become one space.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from zlib import crc32

PATH_BUCKETS = 1 << 12
KNOWN_ELEMENTS = 50_000  # size of the cache of element tokens

# Fixed sets of HTML element names.
HIDDEN = "script|style|noscript|template|svg|math|iframe|object|title|textarea"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_TOKEN = re.compile(
    rf"<(?:(?P<end>/?)(?!(?:{HIDDEN})[\s/>])(?P<tag>[a-z][^\s/>]*)(?P<attrs>{_ATTRS})>|!--.*?(?:-->|\Z)"
    rf"|(?P<hidden>{HIDDEN})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=hidden)\s*>|\Z)|[a-z/!?][^>]*(?:>|\Z))", re.S | re.I)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+|[0-9]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")  # a single space is left alone


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # buckets of the element names, classes, ids and roles around the text
    linked: float  # share of its characters inside links


_ELEMENTS: dict[tuple[str, str], tuple[int, ...]] = {}


def element_tokens(tag: str, attrs: str) -> tuple[int, ...]:
    """Buckets of an element's name and of the parts of its class, id and role."""
    found = _ELEMENTS.get((tag, attrs))
    if found is None:
        names = [f"tag:{tag}"]
        for _, a, b, c in _NAMES.findall(attrs):
            names += [f"name:{p.lower()}" for p in _PARTS.findall(_CAMEL.sub(" ", a or b or c))]
        found = tuple(crc32(n.encode()) % PATH_BUCKETS for n in names)
        if len(_ELEMENTS) >= KNOWN_ELEMENTS:
            _ELEMENTS.clear()
        _ELEMENTS[tag, attrs] = found
    return found


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    names: list[str] = []
    paths: list[tuple[int, ...]] = [()]
    pieces: list[str] = []
    linked, link = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = _WHITE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip(" ")
            if text:
                leaf = crc32(f"leaf:{names[-1] if names else ''}".encode()) % PATH_BUCKETS
                out.append(Block(text, (*paths[-1], leaf), min(1.0, linked / len(text))))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        del names[depth:], paths[depth + 1:]

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at:token.start()]
            pieces.append(piece)
            if link:
                linked += len(piece)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link = 0 if token["end"] else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if token["end"]:
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] == tag:
                    close(depth)
                    link = 0
                    break
            continue
        if tag in SIBLINGS:
            for depth in range(len(names) - 1, -1, -1):
                if names[depth] in BARRIERS[tag]:
                    break
                if names[depth] in SIBLINGS[tag]:
                    close(depth)
                    break
        elif tag in CLOSED_BY_BLOCK and names and names[-1] == "p":
            close(len(names) - 1)
        if tag not in VOID:
            names.append(tag)
            paths.append(paths[-1] + element_tokens(tag, token["attrs"]))
    if at < len(page):
        pieces.append(page[at:])
        linked += len(page) - at if link else 0
    flush()
    return out
