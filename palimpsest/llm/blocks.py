"""Blocks of an HTML page: text leaves in page order, each with the path of block elements that hold it."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

# Elements that begin a new block; elements whose content is never text of the page; elements without
# content; and which open elements a start tag closes.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav object ol optgroup "
    "option p pre search section select summary table tbody td textarea tfoot th thead tr ul video".split()
)
SILENT = set("script style title noscript template head svg math canvas textarea iframe select datalist object audio video".split())
RAW = set("script style title textarea iframe noscript".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"button", "label", "option", "optgroup", "select", "iframe", "object", "video", "textarea"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
}
_MARKUP = re.compile(
    r"<!--(?:(?:>|->)|.*?(?:--!?>|\Z))"  # a comment
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"  # a tag with a stray quote, or one that never ends
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


OUTER, INNER = 6, 12  # elements of a path that are kept at its two ends


class Leaf(NamedTuple):
    text: str
    path: tuple[str, ...]  # outermost first: a tag and the words of its class, id and role; of a deep one both ends
    depth: int
    link_chars: int


def _key(tag: str, attrs: str) -> str:
    if "=" not in attrs:
        return tag
    words = [w for _, a, b, c in _NAMES.findall(attrs) for w in re.split(r"[\s_-]+|(?<=[a-z])(?=[A-Z])|(?<=\D)(?=\d)", a or b or c) if w]
    return " ".join([tag, *(w.lower() for w in words)])


def leaves(page: str | None) -> list[Leaf]:
    """All non-empty blocks of a page: character references decoded, white space runs turned into one space."""
    if not page:
        return []
    out: list[Leaf] = []
    stack: list[str] = []  # open block elements
    keys: list[str] = []
    parts: list[str] = []
    links = 0  # depth of open a
    link_chars = 0
    silent = ""  # the element that hides what follows
    depth = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = keys if len(keys) <= OUTER + INNER else keys[:OUTER] + keys[-INNER:]
                out.append(Leaf(text, tuple(path), len(keys), link_chars))
            parts.clear()
        link_chars = 0

    open_: Counter[str] = Counter()

    def drop_to(k: int) -> None:
        open_.subtract(stack[k:])
        del stack[k:]
        del keys[k:]

    def add(piece: str) -> None:
        nonlocal link_chars
        if "&" in piece:
            piece = html.unescape(piece)
        parts.append(piece)
        if links:
            link_chars += len(piece.strip())

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            if not silent and at < len(page):
                add(page[at:])
            break
        if not silent and m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, ending = tag.lower(), m["end"]
        if silent:
            if tag == silent:
                depth += -1 if ending else 1
                if depth <= 0:
                    silent = ""
            elif silent == "head" and tag == "body":
                silent = ""
            if silent or tag != "body":
                continue
        if not ending and tag in SILENT and not m["attrs"].endswith("/"):
            if tag in BLOCK:
                flush()
            if tag in RAW:  # its content is no markup
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
                at = close.end()
            else:
                silent, depth = tag, 1
            continue
        if tag == "a":
            links = 0 if ending else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if ending:
            if open_[tag]:
                k = len(stack) - 1
                while stack[k] != tag:
                    k -= 1
                drop_to(k)
            continue
        if stack and stack[-1] == "p" and tag in CLOSES_P:
            drop_to(len(stack) - 1)
        if tag in SIBLINGS and any(open_[x] for x in SIBLINGS[tag][0]):
            same, until = SIBLINGS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in until:
                    break
                if stack[k] in same:
                    drop_to(k)
                    break
        if tag not in EMPTY:
            open_[tag] += 1
            stack.append(tag)
            keys.append(_key(tag, m["attrs"] or ""))
    flush()
    return out
