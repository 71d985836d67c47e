"""Nodes of a web page: elements that make blocks, and the runs of text between their borders.

One pass over tags, linear in the page's length. End tags that are missing are implied as in HTML (a paragraph ends where the next
block begins, a list item where the next item does); end tags that match nothing are ignored. Inline elements make no node: their text belongs to the
run they stand in. Nodes are in page order, so that a node's subtree is a run of nodes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)", re.S)
#: class, id and the like, whose words tell what an element is for.
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label|hidden|style|data-y)(?:\s*=\s*("[^"]*|'[^']*|[^\s>]+))?(?=[\s"'/>]|\Z)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements that begin a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content isn't text of the page; the first ones hold no tags.
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp template".split())
UNSEEN = frozenset("svg math object canvas audio video datalist".split())
#: What an opening tag ends, and where the search for it stops.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "caption"}), frozenset({"table"})),
}
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


@dataclass
class Page:
    """Lists by node, in page order. A run of text has the tag ``#`` and a text."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    #: The first node after the subtree.
    ends: list[int] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    #: Characters of a run that stand in links.
    links: list[int] = field(default_factory=list)
    #: What a composed page says of its nodes ("1": main text), "" else.
    truths: list[str] = field(default_factory=list)


_known: dict[str, tuple[tuple[str, ...], str]] = {}


def attribute_words(attributes: str) -> tuple[tuple[str, ...], str]:
    """Words of class, id, role, ... in lower case, and the value of data-y."""
    if attributes in _known:
        return _known[attributes]
    found, truth = [], ""
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-y":
            truth = value
        elif name == "hidden" or name == "style":
            if name == "hidden" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                found.append("=hidden")
        else:
            found += [w.lower() for w in _WORD.findall(value)]
    out = tuple(dict.fromkeys(found)), truth
    if len(_known) < 4096 and len(attributes) < 256:
        _known[attributes] = out
    return out


def nodes(source: str) -> Page:
    """The nodes of a page; node 0 is the page itself."""
    page = Page(["#page"], [-1], [0], [0], [()], [""], [0], [""])
    stack, open_ = [0], Counter()
    parts: list[str] = []
    linked, link_at, hidden = 0, 0, 0  # characters of the run in links; the depth of the stack at the open link; unseen elements that are open

    def add(tag: str, words: tuple[str, ...], text: str, links: int, truth: str) -> None:
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.depths.append(len(stack))
        page.ends.append(len(page.tags))
        page.words.append(words)
        page.texts.append(text)
        page.links.append(links)
        page.truths.append(truth)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            add("#", (), text, min(linked, len(text)), page.truths[stack[-1]])
        linked = 0

    def pop() -> None:
        node = stack.pop()
        open_[page.tags[node]] -= 1
        page.ends[node] = len(page.tags)

    def say(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link_at:
                linked += len(text)

    at, size = 0, len(source)
    while at < size:
        found = _TAG.search(source, at)
        if found is None:
            say(source[at:])
            break
        if found.start() > at:
            say(source[at : found.start()])
        at = found.end()
        name = found[2]
        if not name:
            continue
        name, closing = name.lower(), bool(found[1])
        if name in UNSEEN:
            hidden = max(0, hidden - 1) if closing else hidden + (not found[3].endswith("/"))
        elif name in RAW:
            if not closing:
                end = _CLOSERS[name].search(source, at)
                at = end.start() if end else size
        elif name == "a":
            link_at = 0 if closing else len(stack)
        elif name in ("br", "wbr", "img", "hr", "input", "label", "option"):
            if name == "hr":
                flush()
            elif name != "wbr":
                parts.append(" ")
        elif name in BLOCKS:
            if closing:
                if open_[name]:
                    flush()
                    while page.tags[stack[-1]] != name:
                        pop()
                    pop()
                continue
            if name in ("html", "body") and open_[name]:
                continue
            flush()
            # A paragraph ends where a block begins, a heading where another does.
            while page.tags[stack[-1]] == "p" or (name in HEADINGS and page.tags[stack[-1]] in HEADINGS):
                pop()
            if name in ENDS:
                ended, until = ENDS[name]
                if any(open_[x] for x in ended):
                    k = len(stack) - 1
                    while k > 0 and page.tags[stack[k]] not in until and page.tags[stack[k]] not in ended and len(stack) - k < 64:
                        k -= 1
                    if page.tags[stack[k]] in ended:
                        while len(stack) > k:
                            pop()
            words, truth = attribute_words(found[3]) if found[3] else ((), "")
            add(name, words, "", 0, truth or page.truths[stack[-1]])
            stack.append(len(page.tags) - 1)
            open_[name] += 1
        if link_at > len(stack):
            link_at = 0
    flush()
    while stack:
        pop()
    return page
