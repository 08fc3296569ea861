"""A small, forgiving HTML tree: nodes to classify, and text pieces in page order.

A page is read once, from its start to its end, whatever is wrong with it: a tag begins at one place only, and open
elements are found by their names and not by walks over the stack, so the time is in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never page text.
DROPPED = frozenset("head script style template iframe svg canvas audio video title annotation annotation-xml select datalist textarea".split())
RAW = frozenset("script style template iframe svg textarea title".split())
BLOCK = frozenset(
    """html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th
    blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary hr dialog
    menu center hgroup search option select""".split()
)
#: Block elements that take their parent's class unless they carry attributes.
PLAIN = frozenset("li dt dd thead tbody tfoot tr td th option".split())
#: A start tag of the key closes an open element of the values first, within the nearest of the stoppers.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NO_P = BLOCK - {"td", "th", "tr", "option", "thead", "tbody", "tfoot", "caption", "legend", "summary"}
_SCOPE = frozenset("article section div body main td th li blockquote header footer nav aside form figure details".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"=\s*([\"'])|>")
_ATTR = re.compile(r"(class|id|role|aria-label|itemprop|data-component)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "words", "parent", "kids", "chars", "linked", "links", "pieces", "commas", "stops", "paras", "items", "depth", "hidden", "inputs")

    def __init__(self, tag: str, words: list[str], parent: int, depth: int, hidden: bool):
        self.tag, self.words, self.parent, self.depth, self.hidden = tag, words, parent, depth, hidden
        self.kids: list[int] = []
        self.chars = self.linked = self.links = self.pieces = self.commas = self.stops = self.paras = self.items = self.inputs = 0


def attribute_words(attrs: str) -> list[str]:
    """Lower-case words in class, id, role and the like; camelCase is split."""
    text = " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs))
    return _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower()) if text else []


def tags(page: str, ends: dict[str, int]) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the tags of a page; comments and declarations have an empty name.

    Reading goes on at ``ends['at']`` if a reader sets it beyond the tag. Quotes after an equals sign hide a
    tag's end; if that leaves a tag without one, quotes count no more from there on. A tag, comment or
    declaration without an end takes the rest of the page.
    """
    at, n, quotes = page.find("<"), len(page), True
    while 0 <= at < n:
        lead = page[at + 1 : at + 2]
        name, closing, attrs, end = "", lead == "/", "", at + 1
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
        elif lead in ("!", "?") and lead:
            end = page.find(">", at)
            end = n if end < 0 else end + 1
        elif m := _NAME.match(page, at + 1 + closing):
            name, spot = m[0].lower(), m.end()
            end = -1
            while quotes and end < 0 and (stop := _STOP.search(page, spot)):
                if stop[1] is None:
                    end = stop.end()
                else:
                    spot = page.find(stop[1], stop.end()) + 1
                    if not spot:
                        break
            quotes = quotes and end >= 0
            if end < 0:
                end = page.find(">", m.end()) + 1
            if not end:
                name, end = "", n
            attrs = page[m.end() : end - 1]
        if end > at + 1:
            ends["at"] = end
            yield at, end, name, closing, attrs
            end = ends["at"]
        at = page.find("<", end)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, pieces): nodes in page order, the first a root; pieces (node, text), (-1, '') a block's end.

    End tags that match nothing are ignored, open elements are closed where HTML closes them, and a page may
    end anywhere. Inline elements belong to the node around them, unless they carry attribute words.
    """
    nodes = [Node("html", [], -1, 0, False)]
    pieces: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, each with its node
    opened: dict[str, list[int]] = {}  # where elements of a name are in the stack
    scopes = [0]  # where elements are that inline ends don't reach beyond
    links = skip = at = 0

    def text(raw: str) -> None:
        if not raw or skip:
            return
        node = nodes[stack[-1][1]]
        if raw.isspace():
            pieces.append((stack[-1][1], " "))
            return
        raw = html.unescape(raw)
        n = len(raw.strip())
        node.chars += n
        node.pieces += 1
        node.commas += raw.count(",")
        node.stops += raw.count(".") + raw.count("!") + raw.count("?")
        if links:
            node.linked += n
        pieces.append((stack[-1][1], raw))

    def last(names) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((opened[t][-1] for t in names if opened.get(t)), default=0)

    def close(k: int) -> None:
        nonlocal links, skip
        for tag, _ in reversed(stack[k:]):
            opened[tag].pop()
            links -= tag == "a"
            skip -= tag in DROPPED
            if tag in _SCOPE:
                scopes.pop()
            if tag in BLOCK:
                pieces.append((-1, ""))
        del stack[k:]

    ends: dict[str, int] = {}
    for start, end, tag, closing, attrs in tags(page, ends):
        text(page[at:start])
        at = end
        if not tag or tag == "html":
            continue
        if closing:
            k = last((tag,))
            if k > (0 if tag in BLOCK else scopes[-1]):  # an inline end tag closes nothing beyond its block
                close(k)
            continue
        if tag in VOID:
            if tag == "input" and not skip:
                nodes[stack[-1][1]].inputs += 1
            if tag == "br" and not skip:
                pieces.append((stack[-1][1], " "))
            elif tag == "hr":
                pieces.append((-1, ""))
            continue
        if tag == "body" and opened.get("head"):
            close(opened["head"][0])
        if tag in _NO_P and (k := last(("p",))) > scopes[-1]:
            close(k)
        if tag in CLOSES:
            which, stop = CLOSES[tag]
            if (k := last(which)) > last(stop):
                close(k)
        parent = stack[-1][1]
        words = attribute_words(attrs) if attrs else []
        if tag in BLOCK:
            pieces.append((-1, ""))
        if (tag in BLOCK and (words or tag not in PLAIN)) or (words and tag not in DROPPED and tag not in ("a", "body")):
            hidden = bool(attrs) and bool(_HIDDEN.search(attrs))
            nodes.append(Node(tag, words, parent, nodes[parent].depth + 1, hidden))
            nodes[parent].kids.append(len(nodes) - 1)
            here = len(nodes) - 1
        else:
            here = parent
        if tag == "a":
            links += 1
            nodes[here].links += 1
        elif tag == "p":
            nodes[here].paras += 1
        elif tag in PLAIN:
            nodes[here].items += 1
        elif tag in ("button", "select", "textarea"):
            nodes[here].inputs += 1
        if attrs.rstrip().endswith("/") and tag in ("script", "iframe", "svg", "path", "use"):
            continue
        opened.setdefault(tag, []).append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append((tag, here))
        skip += tag in DROPPED
        if tag in RAW:
            stop_ = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag == "textarea" and not skip:
                text(page[at : stop_.start() if stop_ else len(page)])
            at = ends["at"] = stop_.end() if stop_ else len(page)
            close(len(stack) - 1)
    text(page[at:])
    close(1)
    return nodes, pieces


def blocks(pieces: list[tuple[int, str]], keep) -> str:
    """Text of the pieces whose node is in ``keep``: blocks in page order, white space made one space."""
    out: list[str] = []
    now: list[str] = []
    for node, piece in pieces:
        if node < 0:
            if now:
                line = " ".join("".join(now).split())
                if line:
                    out.append(line)
                now = []
        elif keep[node]:
            now.append(piece)
    if now:
        line = " ".join("".join(now).split())
        if line:
            out.append(line)
    return "\n".join(out)
