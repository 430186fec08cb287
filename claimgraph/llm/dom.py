"""A small DOM for extraction: tags, classes and text of a page, however broken its markup."""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - {"br", "html", "head", "body", "td", "th", "tr", "option", "optgroup", "legend", "tbody", "thead", "tfoot"}
#: An opening tag ends an open one of these, unless one of the second set stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Deeper elements hang on the ancestor at this depth; their text stays.
DEEPEST = 150
_TOKEN = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>""", re.S
)
_NAMES = re.compile(
    r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I
)


class Node:
    """An element; ``parts`` are texts and elements in page order."""

    __slots__ = ("tag", "names", "parts", "up", "mark")

    def __init__(self, tag: str, names: dict[str, str] | None, up: Node | None):
        self.tag, self.names, self.parts, self.up, self.mark = tag, names, [], up, None

    @property
    def kids(self) -> list[Node]:
        return [p for p in self.parts if not isinstance(p, str)]


def _attributes(raw: str) -> dict[str, str] | None:
    if "=" not in raw and "hidden" not in raw.lower():
        return None
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(raw)}
    return found or None


def parse(html: str) -> Node:
    """The tree of a page. Comments, declarations and the content of raw elements are left out."""
    root = Node("", None, None)
    stack, at, end = [root], 0, len(html)
    while at < end:
        token = _TOKEN.search(html, at)
        text = html[at : token.start()] if token else html[at:]
        if text:
            stack[-1].parts.append(unescape(text) if "&" in text else text)
        if not token:
            break
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in _ENDS_P:
            _close(stack, {"p"}, {"table", "td", "th", "button"})
        if tag in _ENDS:
            _close(stack, *_ENDS[tag])
        node = Node(tag, _attributes(token[3]), stack[-1])
        stack[-1].parts.append(node)
        if tag in RAW:
            if not token[3].endswith("/"):
                closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = closing.end() if closing else end
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    return root


def _close(stack: list[Node], ends: set[str], fence: set[str]) -> None:
    """Close the outermost open element among ``ends`` that no fence protects."""
    found = None
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in fence:
            break
        if stack[depth].tag in ends:
            found = depth
            if stack[depth].tag == "p":
                break
    if found is not None:
        del stack[found:]


def pieces(node: Node, skip=None, out: list[str] | None = None) -> list[str]:
    """Text pieces in page order, a blank around each block; subtrees that ``skip`` names are left out."""
    out = [] if out is None else out
    for part in node.parts:
        if isinstance(part, str):
            out.append(part)
        elif part.tag not in RAW and not (skip and skip(part)):
            block = part.tag in BLOCK
            if block:
                out.append(" ")
            pieces(part, skip, out)
            if block:
                out.append(" ")
    return out


def text_of(node: Node, skip=None) -> str:
    """Text with every run of white space as one blank, trimmed."""
    return " ".join("".join(pieces(node, skip)).split())
