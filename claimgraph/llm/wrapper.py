"""Main text of pages by wrapper induction.

Pages of one host are aligned with a reference page by simple tree matching. Nodes that carry the same text in
most pages that differ are the host's template; the other slots vary, and content is sought in them.
Runs of like siblings (paragraphs, list items) are one slot, so pages of any length align.
"""

from __future__ import annotations

import pickle
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.dom import Node, parse, text_of
from claimgraph.llm.scratch import Scratch

#: A node is template if it has the reference's text in this share of the pages that differ from the reference,
#: and there are so many of them.
CONSTANT_SHARE = 0.8
LEAST_PAGES = 3
#: Wrappers of at most so many bytes in all are sent to every executor; more are joined by host.
BROADCAST_BYTES = 32 << 20
_NEVER = frozenset(
    "nav footer aside form button select input textarea label fieldset dialog menu object audio video canvas head".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
_SIDE = re.compile(
    r"(?:^|[-_\s])(?:ads?|adv|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|sidebar|side|nav|navbar|navigation"
    r"|menu|footer|header|masthead|breadcrumbs?|comments?|commentlist|discussion|disqus|replies|respond|cookies?|consent|gdpr"
    r"|notices?|banner|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended"
    r"|recommendations|widget|toolbar|pagination|pager|copyright|legal|alert|toast|search|tags|skip)(?:$|[-_\s])",
    re.I,
)
_BOXES = frozenset("div section article main header nav aside ul ol table form body".split())
MOST_BOXES = 12
#: Characters that make a form a page, and an article more than a teaser.
PAGE_FORM, PART = 200, 300
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Slot:
    """A node of a skeleton: a label, the hash of its text, and its slots; like siblings are one slot."""

    __slots__ = ("label", "digest", "slots", "nodes")

    def __init__(self, label: str, digest: int, slots: list, nodes: list[Node] | None):
        self.label, self.digest, self.slots, self.nodes = label, digest, slots, nodes


def _label(node: Node) -> str:
    names = node.names or {}
    return f"{node.tag}.{names.get('class', '')}#{names.get('id', '')}"


def _digest(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def skeleton(nodes: list[Node]) -> Slot:
    """The slot of a run of like siblings. Runs hold text only; a single node holds its children's slots."""
    label = _label(nodes[0])
    digest = _digest("\n".join(text_of(n) for n in nodes))
    if len(nodes) > 1:
        return Slot(label + "+", digest, [], nodes)
    slots, run = [], []
    for kid in nodes[0].kids:
        if kid.tag in ("br", "hr", "img", "wbr") or kid.tag in ("script", "style", "noscript", "meta", "link"):
            continue
        if run and _label(run[-1]) != _label(kid):
            slots += _slots(run)
            run = []
        run.append(kid)
    slots += _slots(run)
    return Slot(label, digest, slots, nodes)


def _slots(run: list[Node]) -> list[Slot]:
    """Like siblings are one slot, but for a few boxes, each of which may be a part of the layout."""
    if run and run[0].tag in _BOXES and len(run) <= MOST_BOXES:
        return [skeleton([n]) for n in run]
    return [skeleton(run)] if run else []


def packed(slot: Slot) -> tuple:
    return (slot.label, slot.digest, tuple(packed(s) for s in slot.slots))


def unpacked(raw: tuple) -> Slot:
    return Slot(raw[0], raw[1], [unpacked(s) for s in raw[2]], None)


def numbered(slot: Slot, out: list[Slot] | None = None) -> list[Slot]:
    """The slots in page order; their places are their numbers."""
    out = [] if out is None else out
    out.append(slot)
    for s in slot.slots:
        numbered(s, out)
    return out


def _alike(a: str, b: str) -> bool:
    """One paragraph here and several there are the same slot."""
    return a.rstrip("+") == b.rstrip("+")


def align(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """Simple tree matching: most pairs of like slots that keep order and ancestry, and these pairs.

    Among matchings of one size, that with more slots of equal text is taken.
    """
    if not _alike(a.label, b.label):
        return 0, []
    pairs, score = [(a, b)], 1
    x, y = a.slots, b.slots
    if [s.label.rstrip("+") for s in x] == [s.label.rstrip("+") for s in y]:
        for s, t in zip(x, y, strict=True):  # children in step need no search
            more, found = align(s, t)
            score += more
            pairs += found
        return score, pairs
    tried = {}
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, s in enumerate(x, 1):
        for j, t in enumerate(y, 1):
            top = max(best[i - 1][j], best[i][j - 1])
            if _alike(s.label, t.label):
                more, found = align(s, t)
                tried[i, j] = more + 1e-4 * (s.digest == t.digest), found
                top = max(top, best[i - 1][j - 1] + tried[i, j][0])
            best[i][j] = top
    i, j = len(x), len(y)
    while i and j:
        if (i, j) in tried and best[i][j] == best[i - 1][j - 1] + tried[i, j][0]:
            pairs += tried[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return len(pairs), pairs


def _kind_aside(node: Node) -> bool:
    """Whether a node's kind, role or being hidden says that it is not the article."""
    if node.tag in _NEVER:
        return True
    names = node.names
    if not names:
        return False
    if names.get("role", "").lower() in _ROLES or names.get("aria-hidden", "").lower() == "true":
        return True
    return "hidden" in names or "display:none" in names.get("style", "").replace(" ", "").lower()


def _name_aside(node: Node) -> bool:
    """Whether a node's class or id hints that it is not the article."""
    names = node.names
    return bool(names) and node.tag not in ("html", "body", "article", "main") and bool(
        _SIDE.search(names.get("class", "")) or _SIDE.search(names.get("id", ""))
    )


def _layout(root: Node) -> set[int]:
    """Boxes that a name hints to be asides, but that hold most of what their surroundings say.

    Over half of the text with an article or a first heading, or nearly all of it, is the page itself
    (``has-sidebar``), not a part at its side.
    """
    found: set[int] = set()

    def walk(node: Node, whole: int) -> None:
        for kid in node.kids:
            if _kind_aside(kid):
                continue
            inner = whole
            if _name_aside(kid):
                size = len(text_of(kid, _kind_aside))
                if 5 * size <= 4 * whole and not (
                    2 * size > whole
                    and _find(kid, lambda n: n.tag == "h1" or _is_article(n) or _is_main(n), [], _kind_aside)
                ):
                    continue
                found.add(id(kid))
                inner = size
            elif kid.tag in ("article", "main"):
                inner = len(text_of(kid, _kind_aside))
            walk(kid, inner)

    walk(root, len(text_of(root, _kind_aside)))
    return found


def _find(node: Node, wanted, out: list[Node], aside) -> list[Node]:
    for kid in node.kids:
        if not aside(kid):
            if wanted(kid):
                out.append(kid)
            _find(kid, wanted, out, aside)
    return out


def _is_article(node: Node) -> bool:
    names = node.names or {}
    if node.tag == "article" and _SIDE.search(f"{names.get('class', '')} {names.get('id', '')}"):
        return False
    return node.tag == "article" or names.get("itemprop") == "articleBody"


def _is_main(node: Node) -> bool:
    return node.tag == "main" or (node.names or {}).get("role") == "main"


def _linked(node: Node) -> int:
    """Characters inside links."""
    return sum(len(text_of(k)) if k.tag == "a" else _linked(k) for k in node.kids)


def _open_forms(root: Node) -> None:
    """Forms that are the page itself become plain boxes: those around an article, or around nearly all that is said."""
    def said(node: Node, forms: bool) -> int:
        return len(text_of(node, lambda n: _kind_aside(n) and not (forms and n.tag == "form")))

    for form in _find(root, lambda n: n.tag == "form", [], lambda n: n.tag != "form" and _kind_aside(n)):
        around = _find(form, lambda n: _is_article(n) or _is_main(n), [], lambda n: False)
        size = said(form, True)
        if around or (size >= PAGE_FORM and 5 * size >= 4 * said(root, True)):
            form.tag = "div"


def _parts(best: Node, inside: list[Node], sizes: list[int]) -> Node:
    """The box of an article that is told in several: siblings about as long as the longest, none of them a teaser."""
    like = [
        n for n, size in zip(inside, sizes, strict=True)
        if n.up is best.up and 2 * size >= max(sizes) and size >= PART and 5 * _linked(n) <= size
    ]
    return best.up if best.up is not None and len(like) > 1 else best


def main_text(root: Node) -> str:
    """The text of the article, without what names, kinds, marks as template or links tell apart from it.

    Names only hint: a box that is most of its surroundings is kept, an article inside a hinted box is taken where
    there is no other and it says more than the rest, and a page with text outside asides by kind is never left empty.
    """
    _open_forms(root)
    layout = _layout(root)

    def aside(node: Node) -> bool:
        return _kind_aside(node) or (id(node) not in layout and _name_aside(node))

    def largest(away) -> Node | None:
        inside = _find(root, _is_article, [], away) or _find(root, _is_main, [], away)
        sizes = [len(text_of(n, aside)) for n in inside]
        return _parts(inside[sizes.index(max(sizes))], inside, sizes) if inside and max(sizes) else None

    plain = largest(aside)
    text = _taken(root, plain, aside)
    hinted = largest(_kind_aside) if plain is None else None
    if hinted is not None:
        other = _taken(root, hinted, aside)
        if len(other) > len(text):
            return other
    if text:
        return text
    bodies = _find(root, lambda n: n.tag == "body", [], _kind_aside)
    return text_of(bodies[0] if bodies else root, _kind_aside)


def _taken(root: Node, chosen: Node | None, aside) -> str:
    """The text of the chosen article, or of the body without one."""
    keep = set()
    up = chosen
    while up is not None:
        keep.add(id(up))
        up = up.up

    def skip(node: Node) -> bool:
        if id(node) in keep:
            return False
        if node.tag == "header":  # a page header goes; an article's keeps its headings
            if chosen is None:
                return not any(k.tag in _HEADINGS for k in _find(node, lambda n: True, [], aside))
            return False
        if node.up is not None and node.up.tag == "header" and node.tag not in _HEADINGS and node.tag not in ("div", "header"):
            return True
        if node.mark or aside(node):
            return True
        if chosen is None and node.tag in ("ul", "ol", "div", "p", "table", "section", "dl"):
            size = len(text_of(node))
            return size > 0 and _linked(node) > 0.6 * size
        return False

    if chosen is not None:
        return text_of(chosen, skip) or text_of(chosen, aside)
    bodies = _find(root, lambda n: n.tag == "body", [], aside)
    body = bodies[0] if bodies else root
    return text_of(body, skip) or text_of(body, aside)


def _top(root: Node) -> Slot:
    return skeleton([root])


def _references(stream):
    """Of each task the first page of each host, as a skeleton."""
    first: dict[str, tuple[int, str]] = {}
    for batch in stream:
        for host, page, html in zip(*(batch[c].to_pylist() for c in ("host", "page_id", "html")), strict=True):
            if host not in first or page < first[host][0]:
                first[host] = (page, html)
    hosts = list(first)
    for at in range(0, len(hosts), 500):
        own = hosts[at : at + 500]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own, pa.string()), pa.array([first[h][0] for h in own], pa.int64()),
                pa.array([pickle.dumps(packed(_top(parse(first[h][1])))) for h in own], pa.binary()),
            ],
            ["host", "page_id", "skeleton"],
        )


def _alignments(stream):
    """Of each task and host: pages that differ from the reference, and how many of them repeat each slot's text."""
    counts: dict[tuple[str, int], int] = {}
    cache: dict[bytes, Slot] = {}
    for batch in stream:
        for host, raw, html in zip(*(batch[c].to_pylist() for c in ("host", "skeleton", "html")), strict=True):
            if raw not in cache:
                if len(cache) > 200:
                    cache.clear()
                cache[raw] = unpacked(pickle.loads(raw))
            reference, page = cache[raw], _top(parse(html))
            if page.digest == reference.digest:
                continue  # a copy shows nothing about what varies
            counts[host, -1] = counts.get((host, -1), 0) + 1
            place = {id(s): n for n, s in enumerate(numbered(reference))}
            for ours, theirs in align(reference, page)[1]:
                if ours.digest == theirs.digest:
                    key = (host, place[id(ours)])
                    counts[key] = counts.get(key, 0) + 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([counts[k] for k in keys], pa.int64()),
        ],
        ["host", "slot", "pages"],
    )


def _extracted(stream):
    cache: dict[bytes, Slot] = {}
    for batch in stream:
        texts = []
        for raw, constant, html in zip(*(batch[c].to_pylist() for c in ("skeleton", "constant", "html")), strict=True):
            root = parse(html or "")
            if raw is not None and constant:
                if raw not in cache:
                    if len(cache) > 200:
                        cache.clear()
                    cache[raw] = unpacked(pickle.loads(raw))
                reference = cache[raw]
                template = {id(s) for n, s in enumerate(numbered(reference)) if n in set(constant)}
                for ours, theirs in align(reference, _top(root))[1]:
                    if id(ours) in template and ours.digest == theirs.digest:
                        for node in theirs.nodes:
                            node.mark = True
            texts.append(main_text(root))
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, skeleton, constant`` of each host that has enough differing pages; ``pages`` has ``host, page_id, html``."""
    some = pages.where("length(html) > 0 AND page_id IS NOT NULL")
    references = scratch.write(
        some.mapInArrow(_references, "host string, page_id long, skeleton binary")
        .groupBy("host").agg(F.min_by("skeleton", "page_id").alias("skeleton")),
        "references",
    )
    aligned = (
        with_wrapper(some, references)
        .mapInArrow(_alignments, "host string, slot int, pages long")
        .groupBy("host", "slot").agg(F.sum("pages").alias("pages"))
    )
    constant = (
        aligned.groupBy("host").agg(
            F.max(F.when(F.col("slot") == -1, F.col("pages"))).alias("all"),
            F.collect_list(F.struct("slot", "pages")).alias("each"),
        )
        .where(F.col("all") >= LEAST_PAGES)
        .select("host", F.transform(
            F.filter("each", lambda s: (s["slot"] >= 0) & (s["pages"] >= F.col("all") * CONSTANT_SHARE)),
            lambda s: s["slot"],
        ).alias("constant"))
        .where(F.size("constant") > 0)
    )
    return scratch.write(references.join(constant, "host"), "wrappers")


def with_wrapper(pages: DataFrame, wrapper: DataFrame, how: str = "inner") -> DataFrame:
    size = wrapper.agg(F.sum(F.octet_length("skeleton"))).first()[0] or 0
    return pages.join(F.broadcast(wrapper) if size <= BROADCAST_BYTES else wrapper, "host", how)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    A null or empty page and one without an article give an empty text. A page without a readable host
    shares the wrapper of the others without one; a row without id is extracted but no reference. Copies of a page
    say nothing about the template; repeated rows give equal texts. Other columns are ignored; an empty table
    gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "wrapper")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    own = pages.select("page_id", "url", host.alias("host"), "html")
    found = wrappers(own.select("host", "page_id", "html"), scratch)
    return (
        with_wrapper(own, found, "left")
        .select("page_id", "url", "html", "skeleton", "constant")
        .mapInArrow(_extracted, "page_id long, url string, text string")
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )
