"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page's tree of blocks is aligned with the tree of one page of the
host by simple tree matching; a block whose text is the same in nearly all pages aligned with it is template,
blocks that vary are content. The counts cover every page of the host. Parts that vary but are no article
(menus, adverts, comments and the like) are told by their element, role or class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import slices, texts
from sievework.session import materialize

#: A block is template if so large a part of the pages aligned with it has its text ...
CONSTANT_SHARE = 0.8
#: ... and at least so many pages do that are no copies of the aligned page.
CONSTANT_PAGES = 5
#: Pages that have so large a part of their text in common with the aligned page count as copies.
COPY_SHARE = 0.5
#: References of all hosts are sent to every executor if they have at most so many bytes together.
BROADCAST_BYTES = 32 << 20
#: Deeper elements are read as part of their ancestor at this depth.
MOST_DEPTH = 200

#: Elements that start a block of text; all others are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without article text, whatever they hold.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input label map menu nav noscript "
    "object optgroup option script search select style svg template textarea title video".split()
)
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
#: Words of which a whole class or id consists that hints at such parts.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pager pagination popup promo promoted promotion recommended related replies reply respond share "
    "sharing sidebar signup social sponsor sponsored subscribe teaser toolbar topbar widget".split()
)
#: A part with such a hint goes if it has fewer characters, ...
LITTLE = 200
#: ... or so large a part of its text is in links or in parts inside it that have a hint of their own.
LINKED_SHARE = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A self-closed svg has no end tag.
_RAW = re.compile(
    r"""(?is)<svg(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*+(?<=/)>|"""
    r"<(script|style|textarea|title|noscript|iframe|template|svg)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
)
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"""
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+)|(\bhidden\b)""")
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Open elements that a start tag closes.
_P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}


class Node:
    """A block element: its label, whether its text is dropped, and its texts and child blocks in order."""

    __slots__ = ("tag", "label", "dropped", "parts", "kids", "inside", "own", "hint", "hinted", "links", "shape", "size")

    def __init__(self, tag: str, label: str, dropped: bool, inside: bool, hint: bool = False, hinted: bool = False) -> None:
        self.tag, self.label, self.dropped, self.inside = tag, label, dropped, inside
        #: Has its class or id a word of DROPPED_WORDS, has that of an ancestor one, characters in links.
        self.hint, self.hinted, self.links = hint, hint or hinted, 0
        self.parts: list[str | Node] = []
        self.kids: list[Node] = []
        self.own = ""
        #: Hash of the labels of the whole tree and its number of nodes, once ``_shape`` has told them.
        self.shape, self.size = None, 1


def _flags(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Label for matching, is it dropped, is it marked as the page's main part, has it a word of DROPPED_WORDS."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, tag in DROPPED, tag == "main", False
    names, role, hidden, main = "", "", False, tag == "main"
    for key, value, bare in _ATTRIBUTE.findall(attributes):
        key, value = (bare or key).lower(), value.strip("\"'")
        if key in ("class", "id"):
            names += " " + value
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "itemprop":
            main |= value.lower() == "articlebody"
    # The whole name counts: cookie-notice is one, has-sidebar and related-work are none.
    hint = any((w := _WORDS.findall(_CAMEL.sub(" ", n).lower())) and DROPPED_WORDS.issuperset(w) for n in names.split())
    dropped = tag in DROPPED or hidden or role in DROPPED_ROLES
    return f"{tag}.{names.strip()}" if names else tag, dropped, main or role == "main", hint


def parse(page: str) -> tuple[Node, list[Node]]:
    """Tree of blocks, and the page's article: all articles of its main part without those of comments and the like, else
    the outermost article or main part with the most text, else nothing."""
    page = _RAW.sub(" ", page) if "<" in page else page
    root = Node("html", "html", False, False)
    stack: list[tuple[str, Node]] = [("html", root)]  # open elements, inline ones with the block they are in
    mains: list[Node] = []
    articles: list[Node] = []
    doubtful: list[Node] = []  # articles and main parts inside something with a hint
    at = 0
    skipped: list[str] = []  # open elements that are too deep for the stack, and how many of each name
    depths: Counter[str] = Counter()
    hidden_inline = 0  # open inline elements whose text is dropped
    for m in _TOKEN.finditer(page):
        if m.start() > at and not hidden_inline:
            block = stack[-1][1]
            block.parts.append(page[at : m.start()])
            if block.hinted and any(t == "a" for t, _ in stack):
                block.links += len(page[at : m.start()].strip())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if depths[tag]:
                while True:
                    depths[last := skipped.pop()] -= 1
                    if last == tag:
                        break
                if tag in BLOCKS:
                    stack[-1][1].parts.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0].rstrip("!") == tag:
                    skipped.clear()
                    depths.clear()
                    hidden_inline -= sum(t.endswith("!") for t, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in ("table", "article", "main") and tag not in BLOCKS:
                    break
            continue
        rest = m[3]
        if tag == "br":
            stack[-1][1].parts.append(" ")
            continue
        if (tag == "body" or tag in BLOCKS) and stack[1:] and stack[1][0] == "head!":  # an unclosed head
            hidden_inline -= sum(t.endswith("!") for t, _ in stack[1:])
            del stack[1:]
        if tag in ("html", "body"):
            continue
        if skipped:
            if tag not in VOID and (tag in BLOCKS or not rest.endswith("/>")):
                skipped.append(tag)
                depths[tag] += 1
            if tag in BLOCKS:
                stack[-1][1].parts.append(" ")
            continue
        if tag in _P_CLOSERS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    hidden_inline -= sum(t.endswith("!") for t, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        closes = _SIBLINGS.get(tag)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes[1]:
                    break
                if stack[k][0] in closes[0]:
                    hidden_inline -= sum(t.endswith("!") for t, _ in stack[k:])
                    del stack[k:]
                    if tag in ("li", "dt", "dd", "td", "th", "option"):
                        break
        parent = stack[-1][1]
        label, dropped, main, hint = _flags(tag, rest[:-1])
        if tag in VOID:
            continue
        if len(stack) > MOST_DEPTH:
            if tag in BLOCKS or not rest.endswith("/>"):
                skipped.append(tag)
                depths[tag] += 1
            if tag in BLOCKS:
                stack[-1][1].parts.append(" ")
            continue
        if tag not in BLOCKS:
            dropped |= hint and tag == "a"
            if not rest.endswith("/>"):
                hidden_inline += dropped
                stack.append((tag + "!" if dropped else tag, parent))
            continue
        # A header inside the article holds its title, elsewhere the site's.
        dropped = parent.dropped or dropped or (tag == "header" and not parent.inside)
        inside = parent.inside or tag == "article" or main
        # An article with a hint inside another one is a comment or the like.
        hint &= tag not in HEADINGS and (parent.inside or not inside)
        node = Node(tag, label, dropped or bool(hidden_inline), inside, hint, parent.hinted)
        parent.parts.append(node)
        parent.kids.append(node)
        stack.append((tag, node))
        if not node.dropped and not parent.inside:
            if node.hinted:
                if inside:
                    doubtful.append(node)
            elif tag == "article":
                articles.append(node)
            elif main:
                mains.append(node)
    if at < len(page) and not hidden_inline and "<" not in page[at : at + 1]:
        stack[-1][1].parts.append(page[at:])
    body = articles or mains or doubtful
    inner = [a for m in mains for a in _find(m, "article")] if mains and not articles else []
    inner = [a for a in inner if not a.hinted] or inner
    body = inner or body
    if body is doubtful:  # teasers beside the text are not the article
        body = body if 2 * max(map(_length, body), default=0) >= _length(root) else []
    if any(n.hinted for n in _all(root)):
        _drop_hinted(root, set(map(id, body)))
    return root, body if len(body) < 2 or inner else [max(body, key=_length)]


def _length(node: Node) -> int:
    """Characters of the blocks of a part."""
    return sum(map(len, blocks(node, set())))


def _all(root: Node) -> list[Node]:
    """All nodes, parents first."""
    found = [root]
    for node in found:
        found.extend(node.kids)
    return found


def _drop_hinted(root: Node, body: set[int]) -> None:
    """Drops parts with a hint that hold little, links, or further parts with one; never what holds the page's
    articles (``body``, by identity) or most of its text."""
    nodes = _all(root)
    size: dict[int, int] = {}
    linked: dict[int, int] = {}  # characters in links and in parts with a hint of their own
    holds: set[int] = set()
    for node in reversed(nodes):
        if node.dropped:
            size[id(node)] = linked[id(node)] = 0
            continue
        size[id(node)] = sum(len(p.strip()) if isinstance(p, str) else size[id(p)] for p in node.parts)
        linked[id(node)] = node.links + sum(size[id(k)] if k.hint else linked[id(k)] for k in node.kids)
        if id(node) in body or any(id(k) in holds for k in node.kids):
            holds.add(id(node))
    for node in nodes:
        if not node.hint or node.dropped or id(node) in holds:
            continue
        n = size[id(node)]
        if linked[id(node)] >= LINKED_SHARE * n or n < LITTLE and node.tag != "p" and 2 * n < size[id(root)]:
            for inner in _all(node):
                inner.dropped = True


def _find(node: Node, tag: str) -> Iterator[Node]:
    for kid in node.kids:
        if kid.tag == tag and not kid.dropped:
            yield kid
        else:
            yield from _find(kid, tag)


def _squeeze(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((unescape(text) if "&" in text else text).split())


def blocks(node: Node, template: set[int]) -> Iterator[str]:
    """Texts of all blocks in page order, without dropped ones and those of template nodes (by identity)."""
    if node.dropped:
        return
    run: list[str] = []
    mine = id(node) not in template
    for part in node.parts:
        if isinstance(part, str):
            run.append(part)
            continue
        if run and mine and (text := _squeeze(run)):
            yield text
        run = []
        yield from blocks(part, template)
    if run and mine and (text := _squeeze(run)):
        yield text


def order(root: Node) -> list[Node]:
    """All nodes, parents first, with their own text set."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        node.own = "" if node.dropped else _squeeze([p for p in node.parts if isinstance(p, str)])
        found.append(node)
        todo.extend(reversed(node.kids))
    return found


def _table(a: list[Node], b: list[Node]) -> list[list[int]]:
    """Most matched nodes of the first i and j trees of two ordered lists."""
    m = [[0] * (len(b) + 1)]
    for x in a:
        above, row, left = m[-1], [0], 0
        for j, y in enumerate(b):
            best = above[j + 1] if above[j + 1] > left else left
            if x.label == y.label:
                w = above[j] + (1 if not x.kids or not y.kids else matched(x, y))
                if w > best:
                    best = w
            row.append(best)
            left = best
        m.append(row)
    return m


def _shape(node: Node) -> int:
    """Hash of the labels of the whole tree."""
    if node.shape is None:
        node.shape = hash((node.label, *map(_shape, node.kids)))
        node.size = 1 + sum(k.size for k in node.kids)
    return node.shape


def _alike(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many trees of two ordered lists have equal labels throughout from the start, and how many more from the end.

    To match such trees with each other is best, so long lists of paragraphs need no table."""
    most = min(len(a), len(b))
    front = back = 0
    while front < most and _shape(a[front]) == _shape(b[front]):
        front += 1
    while back < most - front and _shape(a[-1 - back]) == _shape(b[-1 - back]):
        back += 1
    return front, back


def matched(a: Node, b: Node) -> int:
    """Simple tree matching: nodes in the largest order-keeping match of two trees with equal root labels."""
    if a.label != b.label:
        return 0
    x, y = a.kids, b.kids
    front, back = _alike(x, y)
    same = sum(k.size for k in x[:front]) + sum(k.size for k in x[len(x) - back :])
    return 1 + same + _table(x[front : len(x) - back], y[front : len(y) - back])[-1][-1]


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The matched pairs of nodes."""
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if not x.kids or not y.kids:
            continue
        front, back = _alike(x.kids, y.kids)
        todo += zip(x.kids[:front], y.kids[:front])
        todo += zip(x.kids[len(x.kids) - back :], y.kids[len(y.kids) - back :])
        us, them = x.kids[front : len(x.kids) - back], y.kids[front : len(y.kids) - back]
        m = _table(us, them)
        i, j = len(us), len(them)
        while i and j:
            if m[i][j] == m[i - 1][j]:
                i -= 1
            elif m[i][j] == m[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((us[i], them[j]))
    return pairs


class Wrapper:
    """The tree of a host's reference page; its nodes are numbered in page order."""

    def __init__(self, page: str) -> None:
        self.root = parse(page)[0]
        self.nodes = order(self.root)
        self.number = {id(n): k for k, n in enumerate(self.nodes)}

    def equal(self, root: Node) -> list[tuple[int, bool]]:
        """(node number, has it the same text) for nodes with text; empty for copies of the reference page."""
        found = [(self.number[id(x)], x.own == y.own, len(x.own)) for x, y in align(self.root, root) if x.own]
        if sum(n for _, same, n in found if same) >= COPY_SHARE * sum(len(n.own) for n in self.nodes):
            return []
        return [(k, same) for k, same, _ in found]

    def template(self, root: Node, constant: set[int]) -> set[int]:
        """Identities of the page's nodes that are the host's template."""
        if not constant:
            return set()
        return {id(y) for x, y in align(self.root, root) if self.number[id(x)] in constant and x.own == y.own}


class _Wrappers(dict):
    """The wrappers a worker has used last."""

    def __missing__(self, page: str) -> Wrapper:
        if len(self) >= 200:
            self.clear()
        found = self[page] = Wrapper(page)
        return found


def main_text(page: str, wrapper: Wrapper | None = None, constant: set[int] = frozenset()) -> str:
    """Blocks of the article joined by an empty line; the page without dropped parts if it has no article."""
    root, articles = parse(page)
    template: set[int] = set()
    if wrapper is not None and constant:
        order(root)
        template = wrapper.template(root, constant)
    return "\n\n".join(text for part in articles or [root] for text in blocks(part, template))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, text for every row.

    Null and empty pages have empty text; pages without url or host form one host; a null id or url stays
    null; repeated rows each get a row; an empty table gives an empty one; other columns are not read. A host
    with few pages has no template, so only the marks in the page itself count there. Whole pages are read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    read = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        host.alias("host"),
    )
    references = materialize(
        read.where("html <> ''").groupBy("host").agg(F.min_by("html", F.xxhash64("html")).alias("reference")),
        "wrapper-references",
    )
    held = references.agg(F.coalesce(F.sum(F.octet_length("reference")), F.lit(0))).first()[0]

    def sent(table: DataFrame) -> DataFrame:
        """To every executor if small by measure, else joined by host, where Spark splits a host with many pages."""
        return F.broadcast(table) if held <= BROADCAST_BYTES else table

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers, sums = _Wrappers(), {}
        for batch in slices(batches):
            hosts = texts(batch, "host")
            for h, page, reference in zip(hosts, texts(batch, "html"), texts(batch, "reference"), strict=True):
                root = parse(page)[0]
                order(root)
                for node, same in wrappers[reference].equal(root):
                    aligned, equal = sums.get((h, node), (0, 0))
                    sums[h, node] = aligned + 1, equal + same
            if len(sums) > 50_000:
                yield _counted(sums)
                sums = {}
        yield _counted(sums)

    counted = read.join(sent(references), "host").select("host", "html", "reference")
    constant = (
        counted.mapInArrow(count, "host string, node int, aligned long, equal long")
        .groupBy("host", "node")
        .agg(F.sum("aligned").alias("aligned"), F.sum("equal").alias("equal"))
        .where((F.col("equal") >= CONSTANT_PAGES) & (F.col("equal") >= CONSTANT_SHARE * F.col("aligned")))
        .groupBy("host")
        .agg(F.collect_list("node").alias("constant"))  # at most the nodes of one page
    )
    wrappers_of = materialize(references.join(constant, "host", "left"), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = _Wrappers()
        for batch in slices(batches):
            constants = batch.column(batch.schema.get_field_index("constant")).to_pylist()
            found = [
                main_text(page, wrappers[reference] if some else None, set(some or ()))
                for page, reference, some in zip(
                    texts(batch, "html"), texts(batch, "reference"), constants, strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"]
            )

    joined = read.join(sent(wrappers_of), "host", "left").select("page_id", "url", "html", "reference", "constant")
    return joined.mapInArrow(run, "page_id long, url string, text string")


def _counted(sums: dict[tuple[str, int], tuple[int, int]]) -> pa.RecordBatch:
    hosts, nodes = zip(*sums, strict=True) if sums else ((), ())
    aligned, equal = zip(*sums.values(), strict=True) if sums else ((), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(hosts, pa.string()),
            pa.array(nodes, pa.int32()),
            pa.array(aligned, pa.int64()),
            pa.array(equal, pa.int64()),
        ],
        ["host", "node", "aligned", "equal"],
    )
