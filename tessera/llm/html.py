"""Main-text extraction with wrappers inferred per host as union-free regular expressions.

A page becomes a stream of block tags and texts, balanced into groups. All pages of a host are aligned one after
another, first in the tasks that read them and then across tasks: equal neighbours fold into a repeated group, a group
that one side lacks becomes optional, texts that differ become a slot, texts that every page has at a place stay
constant. The resulting expression has no alternatives. Where its slots hold the article is the host's region; each
page is read there, without the constants of the host and without the groups that are menus, notices and the like.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small

#: Levels of groups; what lies deeper is read as groups of the last level.
DEPTH = 120
#: Cells of the table for a longest common sequence; longer lists of parts are aligned from left to right.
CELLS = 40_000
#: A text is a constant of the host if every page that has its group has it, and so many pages do.
SUPPORT = 3
#: Pages whose constants are a larger share of the region's text are taken for copies of each other, and keep them.
SHARE = 0.3
#: Wrappers a task holds before it hands them on; parts of one host's wrapper that one task aligns.
HELD, PARTS = 5_000, 64

#: HTML elements by their role (fixed values).
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul head".split())
RAW = frozenset("script style noscript template textarea svg iframe math object".split())
NO_TEXT = frozenset("nav footer aside form button select menu dialog head title option textarea".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: An open element that a new one of these ends (p also ends at any other block).
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl div section article body html select main".split())
#: Names (of a class, id or role) of groups beside the article.
BESIDE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup sidebar widget nav navbar navigation menu breadcrumb breadcrumbs comment comments disqus reply replies respond share sharing social related recommended footer masthead login pagination pager toolbar skip".split())
INSIDE = ("article", "content", "post", "entry", "story", "main")

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_SHORT_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
_NAME = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW_END = {t: re.compile(rf"(?i)</{t}\b[^>]*>?") for t in RAW}


@dataclass
class Node:
    """A group of a page, or of a wrapper: there `fixed` has the texts that all pages have (hash: length), and `slot` says whether others occur."""

    tag: str
    names: tuple[str, ...] = ()
    children: list = field(default_factory=list)  # Nodes and, in a page, texts
    optional: bool = False
    repeated: bool = False
    fixed: dict[int, int] = field(default_factory=dict)
    slot: bool = False
    pages: int = 1
    chars: int = 0

    @property
    def label(self) -> str:
        return ".".join((self.tag, *self.names))

    def beside(self, in_article: bool) -> bool:
        if self.tag in NO_TEXT or (self.tag == "header" and not in_article):
            return True
        return any(w in BESIDE for n in self.names for w in re.split(r"[-_]+", n.lower()))


def tokens(page: str):
    """('open', tag, names), ('close', tag), ('text', text); comments, declarations and raw elements are left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ()
            return
        if lt > at:
            yield "text", page[at:lt], ()
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _SHORT_TAG.match(page, lt)
        if not m:
            yield "text", "<", ()
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            yield "close", tag, ()
        elif tag in RAW and not m[3].endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        else:
            names = () if not m[3] else tuple(w for x in _NAME.finditer(m[3]) for w in (x[2] or x[3] or x[4] or "").split())
            yield "open", tag, names


def tree(page: str) -> Node:
    """The page's blocks as nested groups. Inline marks vanish, a line break is a blank, missing ends are supplied."""
    root = Node("page")
    stack = [root]
    for kind, value, names in tokens(page):
        if kind == "text":
            stack[-1].children.append(value)
        elif value == "br" or (value in VOID and value != "hr"):
            if value == "br":
                stack[-1].children.append(" ")
        elif value not in BLOCKS and value != "button":
            continue
        elif kind == "open":
            if value in BLOCKS and stack[-1].tag == "p":
                stack.pop()
            for i in range(len(stack) - 1, 0, -1):
                if value in SIBLINGS.get(stack[i].tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
            node = Node(value, names)
            if len(stack) > DEPTH:
                # its texts go to the group of the last level, between borders, unless it is beside the article
                if not node.beside(True):
                    stack[-1].children.append(Node("hr"))
                    node.children = stack[-1].children
            else:
                stack[-1].children.append(node)
            if value != "hr":
                stack.append(node)
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == value:
                    if i > DEPTH and stack[i].children is stack[i - 1].children:
                        stack[i].children.append(Node("hr"))
                    del stack[i:]
                    break
    return root


def _block(run: list[str]) -> str:
    """The text of a block: character references decoded, white space as one blank."""
    return " ".join(entities.unescape("".join(run)).split())


def _name(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def folded(node: Node) -> Node:
    """The group's expression: its texts, and its groups with neighbours of one label as one repeated group."""
    out, run = Node(node.tag, node.names), []

    def close():
        if text := _block(run):
            out.fixed[_name(text)] = len(text)
            out.chars += len(text)
        run.clear()

    for c in node.children:
        if isinstance(c, str):
            run.append(c)
            continue
        close()
        _put(out.children, folded(c))
    close()
    return out


def _put(parts: list[Node], new: Node) -> None:
    """Append a group; beside one of its label it becomes part of a repeated group."""
    if parts and parts[-1].label == new.label:
        parts[-1] = _merged(parts[-1], new, False)
        parts[-1].repeated = True
    else:
        parts.append(new)


def _pairs(x: list[Node], y: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Parts of two groups side by side, equal labels together, in the order of both."""
    head = 0
    while head < min(len(x), len(y)) and x[head].label == y[head].label:
        head += 1
    out: list = list(zip(x[:head], y[:head], strict=True))
    x, y = x[head:], y[head:]
    n, m = len(x), len(y)
    if n * m > CELLS:
        at, j = defaultdict(list), 0
        for k, c in enumerate(y):
            at[c.label].append(k)
        for c in x:
            places = at.get(c.label, ())
            k = bisect_left(places, j)
            if k < len(places):
                out += [(None, q) for q in y[j : places[k]]]
                out.append((c, y[places[k]]))
                j = places[k] + 1
            else:
                out.append((c, None))
        return out + [(None, q) for q in y[j:]]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].label == y[j].label else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i].label == y[j].label:
            out.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append((x[i], None))
            i += 1
        else:
            out.append((None, y[j]))
            j += 1
    return out


def _merged(a: Node, b: Node, across: bool) -> Node:
    """One expression for two groups of a label: across pages texts that differ become a slot, within a page texts add up."""
    out = Node(a.tag, a.names, [], a.optional or b.optional, a.repeated or b.repeated, chars=a.chars + b.chars)
    if across:
        out.fixed = {k: v for k, v in a.fixed.items() if k in b.fixed}
        out.slot = a.slot or b.slot or a.fixed.keys() != b.fixed.keys()
        out.pages = a.pages + b.pages
    else:
        out.fixed, out.slot, out.pages = a.fixed | b.fixed, a.slot or b.slot, min(a.pages, b.pages)
    for p, q in _pairs(a.children, b.children):
        if p is None or q is None:
            one = p or q
            one.optional = True
            _put(out.children, one)
        else:
            _put(out.children, _merged(p, q, across))
    return out


def aligned(a: Node, b: Node) -> Node:
    """One expression for the wrappers of two sets of pages; the longest common sequence of parts is kept, the rest is optional."""
    return _merged(a, b, True)


def expression(node: Node) -> str:
    """The wrapper in words: <label>parts</label> with + for repeated and ? for optional groups, = for constants, # for a slot."""
    inner = "=" * bool(node.fixed) + "#" * node.slot + "".join(map(expression, node.children))
    return f"(<{node.label}>{inner}</{node.tag}>)" + "+" * node.repeated + "?" * node.optional


def infer(pages: list[str]) -> Node:
    wrapper = None
    for p in pages:
        one = folded(tree(p))
        wrapper = one if wrapper is None else aligned(wrapper, one)
    return wrapper or Node("page")


def _packed(node: Node) -> list:
    return [node.tag, node.names, [_packed(c) for c in node.children], node.optional, node.repeated, list(node.fixed.items()), node.slot, node.pages, node.chars]


def _unpacked(x: list) -> Node:
    tag, names, children, optional, repeated, fixed, slot, pages, chars = x
    return Node(tag, tuple(names), [_unpacked(c) for c in children], optional, repeated, dict(map(tuple, fixed)), slot, pages, chars)


def _holds_article(label: str) -> bool:
    tag, *names = label.split(".")
    return tag in ("article", "main") or any(w in INSIDE for n in names for w in re.split(r"[-_]+", n.lower()))


def region(wrapper: Node) -> list[str]:
    """Labels from the top to the group that holds the article: an article or main element, or one named so, or the
    deepest group that most of the slots beside no menu or notice are in. Without any slot all texts count."""
    found: list[tuple[int, int, list[str]]] = []

    def varies(node: Node, inside: bool) -> bool:
        return node.slot or any(varies(c, inside or c.tag in ("article", "main")) for c in node.children if not c.beside(inside))

    every = not varies(wrapper, False)

    def walk(node: Node, path: list[str], inside: bool) -> int:
        slots = int(node.slot or (every and bool(node.fixed)))
        for c in node.children:
            if not c.beside(inside):
                own = [*path, c.label]
                k = walk(c, own, inside or c.tag in ("article", "main")) * (3 if c.repeated else 1)
                slots += k
                rank = 0 if c.tag == "article" else 1 if c.tag == "main" else 2 if _holds_article(c.label) else 3
                if rank < 3 and k:
                    found.append((rank, len(own), own))
        return slots

    walk(wrapper, [], False)
    if found:
        return min(found, key=lambda f: f[:2])[2]
    node, path = wrapper, []
    while True:
        groups = [(walk(c, [], True), c) for c in node.children if not c.beside(False)]
        total = walk(node, [], True)
        best = max(groups, key=lambda g: g[0], default=(0, None))
        if best[1] is None or best[1].repeated or best[0] * 2 <= total or best[1].tag not in SCOPES:
            return path
        node = best[1]
        path.append(node.label)


def constants(wrapper: Node, where: list[str]) -> list[int]:
    """Names (of path and text) of the texts in the region that are the host's and not an article's; none if the pages are copies."""
    out, held, total = [], 0, 0

    def walk(node: Node, path: list[str], inside: bool) -> None:
        nonlocal held, total
        within = path[: len(where)] == where
        if within:
            total += node.chars
            if node.pages >= SUPPORT:
                held += node.pages * sum(node.fixed.values())
                out.extend(_at_place(path, k) for k in node.fixed)
        for c in node.children:
            own = [*path, c.label]
            if (within or own == where[: len(own)]) and not c.beside(inside):
                walk(c, own, inside or _holds_article(c.label))

    walk(wrapper, [], any(map(_holds_article, where)))
    return out if held <= SHARE * total else []


def _at_place(path: list[str], text: int) -> int:
    return (zlib.crc32("/".join(path).encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 + text) & 0x7FFFFFFFFFFFFFFF


def extract(page: str | None, where: list[str], fixed: frozenset[int] = frozenset()) -> str:
    """The text of the page's region without the host's constants, or of the region found in the page itself where it has none such."""
    if not page:
        return ""
    root = tree(page)
    tops = _at(root, where)
    if not tops:
        where = region(folded(root))
        tops = _at(root, where) or [(root, [])]
    blocks: list[str] = []
    for top, path in tops:
        _blocks(top, path, any(map(_holds_article, [*where, *path])), fixed, blocks)
    return "\n\n".join(blocks)


def _at(root: Node, where: list[str]) -> list[tuple[Node, list[str]]]:
    """The groups at a path of labels, with their own; the tags alone must agree on the way, the names too in the end."""
    found = [(root, [])] if where else []
    for k, label in enumerate(where):
        last, tag = k == len(where) - 1, label.split(".")[0]
        found = [(c, [*path, c.label]) for node, path in found for c in node.children if isinstance(c, Node) and (c.label == label or (c.tag == tag and (not last or c.tag in ("article", "main"))))]
    return found


def _blocks(top: Node, path: list[str], in_article: bool, fixed: frozenset[int], out: list[str]) -> None:
    """Texts between block borders in page order, without the host's constants."""
    run: list[str] = []
    path = list(path)

    def close():
        if (text := _block(run)) and not (fixed and _at_place(path, _name(text)) in fixed):
            out.append(text)
        run.clear()

    stack = [iter(top.children)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                run.append(c)
                continue
            close()
            if not c.beside(in_article):
                stack.append(iter(c.children))
                path.append(c.label)
                break
        else:
            close()
            stack.pop()
            if stack:
                path.pop()


def _hosted(pages: DataFrame, url_col: str) -> DataFrame:
    return pages.withColumn("_host", F.coalesce(F.lower(F.regexp_extract(url_col, r"^[^:/?#]+://([^/?#]*)", 1)), F.lit("")))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, region, fixed): the expression inferred from all pages of each host.

    Each task aligns the pages that it reads; what tasks have found is aligned in groups of up to PARTS, and then once
    more, so a host with any share of the pages sends one wrapper a task and not its pages.
    """
    hosted = _hosted(pages.select(F.col(url_col).alias("_url"), F.col(html_col).alias("_html")), "_url").where(F.length("_html") > 0).select("_host", "_html")

    def one(batches):
        pid, n, own = TaskContext.get().partitionId(), 0, {}

        def rows():
            nonlocal n
            n += 1
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([pid << 20 | n] * len(own), pa.int64()), pa.array([json.dumps(_packed(w)) for w in own.values()], pa.string())], names=["host", "part", "packed"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = folded(tree(page.as_py()))
                own[host] = aligned(own[host], w) if host in own else w
                if len(own) >= HELD:
                    yield rows()
                    own.clear()
        yield rows()

    def join(group: pa.Table) -> Node:
        order = sorted(zip(group.column("part").to_pylist(), group.column("packed").to_pylist(), strict=True))
        wrapper = None
        for _, x in order:
            w = _unpacked(json.loads(x))
            wrapper = w if wrapper is None else aligned(wrapper, w)
        return wrapper

    def some(group: pa.Table) -> pa.Table:
        return pa.table({"host": [group.column("host")[0].as_py()], "part": [min(group.column("part").to_pylist())], "packed": [json.dumps(_packed(join(group)))]})

    def last(group: pa.Table) -> pa.Table:
        w = join(group)
        where = region(w)
        return pa.table({"host": [group.column("host")[0].as_py()], "wrapper": [expression(w)], "region": [json.dumps(where)], "fixed": pa.array([constants(w, where)], pa.list_(pa.int64()))})

    parts = hosted.mapInArrow(one, "host string, part long, packed string")
    parts = parts.groupBy("host", F.expr(f"(part >> 20) div {PARTS}").alias("_group")).applyInArrow(some, "host string, part long, packed string")
    return parts.groupBy("host").applyInArrow(last, "host string, wrapper string, region string, fixed array<long>")


def main_text(pages: DataFrame, columns: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the given columns, text, n_chars. Null, empty and article-less pages have the empty text.

    Pages without a host are taken as of one host. Rows are handled one by one; repeated pages give repeated rows, an
    empty table none. Groups nested deeper than DEPTH are read as neighbours. Columns of pages that are not asked for
    may have any names.
    """
    found = settle(wrappers(pages, url_col, html_col).select(F.col("host").alias("_host"), "region", "fixed"))
    own = [F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)]
    hosted = _hosted(pages.select(*own, F.col(url_col).alias("_url"), F.col(html_col).alias("_html")), "_url")
    joined = hosted.join(small(found), "_host", "left").select(*(f"_c{k}" for k in range(len(columns))), "_html", "region", "fixed")

    def run(batches):
        for b in batches:
            texts = []
            for p, r, f in zip(b.column(len(columns)), b.column(len(columns) + 1), b.column(len(columns) + 2), strict=True):
                where, fixed = r.as_py(), f.as_py()
                texts.append(extract(p.as_py(), json.loads(where) if where else [], frozenset(fixed or ())))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*columns, "text", "n_chars"])

    return joined.mapInArrow(run, pages.select(*columns).schema.add("text", "string").add("n_chars", "long"))
