"""HTML main-text extraction by wrappers: union-free regular expressions over a host's pages.

A page is a stream of tokens: start tags and end tags of block elements, and runs of text. A start
tag and its end tag bracket a part of the stream, and streams are aligned bracket by bracket, so
that the expression stays balanced. The wrapper of a host grows by aligning one page's stream after
the other's with it, by a longest common subsequence: a text that differs becomes a slot, tokens that one side lacks become an
optional group, and if such a group follows or precedes its like they become a repeated one; alternatives (unions) never
arise, for a list that grows too long becomes a group with a node for
each signature, and the signatures that some page lacks one for each tag once they
are more than 4 * ``longest_list``. Wrappers align with wrappers the same way, so they are built per task
and then put together.

The wrapper decides what is content: from the page down, the element that holds most of the slots' text,
as long as one does, and of it all texts that are not the same on all pages, in page order.
That takes three pages that differ (pages of equal content are copies, and count once). Names are hints: where
that element lies in an article or main element, or one in it holds most of its slots, these elements (teasers of
other pages aside) are the content with all their texts; with fewer pages than three, or no slot, they are too, if there are any. Elements that are by their role
no content (menus, headers, footers, sidebars, notices, adverts, forms, comments)
never are, and their texts count for nothing.

Cases: null or empty html gives an empty text; a page without url, or of a host of
its own, is wrapped alone; truncated markup and unclosed elements end with the
page (unclosed frames, drawings and the like are passed over by their start tag alone); repeated rows each get their row; other columns are not read. Whole pages
are read; nothing is capped. Wrappers are bounded by the size of a page, and are broadcast only
while they are at most ``broadcast_hosts``; beyond that they are joined by host.
"""

from __future__ import annotations

import hashlib
import html as html_entities
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import materialize, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"}
#: Of these, the ones that without an end tag last until the page ends; the others' contents are then read.
RAW_TO_END = {"script", "style", "textarea", "title"}
#: Elements that a slash in the start tag ends.
SELF_CLOSING = {"svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NO_CONTENT = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select"}
NO_CONTENT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "reply", "replies", "share", "sharing", "sidebar", "social", "sponsored", "subscribe", "widget"}
#: Words by which a class speaks of a part that is elsewhere.
LAYOUT_WORDS = {"container", "has", "layout", "no", "page", "with", "without", "wrapper"}
#: Words by which an article speaks of another page; it is left out where the page has an article without them.
TEASER_WORDS = {"promo", "related", "sponsored", "teaser", "teasers"}
#: Elements nested deeper are read as part of the one around them, but for those that are no content.
DEEPEST = 200
#: Start tags that end an open element of the same group.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WORDS = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class WrapperParams:
    longest_list: int = 40
    broadcast_hosts: int = 50_000
    hosts_per_flush: int = 2_000
    merge_salts: int = 64


class Element:
    __slots__ = ("boiler", "children", "depth", "links", "sig", "tag", "teaser")

    def __init__(self, tag: str, sig: str, boiler: bool, teaser: bool = False, depth: int = 0):
        self.tag, self.sig, self.boiler, self.teaser, self.depth = tag, sig, boiler, teaser, depth
        self.children: list[Element | str] = []
        self.links = 0


def parse(page: str) -> Element:
    """The tree of block elements; texts are raw runs between block borders, None-separated by the elements."""
    root = Element("#page", "#page", False)
    # open tags, each with the element that their texts go to
    stack, in_link = [("#page", root)], 0
    text: list[str] = []

    def flush() -> None:
        if text:
            words = html_entities.unescape("".join(text)).split()
            if words:
                stack[-1][1].children.append(" ".join(words))
            text.clear()

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.match(page, at)
        at = found.end() if found.end() > at else at + 1
        slash, name, rest, run = found.groups()
        if run is not None:
            text.append(run)
            stack[-1][1].links += len(run) if in_link else 0
            continue
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if slash else 1
        if name in INLINE:
            continue
        if name == "br":
            text.append(" ")
            continue
        if not slash and name in SELF_CLOSING and rest.endswith("/"):
            flush()
            continue
        if not slash and name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            if close or name in RAW_TO_END:
                after = page.find(">", close.start()) if close else -1
                at = after + 1 if after >= 0 else end
            if name in ("script", "style", "noscript", "template"):
                continue
            flush()
            continue
        flush()
        if name in VOID:
            continue
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if stack[-1][0] in ENDS.get(name, {"p"}):
            stack.pop()
            if name == "tr" and stack[-1][0] == "tr":
                stack.pop()
        named = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(rest)} if rest else {}
        marks = {w for k in ("class", "id") for w in WORDS.findall(named.get(k, ""))}
        around = stack[-1][1]
        inside = name == "header" and any(tag in ("article", "main") for tag, _ in stack)
        boiler = name in NO_CONTENT or (name == "header" and not inside) or bool(marks & NO_CONTENT_WORDS and not marks & LAYOUT_WORDS and name not in ("article", "body", "html", "main")) or named.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search") or (name == "article" and bool(marks & {"comment", "comments", "reply"}))
        if around.depth >= DEEPEST and (around.boiler or not boiler):
            stack.append((name, around))
            continue
        sig = name + "".join("." + w for w in sorted(marks)[:4])
        made = Element(name, sig, boiler, around.teaser or bool(marks & TEASER_WORDS and not marks & LAYOUT_WORDS), around.depth + 1)
        around.children.append(made)
        stack.append((name, made))
    flush()
    return root


# A wrapper node: [sig, flags, pages, text, chars, children], for a run of text (sig "#text") or what an element's tags
# bracket; text is None (an element), a checksum (the same everywhere) or 1 (a slot).
OPTIONAL, REPEATED, BOILER, FOLDED = 1, 2, 4, 8
SLOT = 1


TEXT = "#text"


def mark_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) + 2


def wrapper_of(e: Element, p: WrapperParams) -> list:
    """The expression of one page's tokens."""
    tokens = [[TEXT, 0, 1, mark_of(c), len(c), []] if isinstance(c, str) else wrapper_of(c, p) for c in e.children]
    return [e.sig, BOILER if e.boiler else 0, 1, None, 0, _collapsed(tokens, p)]


def content_mark(root: Element) -> bytes:
    """Equal for pages with equal elements and texts, those aside that are no content."""
    parts: list[str] = []

    def walk(e: Element) -> None:
        parts.append("<" + e.sig)
        for c in e.children:
            if isinstance(c, str):
                parts.append(c)
            elif not c.boiler:
                walk(c)
        parts.append(">")

    walk(root)
    return hashlib.md5("\n".join(parts).encode("utf-8", "replace"), usedforsecurity=False).digest()


def _collapsed(nodes: list[list], p: WrapperParams) -> list[list]:
    """A page's own list stays as it is; one too long has its adjacent repeats as groups and, if still too long, a node for each signature."""
    if len(nodes) > p.longest_list:
        nodes = _adjacent(nodes, p, True)
    return _folded(nodes, p) if len(nodes) > p.longest_list else nodes


def _adjacent(nodes: list[list], p: WrapperParams, always: bool = False) -> list[list]:
    """One, two or three nodes that follow their like, which some page lacks or repeats (or always), become repeated groups."""
    for width in (1, 2, 3):
        out: list[list] = []
        k = 0
        while k < len(nodes):
            before, here = out[-width:], nodes[k : k + width]
            if len(before) == len(here) == width and [n[0] for n in before] == [n[0] for n in here] and (always or any(n[1] & (OPTIONAL | REPEATED) for n in (*before, *here))):
                for i in range(width):
                    out[i - width] = _aligned(before[i], here[i], p, within=True)
                    out[i - width][1] |= REPEATED
                k += width
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return nodes


def _folded(nodes: list[list], p: WrapperParams) -> list[list]:
    """One node for each signature, in no order."""
    by_sig: dict[str, list] = {}
    for n in nodes:
        if n[0] in by_sig:
            by_sig[n[0]] = _aligned(by_sig[n[0]], n, p, within=True)
            by_sig[n[0]][1] |= REPEATED
        else:
            by_sig[n[0]] = n
    return [[n[0], n[1] | FOLDED, *n[2:]] for n in by_sig.values()]


def _united(a: list[list], b: list[list], p: WrapperParams) -> list[list]:
    """Folded lists aligned by signature. Those that not all pages have become one for each tag once they are too many:
    that depends on the pages, not on their order. The others are at most as many as on any page."""
    left, right = ({n[0]: n for n in x} for x in (a, b))
    both = [_aligned(n, right[s], p) for s, n in left.items() if s in right]
    some = [_optional(n) for x, y in ((left, right), (right, left)) for s, n in x.items() if s not in y]
    coarse = [n for n in (*both, *some) if n[0][-2:] in (".*", ".!")]
    optional = [n for n in (*both, *some) if n[1] & OPTIONAL]
    if not coarse and len(optional) <= 4 * p.longest_list:
        return both + some
    tags = [[_coarser(n), n[1], n[2], None if n[3] is None else SLOT, n[4], n[5]] for n in optional]
    if len({n[0] for n in tags}) > 4 * p.longest_list or any(n[0].startswith("*") for n in tags):
        tags = [n if n[0] in ("article.*", "main.*") else ["*" + n[0][-2:], *n[1:]] for n in tags]
    return [n for n in both if not n[1] & OPTIONAL] + [[n[0], n[1] | REPEATED | OPTIONAL, *n[2:]] for n in _folded(tags, p)]


def _coarser(node: list) -> str:
    """The signature of all nodes of a tag that are, or are not, content."""
    return node[0] if node[0][-2:] in (".*", ".!") else node[0].split(".")[0] + (".!" if node[1] & BOILER else ".*")


def _aligned(a: list, b: list, p: WrapperParams, within: bool = False) -> list:
    """One node for two of the same signature, of two pages or, within, of one."""
    text = a[3] if a[3] == b[3] else SLOT
    flags = a[1] | b[1]
    if within:
        text = text if a[3] is None else SLOT
        # a page that has either has the group
        flags &= ~OPTIONAL | (a[1] & b[1])
    return [a[0], flags, max(a[2], b[2]) if within else a[2] + b[2], text, a[4] + b[4], _merged(a[5], b[5], p)]


def _merged(a: list[list], b: list[list], p: WrapperParams) -> list[list]:
    """Two streams aligned by a longest common subsequence of signatures, or by signature where one is too long; what one side lacks is optional."""
    if any(n[1] & FOLDED for n in (*a, *b)):
        return _united(_folded(a, p), _folded(b, p), p)
    begin = end = 0
    while begin < min(len(a), len(b)) and a[begin][0] == b[begin][0]:
        begin += 1
    while end < min(len(a), len(b)) - begin and a[-1 - end][0] == b[-1 - end][0]:
        end += 1
    mid_a, mid_b = a[begin : len(a) - end], b[begin : len(b) - end]
    n, m = len(mid_a), len(mid_b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if mid_a[i][0] == mid_b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [_aligned(x, y, p) for x, y in zip(a[:begin], b[:begin], strict=True)], 0, 0
    while i < n and j < m:
        if mid_a[i][0] == mid_b[j][0]:
            out.append(_aligned(mid_a[i], mid_b[j], p))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(mid_a[i]))
            i += 1
        else:
            out.append(_optional(mid_b[j]))
            j += 1
    out += map(_optional, (*mid_a[i:], *mid_b[j:]))
    out += [_aligned(x, y, p) for x, y in zip(a[len(a) - end :], b[len(b) - end :], strict=True)]
    out = _adjacent(out, p)
    return out if len(out) <= p.longest_list else _united(_folded(a, p), _folded(b, p), p)


def _optional(node: list) -> list:
    return [node[0], node[1] | OPTIONAL, *node[2:]]


def align(a: list | None, b: list, p: WrapperParams) -> list:
    return b if a is None else _aligned(a, b, p)


def content_rule(wrapper: list, least_pages: int = 3, most: float = 0.7) -> dict:
    """Where a wrapper has its content: a path of signatures, and the checksums of texts that are the same on all pages."""
    enough = wrapper[2] >= least_pages
    known: dict[int, int] = {}

    def slots(node: list) -> int:
        """Characters of the texts that are slots, or of all while there are too few pages to tell."""
        if node[1] & BOILER:
            return 0
        if id(node) not in known:
            known[id(node)] = (node[4] if node[3] == SLOT or not enough else 0) + sum(map(slots, node[5]))
        return known[id(node)]

    def search(node: list, tag: str, path: list[str]) -> tuple[list[str], list] | None:
        """The nearest element of that tag below."""
        found = None
        for child in node[5]:
            if not child[1] & BOILER and child[0] != TEXT:
                here = [*path, child[0]]
                got = (here, child) if child[0].split(".")[0] == tag else search(child, tag, here)
                if got and (found is None or len(got[0]) < len(found[0])):
                    found = got
        return found

    whole, path, node = slots(wrapper), [], wrapper
    while whole:
        best = max((c for c in node[5] if not c[1] & BOILER), key=slots, default=None)
        if best is None or best[0] == TEXT or best[1] & REPEATED or slots(best) < most * whole:
            break
        path.append(best[0])
        node = best
    for tag in ("article", "main"):
        on_path = [k for k, sig in enumerate(path) if sig.split(".")[0] == tag]
        if on_path:
            return {"path": path[: on_path[0] + 1], "fixed": []}
        below = search(node, tag, path) if enough and whole else search(wrapper, tag, [])
        if below and (not enough or slots(below[1]) >= most * slots(node)):
            return {"path": below[0], "fixed": []}
    fixed: list[int] = []

    def gather(n: list) -> None:
        if not n[1] & OPTIONAL:
            if n[3] not in (None, SLOT):
                fixed.append(n[3])
            for c in n[5]:
                gather(c)

    if whole and enough:
        here = [wrapper]
        for sig in path:  # a page's elements are found by signatures: others of these have their texts left out
            here = [c for n in here for c in n[5] if c[0] == sig and not c[1] & BOILER]
        for n in here:  # the content itself may be missing on some page
            gather([n[0], n[1] & ~OPTIONAL, *n[2:]])
    return {"path": path, "fixed": fixed}


def main_text(page: str, rule: dict) -> str:
    root = parse(page)

    def at(path: list[str]) -> list[Element]:
        nodes = [root]
        for sig in path:
            nodes = [c for n in nodes for c in n.children if not isinstance(c, str) and c.sig == sig and not c.boiler]
        return nodes

    def every(node: Element, tag: str) -> list[Element]:
        out = []
        for c in node.children:
            if not isinstance(c, str) and not c.boiler:
                out += [c] if c.tag == tag else every(c, tag)
        return out

    fixed = set(rule["fixed"])

    def texts(node: Element, out: list[str]) -> list[str]:
        for c in node.children:
            if isinstance(c, str):
                if not fixed or mark_of(c) not in fixed:
                    out.append(c)
            elif not c.boiler:
                texts(c, out)
        return out

    tag = rule["path"][-1].split(".")[0] if rule["path"] else ""
    nodes = (every(root, tag) if tag in ("article", "main") else at(rule["path"])) or every(root, "article") or every(root, "main") or [root]
    nodes = [n for n in nodes if not n.teaser] or nodes
    return " ".join(t for n in nodes for t in texts(n, []))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?([^/?#:]*)", 1))


def infer_wrappers(pages: DataFrame, params: WrapperParams | None = None) -> DataFrame:
    """(host, rule, pages): each host's content rule, from all its pages."""
    p = params or WrapperParams()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], bytes] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    root = parse(page)
                    key = host, content_mark(root)
                    if key not in held:
                        held[key] = json.dumps(wrapper_of(root, p)).encode()
                    if len(held) > p.hosts_per_flush:
                        yield pages_packed(held)
                        held = {}
        if held:
            yield pages_packed(held)

    def pages_packed(held: dict[tuple[str, bytes], bytes]) -> pa.RecordBatch:
        hosts, marks = zip(*held, strict=True)
        columns = [pa.array(hosts, pa.string()), pa.array([zlib.compress(w, 1) for w in held.values()], pa.binary()), pa.array(marks, pa.binary()), pa.array([m[0] % p.merge_salts for m in marks], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "wrapper", "mark", "salt"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Wrappers of a host, one after the other; of those with one mark, which are copies, the first."""
        host, held, last = None, None, None
        for batch in batches:
            marks = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for name, packed, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), marks, strict=True):
                if name != host and host is not None:
                    yield _packed({host: held})
                    held = None
                if held is None or mark is None or mark != last:
                    held = align(held, json.loads(zlib.decompress(packed)), p)
                host, last = name, mark
        if host is not None:
            yield _packed({host: held})

    def rules(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [json.dumps(content_rule(json.loads(zlib.decompress(x)))) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "rule"])

    schema = "host string, wrapper binary"
    parts = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(build, f"{schema}, mark binary, salt int")
    # copies of a page have one mark, so one salt
    parts = parts.repartition("host", "salt").sortWithinPartitions("host", "mark").select("host", "wrapper", "mark").mapInArrow(merge, schema)
    whole = parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merge, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(rules, batches)

    return whole.mapInArrow(run, "host string, rule string")


def _packed(held: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([zlib.compress(json.dumps(w).encode(), 1) for w in held.values()], pa.binary())], names=["host", "wrapper"])


NO_RULE = {"path": [], "fixed": []}


def extract_main_text(pages: DataFrame, params: WrapperParams | None = None) -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    p = params or WrapperParams()
    rules = materialize(infer_wrappers(pages, p), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = "page_id long, url string, text string, n_chars long"

    def out(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        texts = [main_text(x, r) if x else "" for x, r in zip(batch.column(2).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if rules.count() <= p.broadcast_hosts:
        shared = pages.sparkSession.sparkContext.broadcast({host: json.loads(rule) for host, rule in rules.toLocalIterator()})

        def by_dict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield out(batch, [shared.value.get(h, NO_RULE) for h in batch.column(3).to_pylist()])

        return rows.withColumn("host", host_of(F.col("url"))).mapInArrow(by_dict, schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield out(batch, [json.loads(r) if r else NO_RULE for r in batch.column(3).to_pylist()])

    return rows.withColumn("host", host_of(F.col("url"))).join(rules, "host", "left").select("page_id", "url", "html", "rule").mapInArrow(joined, schema)


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
