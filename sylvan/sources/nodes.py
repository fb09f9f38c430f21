"""Trees as tables: documents shredded to node rows, and node rows written back as text.

A node row is (doc_id, node_id, size, level, parent_id, kind, ns, local, prefix,
value, attrs, ns_in_scope, last): node_id counts from 0 in document order, and the
descendants of a node are the ``size`` rows after it; ``last`` is the node_id of the
document's last node. Attributes are a map of the element. Kinds: document, element, text, comment, processing-instruction.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate, chain, pairwise
from urllib.parse import quote
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "doc_id string, node_id int, size int, level int, parent_id int, kind string, ns string, local string, prefix string, value string, attrs map<string,string>, ns_in_scope map<string,string>, last int"
NAMES = ["doc_id", "node_id", "size", "level", "parent_id", "kind", "ns", "local", "prefix", "value", "attrs", "ns_in_scope", "last"]
_ARROW = pa.schema(
    [("doc_id", pa.string()), *((n, pa.int32()) for n in ("node_id", "size", "level", "parent_id")), *((n, pa.string()) for n in ("kind", "ns", "local", "prefix", "value")), ("attrs", pa.map_(pa.string(), pa.string())), ("ns_in_scope", pa.map_(pa.string(), pa.string())), ("last", pa.int32())]
)
#: Rows and characters of text that go to Spark at once, unless one document has more.
ROWS, CHARS = 10_000, 4_000_000
#: HTML elements without content.
HTML_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


@dataclass(frozen=True)
class Output:
    """Serialization parameters."""

    method: str = "xml"
    indent: bool = False
    omit_xml_declaration: bool = True
    encoding: str = "UTF-8"
    standalone: bool | None = None
    doctype_public: str | None = None
    doctype_system: str | None = None
    cdata_section_elements: tuple[str, ...] = ()
    suppress_indentation: tuple[str, ...] = ()
    character_map: tuple[tuple[str, str], ...] = ()
    normalization_form: str | None = None
    byte_order_mark: bool = False
    undeclare_prefixes: bool = False
    escape_uri_attributes: bool = True
    include_content_type: bool = True
    html_version: str = "5"


class _Builder:
    """Node rows of one document, in document order."""

    def __init__(self, doc_id: str, strip_space: bool | tuple[str, ...]):
        self.doc_id, self.strip = doc_id, strip_space
        self.rows: list[list] = []
        self.open: list[int] = []
        self.scopes: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]
        self.spaces = [list(self.scopes[-1].items())]
        self.text: list[str] = []
        self.add("document", "", "", "", None, {})
        self.open.append(0)

    def add(self, kind: str, ns: str, local: str, prefix: str, value: str | None, attrs: dict[str, str]) -> int:
        n = len(self.rows)
        self.rows.append([self.doc_id, n, 0, len(self.open), self.open[-1] if self.open else None, kind, ns, local, prefix, value, list(attrs.items()), self.spaces[-1], 0])
        return n

    def flush(self) -> None:
        if self.text:
            value = "".join(self.text)
            self.text.clear()
            strip = self.rows[self.open[-1]][7] in self.strip if isinstance(self.strip, tuple) else self.strip
            if not strip or value.strip(" \t\r\n"):
                self.add("text", "", "", "", value, {})

    def start(self, name: str, attrs: dict[str, str]) -> None:
        self.flush()
        scope, space = self.scopes[-1], self.spaces[-1]
        if declared := {k[6:]: v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")}:
            scope = scope | declared
            space = list(scope.items())
            attrs = {k: v for k, v in attrs.items() if k != "xmlns" and not k.startswith("xmlns:")}
        self.scopes.append(scope)
        self.spaces.append(space)
        prefix, _, local = name.rpartition(":")
        self.open.append(self.add("element", scope.get(prefix, ""), local, prefix, None, attrs))

    def end(self) -> None:
        self.flush()
        n = self.open.pop()
        self.scopes.pop()
        self.spaces.pop()
        self.rows[n][2] = len(self.rows) - 1 - n

    def leaf(self, kind: str, value: str, local: str = "") -> None:
        self.flush()
        self.add(kind, "", local, "", value, {})

    def done(self) -> list[list]:
        self.flush()
        while len(self.open) > 1:
            self.end()
        self.rows[0][2] = last = len(self.rows) - 1
        for row in self.rows:
            row[12] = last
        return self.rows


def shred_xml(doc_id: str, text: str, strip_space: bool = False) -> list[list]:
    """The rows of one document; malformed text raises FODC0006."""
    b = _Builder(doc_id, strip_space)
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = b.start
    p.EndElementHandler = lambda _: b.end()
    p.CharacterDataHandler = b.text.append
    p.CommentHandler = lambda v: b.leaf("comment", v)
    p.ProcessingInstructionHandler = lambda t, v: b.leaf("processing-instruction", v, t)
    try:
        p.Parse(text.encode("utf-8"), True)
    except expat.ExpatError as e:
        raise ValueError(f"FODC0006: {doc_id}: {e}") from e
    return b.done()


class _Html(HTMLParser):
    def __init__(self, b: _Builder):
        super().__init__(convert_charrefs=True)
        self.b, self.names = b, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.names and tag == self.names[-1] and tag in ("p", "li", "tr", "td", "th", "option"):
            self.handle_endtag(tag)
        self.b.start(tag, {k: v or "" for k, v in dict(attrs).items()})
        self.names.append(tag)
        if tag in HTML_VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.names:
            while self.names:
                self.b.end()
                if self.names.pop() == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.b.text.append(data)

    def handle_comment(self, data: str) -> None:
        self.b.leaf("comment", data)


def shred_html(doc_id: str, text: str, strip_space: bool = True) -> list[list]:
    """The rows of an HTML page, read leniently: what is not closed ends with its parent."""
    b = _Builder(doc_id, strip_space)
    p = _Html(b)
    p.feed(text)
    p.close()
    return b.done()


def shred(df: DataFrame, doc_id: Column, text: Column, html: bool = False, strip_space: bool | tuple[str, ...] = False, lenient: bool = False) -> DataFrame:
    """Node rows of all documents; null texts have none. ``strip_space``: leave out texts of white space, everywhere or
    in the named elements. ``lenient``: malformed documents have none instead of failing."""
    parse = shred_html if html else shred_xml

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for batch in batches:
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if source is None:
                    continue
                try:
                    rows = parse(doc, source, strip_space)
                except ValueError:
                    if not lenient:
                        raise
                    continue
                held += rows
                chars += len(source)
                if len(held) >= ROWS or chars >= CHARS:
                    yield from _row_batches(held)
                    held, chars = [], 0
        yield from _row_batches(held)

    return df.select(doc_id.cast("string").alias("d"), text.cast("string").alias("t")).mapInArrow(run, SCHEMA)


def _row_batches(rows: list[list]) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), ROWS):
        columns = zip(zip(*rows[start : start + ROWS], strict=True), _ARROW, strict=True)
        yield pa.RecordBatch.from_arrays([_maps(c) if pa.types.is_map(f.type) else pa.array(c, f.type) for c, f in columns], schema=_ARROW)


def _maps(column: tuple[list[tuple[str, str]], ...]) -> pa.Array:
    ends = [0, *accumulate(map(len, column))]
    pairs = list(chain.from_iterable(column))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))


def written(nodes: DataFrame) -> DataFrame:
    """The node table written to the folder that driver and executors share (spark.checkpoint.dir; on a single machine a
    temporary one) and read back: documents are parsed once, however many steps read it. Without such a folder it stays as it is."""
    spark = nodes.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            return nodes
        made = tempfile.mkdtemp(prefix="sylvan-nodes-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        shared = f"file://{made}"
    path = f"{shared.rstrip('/')}/nodes-{uuid.uuid4().hex}"
    nodes.write.parquet(path)
    return spark.read.schema(nodes.schema).parquet(path)


def serialize(nodes: DataFrame, output: Output | str = "xml") -> DataFrame:
    """(doc_id, text): each document's rows written as xml, xhtml, html or text; rows of a document are streamed in order."""
    out = Output(output) if isinstance(output, str) else output
    if out.method not in ("xml", "xhtml", "html", "text"):
        raise ValueError(f"SEPM0016: no method {out.method}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, writer, made, chars = None, None, [], 0
        for batch in batches:
            for row in _rows(batch):
                if row["doc_id"] != doc:
                    if writer is not None:
                        made.append((doc, writer.close()))
                        chars += len(made[-1][1])
                        if len(made) >= ROWS or chars >= CHARS:
                            yield _text_batch(made)
                            made, chars = [], 0
                    doc, writer = row["doc_id"], _Writer(out)
                writer.add(row)
        if writer is not None:
            made.append((doc, writer.close()))
        if made:
            yield _text_batch(made)

    rows = nodes.select(*_WRITTEN, F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")).alias("at"))  # deals out and sorts, if that is not done yet
    return rows.mapInArrow(run, "doc_id string, text string")


_WRITTEN = ["doc_id", "node_id", "size", "kind", "local", "prefix", "value", "attrs", "ns_in_scope"]


def _values(column: pa.Array) -> list:
    """As to_pylist(), which is many times slower."""
    if pa.types.is_map(column.type):
        ends, pairs = _values(column.offsets), list(zip(_values(column.keys), _values(column.items), strict=True))
        maps = [pairs[a:b] for a, b in pairwise(ends)]
        return [m if there else None for m, there in zip(maps, _values(column.is_valid()), strict=True)] if column.null_count else maps
    exact = pa.types.is_string(column.type) or not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if exact else column.to_pylist()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    return (dict(zip(names, row, strict=True)) for row in zip(*map(_values, batch.columns), strict=True))


def _text_batch(made: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made, strict=True)], names=["doc_id", "text"])


#: Attributes that hold URIs.
URI_ATTRIBUTES = {"action", "archive", "background", "cite", "classid", "codebase", "data", "href", "longdesc", "profile", "src", "usemap"}
_XML = "http://www.w3.org/XML/1998/namespace"


class _Writer:
    """Writes one document's rows as they come; an element is closed when a row beyond it comes."""

    def __init__(self, o: Output):
        self.o, self.html = o, o.method in ("html", "xhtml")
        self.map = dict(o.character_map)
        self.out = ["\ufeff"] if o.byte_order_mark else []
        if o.method in ("xml", "xhtml") and not o.omit_xml_declaration:
            alone = "" if o.standalone is None else f' standalone="{"yes" if o.standalone else "no"}"'
            self.out.append(f'<?xml version="1.0" encoding="{o.encoding}"{alone}?>')
        self.typed = not (o.doctype_system or o.doctype_public or o.method == "html")
        self.open: list[tuple[int, str]] = []  # last node inside, name
        self.scopes: list[dict[str, str]] = []

    def _text(self, value: str) -> str:
        if self.o.normalization_form:
            value = unicodedata.normalize(self.o.normalization_form, value)
        return "".join(self.map[c] if c in self.map else escape(c) for c in value) if self.map else escape(value)

    def _attribute(self, name: str, value: str) -> str:
        if self.html and self.o.escape_uri_attributes and name in URI_ATTRIBUTES:
            value = "".join(c if " " <= c <= "~" else quote(c) for c in value)
        return f' {name}="{self._text(value).replace(chr(34), "&quot;")}"'

    def _doctype(self, name: str) -> None:
        self.typed = True
        o = self.o
        if o.doctype_public:
            self.out.append(f'<!DOCTYPE {name} PUBLIC "{o.doctype_public}"' + (f' "{o.doctype_system}"' if o.doctype_system else "") + ">")
        elif o.doctype_system:
            self.out.append(f'<!DOCTYPE {name} SYSTEM "{o.doctype_system}">')
        elif o.html_version.startswith("5"):
            self.out.append(f"<!DOCTYPE {name}>")

    def add(self, row: dict) -> None:
        n, kind, o = row["node_id"], row["kind"], self.o
        self._close(n)
        if kind == "document":
            return
        if o.method == "text":
            if kind == "text":
                self.out.append(row["value"])
            return
        inside = self.open[-1][1] if self.open else ""
        if kind == "text":
            raw = o.method == "html" and inside in ("script", "style")
            cdata = inside in o.cdata_section_elements
            self.out.append(row["value"] if raw else "<![CDATA[" + row["value"].replace("]]>", "]]]]><![CDATA[>") + "]]>" if cdata else self._text(row["value"]))
        elif kind == "comment":
            self.out.append(f"<!--{row['value']}-->")
        elif kind == "processing-instruction":
            self.out.append(f"<?{row['local']} {row['value']}{'>' if o.method == 'html' else '?>'}")
        else:
            self._element(row)

    def _element(self, row: dict) -> None:
        o, n = self.o, row["node_id"]
        name = f"{row['prefix']}:{row['local']}" if row["prefix"] else row["local"]
        if not self.typed or (o.method == "html" and not self.open and o.doctype_system is None and name == "html" and not self.out):
            self._doctype(name)
        head = "".join(self._attribute(k, v) for k, v in row["attrs"] or ())
        head = (self._namespaces(row) if o.method != "html" else "") + head
        if o.indent and self.out and not any(x in o.suppress_indentation for _, x in self.open):
            self.out.append("\n" + "  " * len(self.open))
        void = name in HTML_VOID
        if row["size"] == 0 and not (self.html and name == "head"):
            self.out.append(f"<{name}{head}>" if o.method == "html" and void else f"<{name}{head}></{name}>" if self.html and not void else f"<{name}{head}/>")
            return
        self.out.append(f"<{name}{head}>")
        if self.html and name == "head" and o.include_content_type:
            self.out.append(f'<meta http-equiv="Content-Type" content="text/html; charset={o.encoding}"' + (">" if o.method == "html" else "/>"))
        self.open.append((n + row["size"], name))
        self.scopes.append(dict(row["ns_in_scope"] or ()))

    def _namespaces(self, row: dict) -> str:
        here, above = dict(row["ns_in_scope"] or ()), self.scopes[-1] if self.scopes else {"xml": _XML}
        new = "".join(f" xmlns{':' + p if p else ''}={quoteattr(u)}" for p, u in sorted(here.items()) if above.get(p) != u)
        gone = "".join(f' xmlns:{p}=""' for p in sorted(above) if p and p not in here) if self.o.undeclare_prefixes else ""
        return new + gone

    def _close(self, n: int) -> None:
        while self.open and self.open[-1][0] < n:
            self.out.append(f"</{self.open.pop()[1]}>")
            self.scopes.pop()

    def close(self) -> str:
        self._close(1 << 60)
        return "".join(self.out)


def serialize_items(items: DataFrame, column: str, method: str = "json", item_separator: str = "\n", indent: bool = False) -> DataFrame:
    """The text of each row's value as json, or adaptive: strings quoted, maps and arrays in the path language's own form."""
    value = F.col(column)
    kind = items.schema[column].dataType
    if method == "json":
        text = F.to_json(value, {"pretty": str(indent).lower(), "ignoreNullFields": "false"}) if kind.typeName() in ("struct", "map", "array") else F.to_json(F.array(value))
        text = text if kind.typeName() in ("struct", "map", "array") else F.substr(text, F.lit(2), F.char_length(text) - 2)
        return items.withColumn("text", text)
    if method != "adaptive":
        raise ValueError(f"SEPM0016: no method {method}")

    def adaptive(v: Column, t: object) -> Column:
        name = t.typeName()
        if name == "string":
            return F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        if name == "boolean":
            return F.concat(v.cast("string"), F.lit("()"))
        if name == "array":
            return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: adaptive(x, t.elementType)), ","), F.lit("]"))
        if name == "map":
            return F.concat(F.lit("map{"), F.array_join(F.transform(F.map_entries(v), lambda e: F.concat(adaptive(e["key"], t.keyType), F.lit(":"), adaptive(e["value"], t.valueType))), ","), F.lit("}"))
        return v.cast("string")

    return items.withColumn("text", adaptive(value, kind))


def attribute_rows(nodes: DataFrame) -> DataFrame:
    """The attribute axis as rows: the element's key with name and value."""
    return nodes.where("kind = 'element'").select("doc_id", "node_id", F.explode("attrs").alias("name", "value"))
