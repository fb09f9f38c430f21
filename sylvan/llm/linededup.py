"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines of at least ``least_chars`` characters that are equal, or within ``errors``
edits, are copies; shorter ones, from ``least_equal`` characters on and not blank, are
copies if they are equal. Of each connected group the first line in order of (doc_id,
hash of the text, line number) stays. op6_linededup and the pipeline set ``least_equal`` to 1 (ALL_LINES): in
a few characters, two edits make another line, so these need equality. A line is cut into errors + 1 segments: a line within the
distance holds one of them unchanged, at a place that its length bounds. So each
distinct line is indexed under its segments and probes, for every length it may
meet, the few substrings at those places. What meets, and whose counts of
characters are close enough, is verified by a banded
bit-parallel automaton: one machine word of 2 * errors + 1 diagonals for each
number of errors, advanced by bit operations over the line's characters.

Cases: null text stays null, without lines; blank lines and lines shorter than both bounds
stay where they are; a document all of whose lines go stays with an empty text here (the
pipeline leaves out documents that keep no line but blank ones); a null doc_id is last in order. A document
is a doc_id, null too, with a text: rows that repeat a doc_id with other texts are documents each and lose
their own copies only; rows that repeat both are one document, cleaned alike. Other columns are not read, and of the caller's
columns only text changes (and those named like a column added here are replaced). Lines and texts are told
apart by 128 bits of hash; only the search for near lines goes by 64, and its pairs are verified.

Texts are shuffled once, at the end. Of the lines, only hashes move; a verified
line's text is found again through a bitmap of fixed size of the lines wanted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm.common import discard, free_shuffles, materialize, table, wanted_rows
from sylvan.llm.jaccard import components

#: 16 classes of characters, of about equal use in European languages.
BAG = ("eE", "aA", "nN", "tT", "iI", "oO", "rR", "sS", "hH", "lL", "dD", "cC", "uU", "bBfFgGjJkK", "mMpPqQvVwWxXyYzZ", " ")

#: A line that has more than white space.
NOT_BLANK = r"\S"


@dataclass(frozen=True)
class LineParams:
    errors: int = 2
    least_chars: int = 25
    #: Characters of the shortest lines that go as exact copies; above least_chars it changes nothing.
    least_equal: int = 25


#: Exact copies go at any length.
ALL_LINES = LineParams(least_equal=1)


#: The encoding in which each character takes as many bytes: parts of a line are then cut out without counting through its characters.
WIDE, WIDTH = "UTF-32", 4


def _cut(line: Column, at: Column, size: Column, width: int) -> Column:
    """``size`` characters from number ``at``, from 0; a line in WIDE has a width of WIDTH, a string one of 1."""
    return F.substring(line, at * width + 1, size * width)


def _segment_keys(line: Column, length: Column, p: LineParams, width: int = 1) -> Column:
    """Hashes of (length, segment number, segment): the index side."""
    k = p.errors + 1
    keys = []
    for i in range(k):
        start, end = F.floor(length * i / k), F.floor(length * (i + 1) / k)
        keys.append(F.xxhash64(length, F.lit(i), _cut(line, start.cast("int"), (end - start).cast("int"), width)))
    return F.array(*keys)


def _probe_keys(line: Column, length: Column, p: LineParams, width: int = 1) -> Column:
    """Hashes under which lines of this length or up to ``errors`` shorter may be indexed.

    If segment i is the first unchanged one, at most i edits came before it and at
    most errors - i after it: its place differs by at most i from its own, and by at most
    errors - i from its own moved by the difference in length.
    """
    k, keys = p.errors + 1, []
    for less in range(k):
        n = length - less
        for i in range(k):
            start, size = F.floor(n * i / k), F.floor(n * (i + 1) / k) - F.floor(n * i / k)
            for move in range(max(-i, less - (p.errors - i)), min(i, less + (p.errors - i)) + 1):
                at = (start + move).cast("int")
                keys.append(F.when((at >= 0) & (at + size <= length) & (n >= p.least_chars), F.xxhash64(n, F.lit(i), _cut(line, at, size.cast("int"), width))))
    return F.array(*keys)


def within_edits(a: Column, b: Column, errors: int) -> Column:
    """True where the edit distance of two non-empty strings is at most ``errors``.

    Bit d of row e: the first i characters of a can become the first i + d - errors of b with at most e edits.
    """
    width = 2 * errors + 1
    band = (1 << width) - 1
    # b behind ``errors`` characters that match nothing, so that the band's characters are one slice
    other = F.concat(F.array_repeat(F.lit(""), errors), F.split(b, ""), F.array_repeat(F.lit(""), errors + 1))
    start = F.struct(*[F.lit((((1 << (errors + e + 1)) - 1) >> errors << errors) & band).alias(f"r{e}") for e in range(errors + 1)])

    def matches(chars: Column, c: Column, i: Column) -> Column:
        """The diagonals on which b has this character of a."""
        same = F.lit(0)
        for d in range(width):
            same = same.bitwiseOR(F.when(F.get(chars, i + d) == c, F.lit(1 << d)).otherwise(0))
        return same

    def step(state: Column, same: Column) -> Column:
        rows, made = [], None
        for e in range(errors + 1):
            row = state[f"r{e}"].bitwiseAND(same)
            if e:
                before = state[f"r{e - 1}"]
                row = row.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(made, 1)).bitwiseAND(F.lit(band))
            made = row
            rows.append(row.alias(f"r{e}"))
        return F.struct(*rows)

    # a list of one, so that b is cut up once
    last = F.transform(F.array(other), lambda chars: F.aggregate(F.transform(F.split(a, ""), lambda c, i: matches(chars, c, i)), start, step)[f"r{errors}"])[0]
    gap = F.char_length(b) - F.char_length(a) + errors
    return F.when(gap.between(0, 2 * errors), F.call_function("shiftright", last, gap).bitwiseAND(F.lit(1)) == 1).otherwise(False)


def _bag(line: Column) -> Column:
    """How often each of BAG's classes of characters occurs, modulo 16, in 4 bits each."""
    size, out = F.char_length(line), F.lit(0).cast("long")
    for k, chars in enumerate(BAG):
        n = (size - F.char_length(F.translate(line, chars, ""))).cast("long").bitwiseAND(F.lit(15))
        out = out.bitwiseOR(F.shiftleft(n, 4 * k))
    return out


def _bag_distance(a: Column, b: Column) -> Column:
    """At most twice the edit distance: an edit changes the numbers of two classes by one."""
    out = F.lit(0)
    for k in range(len(BAG)):
        apart = F.abs(F.shiftright(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * k).bitwiseAND(F.lit(15)))
        out = out + 8 - F.abs(8 - apart)  # the lesser of apart and 16 - apart
    return out


def _hashes(value: str) -> list[Column]:
    """128 bits of a string column."""
    return [F.xxhash64(value), F.xxhash64(value, F.lit(7))]


def _lines(documents: DataFrame, p: LineParams) -> DataFrame:
    """The lines that may go: (t1, t2) is the text they are of, (h1, h2) the line itself."""
    # the text's hashes in a step of their own: beside posexplode they would be made again for each line
    rows = documents.select("doc_id", "text", *(h.alias(f"t{k + 1}") for k, h in enumerate(_hashes("text"))))
    rows = rows.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    chars = F.col("chars")
    wanted = chars >= p.least_chars
    if p.least_equal < p.least_chars:
        wanted = wanted | ((chars >= p.least_equal) & F.col("line").rlike(NOT_BLANK))
    rows = rows.withColumn("chars", F.char_length("line")).where(wanted)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2", "line_no")
    return rows.select(*(h.alias(f"h{k + 1}") for k, h in enumerate(_hashes("line"))), place.alias("at"), "chars", "line")


def duplicate_lines(documents: DataFrame, params: LineParams | None = None) -> DataFrame:
    """(doc_id, t1, t2, drops): numbers, from 0, of the lines of each document that are copies of a line that stays."""
    p = params or LineParams()
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = _lines(documents, p)
    long = F.col("chars") >= p.least_chars
    # Spark makes no code for functions over lists, and leaves a step that has one out of the method that it makes of a whole stage: so
    # the keys go to small methods, which the JVM compiles. Inside such a function they would not be compiled at all.
    in_small_methods = F.exists(F.array("chars"), lambda chars: chars >= p.least_chars)
    keys = [F.when(in_small_methods, k(F.col("wide"), F.col("chars"), p, WIDTH)).alias(name) for name, k in (("own", _segment_keys), ("probes", _probe_keys))]
    coded = lines.withColumn("wide", F.encode("line", WIDE)).select("h1", "h2", "at", *keys)
    distinct = coded.groupBy("h1", "h2").agg(F.min(F.struct("at", "own", "probes")).alias("first"), F.count("*").alias("copies"))
    distinct = materialize(distinct.select("h1", "h2", "copies", "first.*"), "lines-distinct")
    index = distinct.select("h1", F.lit(True).alias("own"), F.explode("own").alias("key"))
    probes = distinct.select("h1", F.lit(False).alias("own"), F.explode("probes").alias("key")).where("key is not null")
    cell = Window.partitionBy("key")
    several = (F.min("h1").over(cell) < F.max("h1").over(cell)) & F.max("own").over(cell)
    cells = index.unionByName(probes).withColumn("several", several).where("several").drop("several")
    cells = materialize(cells, "lines-cells")
    free_shuffles(documents.sparkSession)
    wanted = cells.select("h1").distinct()
    texts = wanted_rows(lines.where(long).select("h1", "h2", "line"), wanted, "h1").dropDuplicates(["h1", "h2"])
    texts = materialize(texts.withColumn("bag", _bag(F.col("line"))), "lines-texts")
    free_shuffles(documents.sparkSession)
    bags = cells.join(texts.select("h1", "bag"), "h1")
    close = F.col("i.h1") != F.col("p.h1")
    close = close & (_bag_distance(F.col("i.bag"), F.col("p.bag")) <= 2 * p.errors)
    met = bags.where("own").alias("i").join(bags.where("not own").alias("p"), (F.col("i.key") == F.col("p.key")) & close)
    met = materialize(met.select(F.least("i.h1", "p.h1").alias("a"), F.greatest("i.h1", "p.h1").alias("b")).distinct(), "lines-met")
    discard(cells)
    sides = [texts.select(F.col("h1").alias(x), F.struct("h1", "h2").alias(f"n{x}"), F.col("line").alias(f"l{x}")) for x in "ab"]
    pairs = met.join(sides[0], "a").join(sides[1], "b")
    links = materialize(pairs.where(within_edits(F.col("la"), F.col("lb"), p.errors)).select(F.col("na").alias("a"), F.col("nb").alias("b")), "lines-links")
    discard(met)
    discard(texts)
    free_shuffles(documents.sparkSession)
    groups = components(links).select("node.*", "component")
    near = distinct.select("h1", "h2", "at").join(groups, ["h1", "h2"])
    keeps = near.groupBy("component").agg(F.min("at").alias("keep"))
    near = near.join(keeps, "component").select("h1", "h2", "keep")
    equal = distinct.where("copies > 1").select("h1", "h2", F.col("at").alias("keep")).join(near, ["h1", "h2"], "left_anti")
    decided = materialize(near.unionByName(equal), "lines-decided")
    discard(distinct)
    discard(links)
    free_shuffles(documents.sparkSession)
    everywhere = lines.select("h1", "h2", "at").join(decided, ["h1", "h2"]).where("at <> keep").select("at.*")
    return everywhere.groupBy("doc_id", "t1", "t2").agg(F.collect_set("line_no").alias("drops"))


def dedup_lines(documents: DataFrame, params: LineParams | None = None) -> DataFrame:
    """The documents with the copies taken out of text, and n_lines, n_dropped and n_left: the number of lines that are
    not blank, of any length, that stayed in a document that lost some."""
    p = params or LineParams()
    drops = duplicate_lines(documents, p)
    key = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), key.isNull().alias("unnamed"), F.coalesce(key, F.lit(0)).alias("doc_id"), text.alias("text"))
    rows = rows.select("row", "unnamed", "doc_id", *(h.alias(f"t{k + 1}") for k, h in enumerate(_hashes("text"))))
    drops = drops.select(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "t1", "t2", F.array_sort("drops").alias("drops"))
    both = rows.join(drops, ["unnamed", "doc_id", "t1", "t2"], "left")
    text = F.col("row").getField("text").cast("string")
    drops = F.col("drops")
    # what stands between one line that goes and the next: each line is copied once, however many go; lists of one, so that the text is cut up once
    since, until = F.concat(F.array(F.lit(-1)), drops), lambda lines: F.concat(drops, F.array(F.size(lines)))
    runs = F.transform(F.array(F.split(text, "\n")), lambda lines: F.flatten(F.zip_with(since, until(lines), lambda a, b: F.slice(lines, a + 2, b - a - 1))))
    kept = F.when(drops.isNotNull(), runs[0])
    n_lines = F.coalesce(F.size(F.split(text, "\n")), F.lit(0))
    both = both.select("row", "drops", kept.alias("kept"), F.when(text.isNull(), 0).otherwise(n_lines).alias("n_lines"))
    added = {
        "n_lines": F.col("n_lines").cast("long"),
        "n_dropped": F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long"),
        "n_left": F.when(F.col("kept").isNotNull(), F.size(F.filter("kept", lambda x: x.rlike(NOT_BLANK)))).cast("long"),
    }
    named = {c: F.col("row").getField(c) for c in documents.columns if c not in added}
    named["text"] = F.when(F.col("kept").isNull(), named["text"]).otherwise(F.array_join("kept", "\n"))
    return both.select(*(v.alias(c) for c, v in named.items()), *(v.alias(c) for c, v in added.items()))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return dedup_lines(rows, ALL_LINES).select("doc_id", "text", "n_lines", "n_dropped")
