"""N-gram Jaccard join in metric space: all documents whose shingle sets are within distance 1 - threshold.

Jaccard distance is a metric, and pivots cut its space into regions:

1. First-level pivots are the one-shingle sets, and what parts the data is the window
   of the triangle inequality around them. A document is nearer than 1 to
   the pivots of its own shingles only; of these it is copied into the regions
   of its first floor((1 - t) * n) + 1 shingles, least frequent first: two
   documents within the threshold can't miss each other in all of them (else
   their symmetric difference, a metric too, would be too large). The window is
   narrower on the smaller side of a pair (``short``). In effect this is a prefix filter: between
   documents of natural text almost all distances are 1, so that document pivots alone would
   put nearly all rows into one region.
2. In each region a document is the pivot. A document is compared first with the
   pivot that it shares most regions with (its Voronoi cell), then with those of
   its other regions. What is linked to one pivot needs no comparison within
   itself any more.
3. Regions that still hold several components join recursively with new pivots;
   once their remaining pairs are few for the rows there are, the pairs inside
   the triangle-inequality ring |d(x, p) - d(y, p)| <= 1 - t are compared.

Before that, counts of shingles by hash class refute most pairs that only share a
passage, as they bound the overlap. Every other candidate is verified on whole sets, so the result is exact up to
collisions of 64-bit shingle hashes. Equal sets are one representative from the
start. Frequencies come from a count sketch of fixed size over all documents;
it only orders shingles, and any order gives the same result.

Cases: null or empty text, or white space only: no shingles, linked with nothing;
texts of fewer than ``size`` words are one shingle; a null doc_id has no links and
a null component; rows that repeat a doc_id are one document, linked with whatever one
of its texts is, and each gets a row with its own n_shingles and their common component (but for
one without shingles); no rows give none; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm.common import ROWS, as_bytes, chunks, discard, free_shuffles, map_batches, materialize, table, wanted_rows, words_of

#: Odd multipliers of the rolling mix, and the sketch's sizes.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SKETCH_BITS, SLICES = 20, 64
BINS = 512


@dataclass(frozen=True)
class JoinParams:
    size: int = 5
    percent: int = 80
    #: A region's remaining pairs are compared at once when all regions have at most this many for each row left.
    pairs_per_row: int = 256
    #: Pivots of a region grow by this factor from round to round.
    more_pivots: int = 8


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    m = n - width + 1
    out = np.full(m, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _A + word[k : k + m]
    out = (out ^ (out >> np.uint64(32))) * _B
    return np.unique(out ^ (out >> np.uint64(29)))


def _digests(documents: DataFrame, size: int) -> DataFrame:
    """A row per document (doc_id, n, h1, h2), and per task the slices of its shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in (part for whole in batches for part in chunks(whole, ROWS)):
            ns, marks = [], []
            for text in as_bytes(batch.column(1)):
                found = shingle_set(text, size)
                np.add.at(counts, (found >> shift).astype(np.int64), np.uint32(1))
                ns.append(len(found))
                marks.append(xxhash.xxh3_128_digest(found.tobytes()))
            pairs = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            rows = len(ns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=["doc_id", "n", "h1", "h2", "slice", "counts"])
        parts = [zlib.compress(x.tobytes(), 1) if x.any() else None for x in np.split(counts, SLICES)]
        kept = [i for i, x in enumerate(parts) if x]
        if kept:
            none = pa.nulls(len(kept), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(kept, pa.int32()), pa.array([parts[i] for i in kept], pa.binary())], names=["doc_id", "n", "h1", "h2", "slice", "counts"])

    return documents.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, slice int, counts binary")


def _sketch(digests: DataFrame) -> np.ndarray:
    """The summed counts: 2^SKETCH_BITS numbers, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(part), np.uint32).astype(np.uint64)
                sums[k] = sums[k] + counts if k in sums else counts
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    parts = digests.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary")
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint64)
    for k, counts in parts.collect():
        out[k] += np.frombuffer(counts, np.uint64)
    return np.minimum(out.ravel(), np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _windows(documents: DataFrame, sketch: np.ndarray, p: JoinParams) -> DataFrame:
    """(doc_id, n, shorts, regions): the regions each document is copied into, in order; the first ``shorts`` of them
    are those it needs as the smaller side of a pair."""
    shared = documents.sparkSession.sparkContext.broadcast(sketch)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, shift = shared.value, np.uint64(64 - SKETCH_BITS)
        ns, shorts, parts = [], [], []
        for text in as_bytes(batch.column(1)):
            found = shingle_set(text, p.size)
            n = len(found)
            least = -(-p.percent * n // 100)
            order = np.argsort(counts[(found >> shift).astype(np.int64)], kind="stable")[: n - least + 1] if n else slice(0)
            ns.append(n)
            shorts.append(n - -(-2 * p.percent * n // (100 + p.percent)) + 1)
            parts.append(found[order])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        regions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(shorts, pa.int32()), regions], names=["doc_id", "n", "shorts", "regions"])

    return map_batches(documents, run, "doc_id long, n int, shorts int, regions array<long>")


def _sets(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, bins, shingles): bins counts the shingles by their lowest bits, null where a count needs more than a byte."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [shingle_set(text, size) for text in as_bytes(batch.column(1))]
        counts = [np.bincount((x & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS) for x in parts]
        bins = pa.array([c.astype(np.int8) if c.max() < 128 else None for c in counts], pa.list_(pa.int8()))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in parts], pa.int32()), bins, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], names=["doc_id", "n", "bins", "shingles"])

    return map_batches(documents, run, "doc_id long, n int, bins array<tinyint>, shingles array<long>")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bins allow the overlap: no set is larger in common with another than the sum of its bins' minima."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bins").alias("ba"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("bb"))
    most = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x.cast("int"))
    enough = F.coalesce((100 + percent) * most >= percent * (F.col("na") + F.col("nb")), F.lit(True))
    return pairs.join(one, "a").join(other, "b").where(enough).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, d, linked) of the pairs (a, b)."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    whole = F.size("sa") + F.size("sb") - F.col("both")
    found = pairs.join(one, "a").join(other, "b").select("a", "b", "sa", "sb", both.alias("both"))
    return found.select("a", "b", (1 - F.col("both") / whole).alias("d"), (100 * F.col("both") >= percent * whole).alias("linked"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b), component the smallest node reachable.

    Alternating large and small stars: each round hangs a node's neighbours under
    its smallest one, until every component is one star; rounds grow with the
    logarithm of the longest path.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(stars, "links")
        discard(edges)
        edges = after
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _labelled(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Regions with each document's present component, without regions that hold one component only."""
    regions = regions.drop("label")
    found = regions.join(labels, regions["doc"] == labels["node"], "left").drop("node").withColumn("label", F.coalesce("component", "doc")).drop("component")
    open_ones = found.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("region")
    return found.join(open_ones, "region", "left_semi")


def _pivots(regions: DataFrame, many: int) -> DataFrame:
    """At most ``many`` documents of each region, of different components, those of small components first."""
    best = F.min(F.struct((~F.col("short")).alias("late"), "doc", "n", "pos", "short", "label")).alias("p")
    if many == 1:
        return regions.groupBy("region").agg(best).select("region", "p.*")
    heads = regions.groupBy("region", "label").agg(best, F.count("*").alias("size")).drop("label")
    rank = F.row_number().over(Window.partitionBy("region").orderBy("size", "p.doc"))
    return heads.withColumn("rank", rank).where(F.col("rank") <= many).select("region", "p.*")


def jaccard_components(documents: DataFrame, params: JoinParams | None = None) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    p, spark = params or JoinParams(), documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = materialize(_digests(texts, p.size), "jaccard-digests")
    rows = digests.where("slice is null").select("doc_id", "n", "h1", "h2")
    groups = materialize(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "jaccard-groups")
    windows = _windows(texts, _sketch(digests), p).where("n > 0").join(groups.where("rep is not null"), F.col("doc_id") == F.col("rep"), "left_semi")
    spread = windows.select(F.col("doc_id").alias("doc"), "n", "shorts", F.posexplode("regions").alias("pos", "region")).select("region", "doc", "n", "pos", (F.col("pos") < F.col("shorts")).alias("short"))
    together = Window.partitionBy("region")
    spread = spread.withColumn("k", F.count("*").over(together)).withColumn("any", F.max("short").over(together)).where("k > 1 and any").drop("k", "any")
    regions = materialize(spread, "jaccard-regions")
    free_shuffles(spark)

    def fits(a: str, b: str) -> str:
        """Sizes and positions allow the overlap, and the smaller side is there by its short window."""
        return (
            f"100 * least({a}.n, {b}.n) >= {p.percent} * greatest({a}.n, {b}.n) and if(({a}.n, {a}.doc) <= ({b}.n, {b}.doc), {a}.short, {b}.short)"
            f" and (100 + {p.percent}) * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {p.percent} * ({a}.n + {b}.n)"
        )

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "jaccard-pairs")
        wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        sets = materialize(_sets(wanted_rows(texts, wanted, "doc_id"), p.size), "jaccard-sets")
        near = materialize(_possible(pairs, sets, p.percent), "jaccard-near")
        discard(pairs)
        free_shuffles(spark)
        needed = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
        out = materialize(_verified(near, sets.join(needed, "doc_id", "left_semi"), p.percent), "jaccard-verified")
        discard(near)
        discard(sets)
        free_shuffles(spark)
        return out

    # the different texts of one doc_id are linked
    several = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(*(f(h).alias(f.__name__ + h) for h in ("h1", "h2") for f in (F.min, F.max))).where("minh1 < maxh1 or minh2 < maxh2").select("doc_id")
    labels = components(rows.where("n > 0").join(several, "doc_id").join(groups, ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    current, many = _labelled(regions, labels), 1
    while True:
        # each region's pivots, and the documents that may link to them
        pivots = materialize(_pivots(current, many), "jaccard-pivots")
        near = current.alias("x").join(pivots.alias("p"), "region").where("x.doc <> p.doc and x.label <> p.label and " + fits("x", "p"))
        pairs = materialize(near.groupBy(F.col("x.doc").alias("a"), F.col("p.doc").alias("b")).agg(F.count("*").alias("regions")), "jaccard-near")
        nearest = pairs.groupBy("a").agg(F.max(F.struct("regions", (-F.col("b")).alias("nb"))).alias("best")).select("a", (-F.col("best.nb")).alias("b"))
        known = verified(nearest)
        labels = _linked(labels, known)
        left = current
        if many > 1:  # compare with the other pivots too; then these are done with
            others = verified(_apart(pairs.join(nearest, ["a", "b"], "left_anti").select("a", "b"), labels))
            labels = _linked(labels, others)
            known = known.unionByName(others)
            left = current.join(pivots.select("region", "doc"), ["region", "doc"], "left_anti")
        ring = pivots.select("region", F.col("doc").alias("pivot")) if many == 1 else pivots.groupBy("region").agg(F.min("doc").alias("pivot"))
        known = known.select(F.col("a").alias("doc"), F.col("b").alias("pivot"), "d")
        left = left.drop("d").join(ring, "region").join(known, ["doc", "pivot"], "left").drop("pivot")
        after = materialize(_labelled(left, labels), "jaccard-regions")
        for done in (pairs, pivots, regions):
            discard(done)
        regions = current = after
        free_shuffles(spark)
        many *= p.more_pivots
        per = current.groupBy("region", "label").agg(F.count("*").alias("k")).groupBy("region").agg(F.sum("k").alias("rows"), F.sum(F.col("k") * F.col("k")).alias("own"))
        held = per.agg(F.sum("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("own")) / 2)).first()
        if not held[0]:
            break
        if held[1] <= p.pairs_per_row * held[0]:
            # inside the ring around the region's pivot
            inside = F.expr(f"x.d is null or y.d is null or abs(x.d - y.d) * 100 <= {100 - p.percent} + 1e-6")
            pairs = current.alias("x").join(current.alias("y"), "region").where("x.doc < y.doc and x.label <> y.label and " + fits("x", "y")).where(inside)
            pairs = materialize(pairs.groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).agg(F.count("*").alias("regions")), "jaccard-near")
            # each document's nearest first: what these link needs no more comparing
            nearest = pairs.groupBy("a").agg(F.max(F.struct("regions", (-F.col("b")).alias("nb"))).alias("best")).select("a", (-F.col("best.nb")).alias("b"))
            labels = _linked(labels, verified(nearest))
            labels = _linked(labels, verified(_apart(pairs.join(nearest, ["a", "b"], "left_anti").select("a", "b"), labels)))
            discard(pairs)
            break
    labels = materialize(labels, "jaccard-labels")
    discard(regions)
    named = groups.join(labels, groups["rep"] == labels["node"], "left").select("h1", "h2", F.coalesce("component", "rep").alias("found"))
    out = rows.join(named, ["h1", "h2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("found", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _linked(labels: DataFrame, verified: DataFrame) -> DataFrame:
    """The components after more links: these join the stars that there are."""
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified.where("linked").select("a", "b")))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components so far."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    other = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(one, "a", "left").join(other, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM sides UNION SELECT r.node, s.b FROM reach r JOIN sides s ON r.other = s.a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node, min(other) AS m FROM reach GROUP BY node) ON node = w.doc_id
"""
