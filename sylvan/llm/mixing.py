"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order shuffled by hash, make one stream of words,
repeated up to ``repeats`` times and cut into blocks of ``block`` words. Slot k
of the mix takes the source whose interval of cumulative target shares holds the
golden-ratio point frac((k + 1/2) * phi); the slot that is a source's r-th takes
that source's r-th block. A source's last block is cut where its target ends.
Slots that a source gets beyond its target are left out; slots it lacks (shares
too small for the sequence to have met) follow at the end.

Cases: null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; repeated rows are documents each; no documents
give no rows; other columns are not read. Only DataFrame functions are used.

No window spans a source: running sums and ranks go by (source, bucket) and are
carried over small tables of bucket totals, so a source with a third of all rows
is spread over many tasks. Windows over all sources see one row for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm.common import WORD, materialize, table

#: The golden ratio's fractional part, as a fraction of 2^31: k * STEP mod 2^31 stays in whole numbers.
STEP, SPAN = 1327217885, 1 << 31


@dataclass(frozen=True)
class MixParams:
    block: int = 1024
    repeats: int = 3
    rows_per_bucket: int = 512
    grid: int = 4096
    seed: int = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, repeats: int = 3) -> DataFrame:
    """From (source, size): source_no, source, source_size, weight and target, one row per source.

    Weights 1, 2, 3, repeating; a source stops at ``repeats`` times its size and
    the rest is shared again by weight: the level at which
    sum(min(repeats * size, level * weight)) is the total of all sizes, found by
    running sums over sources ordered by repeats * size / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(everything)).withColumn("weight", ((F.col("source_no") - 1) % 3 + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * repeats).withColumn("at", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    below = Window.orderBy("at", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
    per = per.withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))))
    # capped sources come first in this order; the first whose cap is at or above the level fixes it
    level = F.min(F.when(F.col("at") >= F.col("level"), F.struct("at", "source_no", "level"))).over(whole)["level"]
    return per.withColumn("final", level).select("source_no", "source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _placed(sized: DataFrame, p: MixParams, buckets: int) -> DataFrame:
    """Adds ``start``: where the document begins in its source's shuffled stream."""
    order = F.xxhash64("doc_id", "size", F.lit(p.seed))
    rows = sized.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)))
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    within = Window.partitionBy("source_no", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(totals.select("source_no", "bucket", "base"), ["source_no", "bucket"]).withColumn("start", F.col("base") + F.col("within"))


def _schedule(spark: SparkSession, shares: DataFrame, p: MixParams, slots: int) -> DataFrame:
    """(slot, source_no, rank): which source's rank-th block each slot takes.

    A slot meets the sources whose intervals overlap the grid cell of its point, by an equi-join on the cell.
    """
    drawn = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / p.rows_per_bucket).alias("chunk"), (F.pmod(F.pmod("id", F.lit(SPAN)) * F.lit(STEP) + F.lit(STEP // 2), F.lit(SPAN)) / F.lit(float(SPAN))).alias("point"))
    drawn = drawn.withColumn("cell", F.floor(F.col("point") * p.grid))
    last = F.greatest(F.ceil(F.col("upto") * p.grid) - 1, F.lit(0))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("since") * p.grid), last), last))).select("cell", "since", "upto", "source_no")
    drawn = drawn.join(cells, "cell").where("point >= since and point < upto").select("slot", "chunk", "source_no")
    counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    within = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = drawn.withColumn("within", F.row_number().over(within) - 1).join(counts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("base") + F.col("within")).alias("rank"))
    needed = shares.join(counts.groupBy("source_no").agg(F.sum("n").alias("got")), "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    kept = ranked.join(shares.select("source_no", "need"), "source_no").where("rank < need").select("slot", "source_no", "rank")
    # blocks that the sequence has not met follow, source after source
    lacking = needed.where("got < need").withColumn("lacks", F.col("need") - F.col("got"))
    earlier = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    lacking = lacking.withColumn("base", F.coalesce(F.sum("lacks").over(earlier), F.lit(0)) - F.col("got"))
    lacking = lacking.select("source_no", "base", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    return kept.unionByName(lacking.select((F.lit(slots) + F.col("base") + F.col("rank")).alias("slot"), "source_no", "rank"))


def mix_sources(documents: DataFrame, params: MixParams | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces, sized): pieces are (slot, doc_id, row_no, first, n): the mix in order of slots, each a run of n words of a
    document from word ``first``; sized has a row per document with its source's figures."""
    p, spark = params or MixParams(), documents.sparkSession
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    sized = materialize(sized, "mixing-sizes")  # the texts are read once
    targets = materialize(source_targets(sized, p.repeats), "mixing-targets")
    rows = sized.count()
    buckets = max(16, rows // p.rows_per_bucket)
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = int(total // p.block) + 1
    ordered = Window.orderBy("source_no")
    upto = F.when(F.lead("source_no").over(ordered).isNull(), F.lit(1.0)).otherwise(F.sum("target").over(ordered) / F.lit(max(total, 1.0)))
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * p.repeats)
    shares = targets.withColumn("upto", upto).withColumn("since", F.coalesce(F.lag("upto").over(ordered), F.lit(0.0))).withColumn("quota", quota).withColumn("need", F.ceil(F.col("quota") / p.block).cast("long"))
    sized = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop("source")
    placed = materialize(_placed(sized, p, buckets).withColumn("row_no", F.monotonically_increasing_id()), "mixing-placed")
    schedule = _schedule(spark, shares, p, slots)
    copies = placed.join(shares.select("source_no", "quota"), "source_no").where("size > 0 and quota > 0")
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(p.repeats - 1))))
    copies = copies.withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota"))).where("begin < end")
    blocks = copies.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / p.block), F.floor((F.col("end") - 1) / p.block))))
    low, high = F.greatest(F.col("begin"), F.col("rank") * p.block), F.least(F.col("end"), (F.col("rank") + 1) * p.block)
    blocks = blocks.select("source_no", "rank", "doc_id", "row_no", (low - F.col("begin")).alias("first"), (high - low).alias("n"))
    pieces = schedule.join(blocks, ["source_no", "rank"]).select("slot", "doc_id", "row_no", "first", "n")
    return pieces, placed


def mix_report(documents: DataFrame, params: MixParams | None = None) -> DataFrame:
    """The digest of op8: doc_id, size, source_size, target, taken."""
    pieces, placed = mix_sources(documents, params)
    taken = pieces.groupBy("row_no").agg(F.sum("n").alias("taken"))
    return placed.join(taken, "row_no", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
