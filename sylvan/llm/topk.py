"""Exact top-k search: columnar branch-and-bound over dimension blocks.

Vectors of a batch lie dimension by dimension (vertical layout). A query adds up
its scores block by block of dimensions; what the rest can still add is at most
|query's rest| * |candidate's rest| (Cauchy-Schwarz), so a candidate whose upper
bound falls below the k-th best lower bound is compacted away. Survivors of the
last block have exact integer scores.

Cases: a vector that is null, empty, or holds a null or non-finite component
takes no part, nor does one with a null id; vectors of different length are not
compared; repeated ids: a query's own id is no candidate of it, and of several
query rows with one id the least vector asks; ties go to the smaller id; tables
without vectors or queries give no rows; scores beyond a long stop at its ends. Other columns are not read.

Queries are the rows whose id is divisible by ``query_step``; they go to the
executors in blocks of at most ``query_block`` (a fixed size bound), one pass
over all rows for each block, and every task sends at most k rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm.common import table

SCALE = 1024
#: Float sums of whole numbers are exact below this.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: Rows that lie side by side in the vertical layout.
BLOCK_ROWS = 8192


def quantized(ids: list, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and vectors floor(SCALE * x), of the rows that take part."""
    lengths = np.asarray(pc.list_value_length(vectors).fill_null(0))
    flat = vectors.flatten()
    values = np.floor(np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64) * SCALE)
    ends = np.cumsum(lengths)
    out = {}
    named = np.array([x is not None for x in ids], bool)
    numbers = np.array([x if x is not None else 0 for x in ids], np.int64)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == n) & named)
        block = values[(ends[rows] - n)[:, None] + np.arange(n)]
        fine = np.isfinite(block).all(axis=1)
        if fine.any():
            out[int(n)] = (numbers[rows[fine]], block[fine])
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


class BlockSearch:
    """The k best rows of each query seen so far, in one task."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, k: int, width: int):
        self.ids, self.k, self.width = queries, k, width
        self.vectors = vectors
        self.rest = np.sqrt(np.cumsum((vectors**2)[:, ::-1], axis=1))[:, ::-1]
        self.top: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        columns = np.ascontiguousarray(rows.T)
        rest = np.sqrt(np.cumsum((columns**2)[::-1], axis=0))[::-1]
        dims = len(columns)
        most = np.abs(columns).max() * np.abs(self.vectors).max() * dims
        whole = most < EXACT
        for q in range(len(self.ids)):
            query, own = self.vectors[q], self.ids[q]
            alive = np.flatnonzero(ids != own)
            score = np.zeros(len(alive))
            held_ids, held = self.top[q]
            floor = float(held.min()) if len(held) == self.k else -np.inf
            for at in range(0, dims, self.width) if whole else ():
                end = min(at + self.width, dims)
                part = columns[at:end] if len(alive) == columns.shape[1] else columns[at:end, alive]
                score += query[at:end] @ part
                if end == dims or len(alive) <= self.k:
                    continue
                slack = self.rest[q, end] * rest[end, alive] * (1 + 1e-9) + 1e-6
                low = score - slack
                bound = max(floor, np.partition(low, len(low) - self.k)[len(low) - self.k])
                keep = score + slack >= bound
                alive, score = alive[keep], score[keep]
            if whole:
                exact = score.astype(np.int64)
            else:  # sums that a double can't hold: whole numbers of any size
                wide = query.astype(object)
                exact = np.array([sum(int(a) * int(b) for a, b in zip(wide, row, strict=True)) for row in rows[alive]], object)
            all_ids, all_scores = np.concatenate([held_ids, ids[alive]]), np.concatenate([held, exact])
            best = _best(all_ids, all_scores, self.k)
            self.top[q] = (all_ids[best], all_scores[best])


def search_block(vectors: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, width: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: BlockSearch(ids, rows, k, width) for n, (ids, rows) in shared.value.items()}
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if held:
                block = pa.Table.from_batches(held).combine_chunks()
                vectors = block.column(1).combine_chunks()
                vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
                for n, (ids, rows) in quantized(block.column(0).to_pylist(), vectors).items():
                    if n in found:
                        found[n].add(ids, rows)
                held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                flush()
        flush()
        for search in found.values():
            parts = [(q, i, s) for q, (ids, scores) in zip(search.ids, search.top, strict=True) for i, s in zip(ids, scores, strict=True)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([max(-LONG, min(LONG, int(p[j]))) for p in parts], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, k: int = 10, query_step: int = 100, query_block: int = 16384, width: int = 16) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = vectors.where((F.col("vec_id") % query_step == 0) & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    parts, held = [], []

    def flush() -> None:
        queries = quantized([x[0] for x in held], pa.array([list(x[1]) for x in held], pa.list_(pa.float64())))
        if queries:
            parts.append(search_block(vectors, queries, k, width))
        held.clear()

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == query_block:
            flush()
    if held:
        flush()
    if not parts:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10
"""
