"""Benchmark decontamination by a generalised suffix automaton over words.

The normalised test items make one automaton; a document's words stream through
it, and the length of the longest match ending at each word says which windows
of the items occur there.

Cases: null or empty text has no words and no hit; an item without words, or
with a null id, is no item; repeated item ids count as one item; repeated
documents each get their row; an empty benchmark hits nothing. Other columns of
either table are not read. Memory: items are taken in blocks of at most
``block_words`` words, one automaton at a time, however large the benchmark is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import append_columns, as_bytes, map_batches, materialize, unused

#: Bytes that are no word characters become a space, A-Z becomes a-z.
_TO_WORDS = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD_SPAN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class WordAutomaton:
    """Suffix automaton of several word sequences, with the windows that end in each state.

    ``windows[v]``: items that hold the ``size`` last words of any match that ends in state v.
    ``shorts[v]``: (length, item) of whole items shorter than ``size`` among the suffixes of state v.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], size: int):
        self.size = size
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, seq in coded:
            last = 0
            for symbol in seq:
                last = self._extend(last, symbol)
        by_window: dict[int, set] = {}
        own_short: dict[int, set] = {}
        for name, seq in coded:
            state = matched = 0
            for symbol in seq:
                state, matched = self.next[state][symbol], matched + 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                    matched = self.length[state]
                if matched >= size:
                    by_window.setdefault(state, set()).add(name)
            if len(seq) < size:
                while self.link[state] >= 0 and self.length[self.link[state]] >= len(seq):
                    state = self.link[state]
                own_short.setdefault(state, set()).add((len(seq), name))
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.windows: list[frozenset] = [frozenset()] * len(order)
        self.shorts: list[tuple] = [()] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.shorts[v] = (*self.shorts[up], *sorted(own_short.get(v, ()), key=str))
            self.windows[v] = frozenset(by_window[v]) if v in by_window else self.windows[up]
        self.least = min([size, *(n for named in own_short.values() for n, _ in named)])

    def _extend(self, last: int, symbol: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(symbol)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._split(last, symbol, known)
        here = self._state({}, -1, length[last] + 1)
        at = last
        while at >= 0 and symbol not in nxt[at]:
            nxt[at][symbol] = here
            at = link[at]
        if at < 0:
            link[here] = 0
        else:
            to = nxt[at][symbol]
            link[here] = to if length[to] == length[at] + 1 else self._split(at, symbol, to)
        return here

    def _state(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, symbol: int, to: int) -> int:
        """A copy of ``to`` for the matches that are one word longer than ``at``."""
        copy = self._state(dict(self.next[to]), self.link[to], self.length[at] + 1)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(symbol) == to:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie inside an occurrence of a window, and the items of those windows."""
        known = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int64, len(words))
        edges = np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long_enough = ends - starts >= self.least
        cover = np.zeros(len(words) + 1, np.int32)
        found: set = set()
        nxt, link, length, size = self.next, self.link, self.length, self.size
        for start, end in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            state = matched = 0
            for at, symbol in enumerate(known[start:end].tolist(), start + 1):
                while state and symbol not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                to = nxt[state].get(symbol)
                if to is None:
                    continue
                state, matched = to, matched + 1
                if matched >= size:
                    found |= self.windows[state]
                    cover[at - size] += 1
                    cover[at] -= 1
                for n, name in self.shorts[state]:
                    if n <= matched:
                        found.add(name)
                        cover[at - n] += 1
                        cover[at] -= 1
        return np.cumsum(cover[:-1]) > 0, found


def _blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[WordAutomaton]:
    items: list[tuple[object, list[bytes]]] = []
    held = 0
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("binary").alias("t")).where("item_id is not null and t is not null")
    for item, text in rows.toLocalIterator():
        words = item_words(bytes(text))
        while words:  # an item beyond a block's size goes on in the next, overlapping by a window
            part, words = words[:block_words], words[block_words - size + 1 :] if len(words) > block_words else []
            items.append((item, part))
            held += len(part)
            if held >= block_words:
                yield WordAutomaton(items, size)
                items, held = [], 0
    yield WordAutomaton(items, size)


def _scanner(shared) -> Callable[[pa.Array], list[pa.Array]]:
    """Of texts: their numbers of words, the packed bits of the words hit (null for none) and the items, sorted."""

    def scan(texts: pa.Array) -> list[pa.Array]:
        index = shared.value
        counts, hits, named = [], [], []
        for text in as_bytes(texts):
            words = item_words(text)
            hit, found = index.scan(words)
            counts.append(len(words))
            hits.append(np.packbits(hit).tobytes() if hit.any() else None)
            named.append(sorted(map(str, found)))
        return [pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(named, pa.list_(pa.string()))]

    return scan


def scan_benchmark(documents: DataFrame, benchmark: DataFrame, size: int = 8, block_words: int = 100_000) -> DataFrame:
    """The documents (with a string column text) with three columns more at the end: bench_words, their number, bench_hits, the
    words hit (a bit per word, packed; null for none) and bench_items (ids as strings, sorted). Where the documents have a
    column of such a name, the new one's name gets an underscore more.

    A benchmark of one block is scanned in one pass. Else the documents are written once, with a number for each row; each
    block's pass writes what it hits and nothing of other rows, and the hits, put together by row, meet the documents at the end.
    """
    sc, columns = documents.sparkSession.sparkContext, documents.columns
    names = [unused(columns, x) for x in ("bench_words", "bench_hits", "bench_items")]
    added = ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "binary", "array<string>"), strict=True))
    blocks = _blocks(benchmark, size, block_words)
    automaton, after = next(blocks), next(blocks, None)
    if after is None:
        return append_columns(documents, ["text"], _scanner(sc.broadcast(automaton)), added)
    row = unused([*columns, *names], "row_no")
    numbered = materialize(documents.withColumn(row, F.monotonically_increasing_id()), "decontamination")
    parts: list[DataFrame] = []
    while automaton is not None:
        shared = sc.broadcast(automaton)
        found = append_columns(numbered.select(row, "text"), ["text"], _scanner(shared), added)
        parts.append(materialize(found.where(F.size(names[2]) > 0).select(row, *names[1:]), "decontamination-hits"))
        shared.destroy()
        automaton, after = after, next(blocks, None)
    hits = reduce(DataFrame.unionByName, parts)
    # a row has at most one part for each block
    hits = hits.groupBy(row).agg(F.collect_list(names[1]).alias("hit_parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names[2])))).alias("item_parts"))
    both = numbered.join(hits, row, "left").drop(row)

    def joined(texts: pa.Array, hit_parts: pa.Array, items: pa.Array) -> list[pa.Array]:
        bits = [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in some]).tobytes() if some else None for some in hit_parts.to_pylist()]
        return [pa.array([len(item_words(t)) for t in as_bytes(texts)], pa.int64()), pa.array(bits, pa.binary()), pa.array([sorted(x or ()) for x in items.to_pylist()], pa.list_(pa.string()))]

    both = append_columns(both, ["text", "hit_parts", "item_parts"], joined, added)
    return both.select(*(F.col(f"`{c}`") for c in (*columns, *names)))


def contamination_report(documents: DataFrame, benchmark: DataFrame, size: int = 8, least_items: int = 2) -> DataFrame:
    """The digest of op10: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = scan_benchmark(rows, benchmark, size)
    names = scanned.columns[-3:]

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in batch.column(2).to_pylist()]
        items = batch.column(3).to_pylist()
        shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        n = pa.array([len(x) for x in items], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), n, pa.array(shas)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    out = map_batches(scanned.select("doc_id", *names), digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_items") >= least_items)


def remove_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without the words that are hit and what stands between two of them."""
    spans = [m.span() for m in _WORD_SPAN.finditer(text)]
    kept, at, k = [], 0, 0
    while k < len(spans):
        if hit[k]:
            kept.append(text[at : spans[k][0]])
            while k + 1 < len(spans) and hit[k + 1]:
                k += 1
            at = spans[k][1]
        k += 1
    kept.append(text[at:])
    return b"".join(kept)


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 8, least_items: int = 2, coverage: float = 0.5) -> DataFrame:
    """The documents (with a string column text) without benchmark passages.

    A document that holds windows of ``least_items`` items, or of whose words more
    than ``coverage`` are hit, goes; in others each hit span is cut out.
    """
    scanned = scan_benchmark(documents, benchmark, size)
    names = scanned.columns[-3:]
    keep_name, text_name = (unused(scanned.columns, x) for x in ("bench_keep", "bench_text"))

    def clean(texts: pa.Array, words: pa.Array, hits: pa.Array, items: pa.Array) -> list[pa.Array]:
        kept, cleaned = [], []
        for text, n, bits, named in zip(texts.to_pylist(), words.to_pylist(), hits.to_pylist(), items.to_pylist(), strict=True):
            keep = True
            if bits:
                hit = np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool)
                keep = len(named) < least_items and hit.sum() <= coverage * n
                text = remove_spans(text.encode(), hit).decode() if keep else ""
            kept.append(keep)
            cleaned.append(text)
        return [pa.array(kept, pa.bool_()), pa.array(cleaned, pa.string())]

    done = append_columns(scanned, ["text", *names], clean, f"{keep_name} boolean, {text_name} string")
    return done.where(keep_name).select(*(F.col(text_name).alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.common import table

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM windows), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
