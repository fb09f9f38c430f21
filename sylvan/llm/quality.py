"""Quality classification by co-training two views of a document.

One classifier sees the content (hashed words and shapes of words of the text, and measures of it such as its shares of
letters, digits, capitals, symbols and repeated lines). The other sees the page's metadata alone: the columns source, lang
and n_chars, never the text. Each learns from the labelled sample; then in each round it looks at all unlabelled documents
and labels those it is most sure of (``exchanged`` different ones, in the sample's shares of the labels, and only where its
calibrated probability reaches ``sure``) for the other. Both are calibrated on a held-back part of the labelled sample, and
the mean of their log-odds, calibrated again, scores all documents.

Features are made once a document and written to the shared folder; each round and the scoring read them. A round's task
keeps its best ``exchanged`` candidates of either label and view, equal documents once, so that neither groups of copies nor
the size of the pool reach the driver. The models learn in one task.

Cases: null text counts as empty, other nulls (and a missing n_chars column) as a value of their own; null labels
are not used; repeated labels of a document: the lowest counts; without both
labels in the sample every score is the share of label 1 in it (0.5 if empty);
repeated rows each get their row, and count once in the sample and the pool; other columns are not read.

The labelled sample is at most ``labelled`` rows and ``sample_bytes`` bytes of features, those first in a hash order of
doc_id. The pool is every other usable document, unless the caller bounds it by ``pool``. Whole texts are used; the measures'
means and deviations are those of all documents.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm.common import ROWS, chunks, discard, fit_in_task, fold_of, materialize, table

BUCKETS = 1 << 15
#: Measured properties, in order.
MEASURES = ("log words", "log characters", "words a line", "characters a word", "letters", "capitals", "digits", "symbols", "marks at words' ends", "distinct words", "distinct lines", "short lines", "bars", "exclamations")
CATEGORIES = 1 << 14
#: Columns of the features, by which documents are told apart (h), learnt and scored.
FEATURES = "doc_id long, h long, words binary, shares binary, measured array<float>, page binary"
VIEWS = ("content", "page")


@dataclass(frozen=True)
class CoTrainParams:
    labelled: int = 4000
    pool: int | None = None
    rounds: int = 4
    exchanged: int = 200
    sure: float = 0.9
    sample_bytes: int = 256_000_000
    epochs: int = 30
    rate: float = 0.3
    penalty: float = 1e-4
    held_back: float = 0.25
    seed: int = 5


_SHAPE = re.compile(r"[^\W\d_]+")


def word_buckets(word: str) -> tuple[int, int, int]:
    """Buckets of the word, its shape and its ending."""
    shape = _SHAPE.sub(lambda m: "A" if m.group().isupper() else "a", word)
    return tuple(xxhash.xxh3_64_intdigest(f.encode("utf-8", "replace")) % BUCKETS for f in (word.lower(), "s:" + shape[:8], "e:" + word[-3:]))


def text_features(text: str, known: dict[str, tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values: shares of the text's words, square-rooted. ``known`` remembers words' buckets."""
    counts = Counter(text.split())
    if len(known) > 300_000:
        known.clear()
    for w in counts:
        if w not in known:
            known[w] = word_buckets(w)
    buckets = np.array([known[w] for w in counts], np.int64).reshape(-1, 3)
    mass = np.bincount(buckets.ravel(), np.repeat(np.fromiter(counts.values(), float, len(counts)), 3), minlength=1)
    columns = np.flatnonzero(mass)
    return columns, np.sqrt(mass[columns] / max(sum(counts.values()), 1))


def _classes() -> np.ndarray:
    """Bits of the characters of the basic plane: letter, capital, digit, symbol."""
    return np.array([c.isalpha() | c.isupper() << 1 | c.isdigit() << 2 | (not (c.isalnum() or c.isspace())) << 3 for c in map(chr, range(1 << 16))], np.uint8)


_CLASSES: list[np.ndarray] = []


def measures(text: str) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(_classes())
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = max(len(words), 1), max(len(text), 1)
    kinds = _CLASSES[0][np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
    return np.array(
        [
            np.log1p(len(words)),
            np.log1p(len(text)),
            np.log1p(n / max(len(lines), 1)),
            (len(text) - n) / n / 10,
            *(np.count_nonzero(kinds & bit) / chars for bit in (1, 2, 4, 8)),
            sum(not w[-1].isalnum() for w in words) / n,
            len(set(words)) / n,
            len(set(lines)) / max(len(lines), 1),
            sum(len(x) < 20 for x in lines) / max(len(lines), 1),
            text.count("|") / n,
            text.count("!") / n,
        ]
    )


class Linear:
    """Logistic regression on rows of (columns, values), by AdaGrad."""

    def __init__(self, size: int, p: CoTrainParams):
        self.w, self.b, self.p = np.zeros(size), 0.0, p

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        rng = np.random.default_rng(self.p.seed)
        self.w[:] = 0
        self.b = 0.0
        square, sb = np.full(len(self.w), 1e-6), 1e-6
        weigh = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        for _ in range(self.p.epochs):
            for i in rng.permutation(len(y)):
                cols, vals = rows[i]
                g = (1 / (1 + np.exp(-np.clip(self.w[cols] @ vals + self.b, -30, 30))) - y[i]) * weigh[i]
                gw = g * vals + self.p.penalty * self.w[cols]
                square[cols] += gw * gw
                self.w[cols] -= self.p.rate * gw / np.sqrt(square[cols])
                sb += g * g
                self.b -= self.p.rate * g / np.sqrt(sb)

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.w[cols] @ vals + self.b for cols, vals in rows])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a * x + b), by Newton's steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-6)
        grad = np.array([((q - y) * x).sum() + (a - 1), (q - y).sum()])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def page_buckets(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Buckets of the metadata: each value, sizes by half octaves, and source and language together."""
    size = None if n_chars is None else int(2 * np.log2(max(n_chars, 0) + 1))
    named = (("source", source), ("lang", lang), ("n_chars", size), ("both", (source, lang)))
    return [xxhash.xxh3_64_intdigest(f"{k}={v!r}".encode("utf-8", "replace")) % CATEGORIES for k, v in named]


def featurize(documents: DataFrame) -> DataFrame:
    """A row of FEATURES per document: shares of words in half precision, metadata as buckets."""
    n_chars = F.col("n_chars").cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), n_chars.alias("n_chars"))
    marks = F.struct(*(F.struct(F.col(c)).alias(c) for c in ("text", "source", "lang", "n_chars")))
    rows = rows.select("*", F.xxhash64(F.to_json(marks)).alias("h"))

    def run(batches):
        known: dict[str, tuple[int, int, int]] = {}
        for batch in (part for whole in batches for part in chunks(whole, ROWS)):
            words, shares, measured, page = [], [], [], []
            for text, source, lang, n in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                columns, values = text_features(text or "", known)
                words.append(columns.astype(np.uint16).tobytes())
                shares.append(values.astype(np.float16).tobytes())
                measured.append(measures(text or "").astype(np.float32))
                page.append(np.array(page_buckets(source, lang, n), np.uint16).tobytes())
            made = [batch.column(0), batch.column(5), pa.array(words, pa.binary()), pa.array(shares, pa.binary()), pa.array(measured, pa.list_(pa.float32())), pa.array(page, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=[part.split()[0] for part in FEATURES.split(", ")])

    return rows.mapInArrow(run, FEATURES)


class Rows:
    """Features of some documents, as arrays."""

    def __init__(self, words: list[bytes], shares: list[bytes], measured: list[list[float]], page: list[bytes], mean: np.ndarray, scale: np.ndarray):
        self.n = len(words)
        self.ends = np.cumsum([0] + [len(x) // 2 for x in words])
        self.words = np.frombuffer(b"".join(words), np.uint16).astype(np.int64)
        self.shares = np.frombuffer(b"".join(shares), np.float16).astype(float)
        self.measured = np.clip((np.array(measured, float).reshape(self.n, len(MEASURES)) - mean) / scale, -5, 5)
        self.page = np.frombuffer(b"".join(page), np.uint16).astype(np.int64).reshape(self.n, 4)

    def row(self, view: str, i: int) -> tuple[np.ndarray, np.ndarray]:
        if view == "page":
            return self.page[i], np.full(self.page.shape[1], 0.5)
        own = slice(self.ends[i], self.ends[i + 1])
        return np.concatenate([self.words[own], BUCKETS + np.arange(len(MEASURES))]), np.concatenate([self.shares[own], self.measured[i]])

    def logits(self, view: str, model: Linear) -> np.ndarray:
        if view == "page":
            return 0.5 * model.w[self.page].sum(axis=1) + model.b if self.n else np.zeros(0)
        of = np.repeat(np.arange(self.n), np.diff(self.ends))
        return np.bincount(of, model.w[self.words] * self.shares, self.n) + self.measured @ model.w[BUCKETS:] + model.b


class CoTrained:
    """Both views' models and their calibration; ``share`` is that of label 1 in the sample."""

    def __init__(self, p: CoTrainParams, mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale, self.constant = p, mean, scale, None
        self.models = {"content": Linear(BUCKETS + len(MEASURES), p), "page": Linear(CATEGORIES, p)}

    def rows(self, columns: list[list]) -> Rows:
        return Rows(*columns, self.mean, self.scale)

    def fit(self, rows: Rows, labels: np.ndarray, taught: np.ndarray) -> CoTrained:
        """labels: 1 or 0; taught: the view that a row was labelled for by the other one, or None in the labelled sample."""
        p, known = self.p, np.flatnonzero(taught == None)  # noqa: E711
        if len(known) == 0 or labels[known].min() == labels[known].max():
            self.constant = float(labels[known].mean()) if len(known) else 0.5
            return self
        back = np.random.default_rng(p.seed).random(len(known)) < p.held_back
        if len(set(labels[known[back]])) < 2 or len(set(labels[known[~back]])) < 2:
            back[:] = False
        learn, check = known[~back], known[back] if back.any() else known
        self.share = float(labels[learn].mean())
        for view, model in self.models.items():
            at = [*learn, *np.flatnonzero(taught == view)]
            model.fit([rows.row(view, i) for i in at], labels[at].astype(float))
        y = labels[check].astype(float)
        got = [rows.logits(view, self.models[view])[check] for view in VIEWS]
        self.curves = [_curve(x, y) for x in got]
        self.last = _curve(sum(a * x + b for (a, b), x in zip(self.curves, got, strict=True)) / 2, y)
        return self

    def log_odds(self, rows: Rows) -> list[np.ndarray]:
        """Of each view, calibrated."""
        return [a * rows.logits(view, self.models[view]) + b for view, (a, b) in zip(VIEWS, self.curves, strict=True)]

    def scores(self, rows: Rows) -> np.ndarray:
        if self.constant is not None:
            return np.full(rows.n, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.last[0] * sum(self.log_odds(rows)) / 2 + self.last[1], -30, 30)))


_READ = ["words", "shares", "measured", "page"]
_CANDIDATE = "taught string, y int, sureness double, h long, words binary, shares binary, measured array<float>, page binary"


def most_sure(odds: list[np.ndarray], hashes: list[int], share: float, p: CoTrainParams, used: set[tuple[str, int]], best: dict) -> None:
    """Add to ``best``, by (view to teach, label), the rows that the other view is surest of: heaps of (sureness, -h, place in the batch)."""
    limit = np.log(p.sure / (1 - p.sure))
    ones = int(round(p.exchanged * share))
    for mine, other in ((0, 1), (1, 0)):
        for y, most in ((1, ones), (0, p.exchanged - ones)):
            heap, inside = best.setdefault((VIEWS[other], y), ([], set()))
            sureness = odds[mine] if y else -odds[mine]
            for i in np.flatnonzero(sureness >= limit):
                key = (float(sureness[i]), -hashes[i], int(i))
                if hashes[i] in inside or (VIEWS[other], hashes[i]) in used or (len(heap) >= most and (most == 0 or key <= heap[0][:2])):
                    continue
                inside.add(hashes[i])
                heapq.heappush(heap, key)
                if len(heap) > most:
                    inside.discard(-heapq.heappop(heap)[1])


def exchange(pool: DataFrame, model: CoTrained, used: set[tuple[str, int]]) -> DataFrame:
    """One round: of all documents of the pool, the different ones that each view is surest of, labelled for the other."""
    shared, p = pool.sparkSession.sparkContext.broadcast((model, used)), model.p

    def run(batches):
        model, used = shared.value
        best, kept = {}, {}
        for batch in (part for whole in batches for part in chunks(whole, ROWS)):
            columns = [batch.column(k).to_pylist() for k in range(5)]
            most_sure(model.log_odds(model.rows(columns[1:])), columns[0], model.share, p, used, best)
            inside = set().union(*(hashes for _, hashes in best.values()))
            kept = {h: row for h, row in kept.items() if h in inside} | {row[0]: row for row in zip(*columns, strict=True) if row[0] in inside}
        out = [(view, y, key[0], *kept[-key[1]]) for (view, y), (heap, _) in best.items() for key in heap]
        if out:
            types = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[part.split()[0] for part in _CANDIDATE.split(", ")])

    found = pool.select("h", *_READ).mapInArrow(run, _CANDIDATE).dropDuplicates(["taught", "y", "h"])
    first = Window.partitionBy("taught", "y").orderBy(F.col("sureness").desc(), "h")
    ones = int(round(p.exchanged * model.share))
    return found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= p.exchanged).where(F.col("k") <= F.when(F.col("y") == 1, ones).otherwise(p.exchanged - ones)).drop("k")


def fit_features(features: DataFrame, labels: DataFrame, usable: Column, params: CoTrainParams | None = None) -> CoTrained:
    """Learn from the features of the documents for which ``usable`` (of doc_id) holds, labelled ones and others."""
    p = params or CoTrainParams()
    first = (F.xxhash64("doc_id"), F.col("doc_id"))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & usable).groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("y"))
    chosen = F.broadcast(materialize(marks.join(features.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*first).limit(p.labelled), "quality-chosen"))
    usual = features.select(*(f(F.col("measured")[k]).alias(f"{f.__name__}{k}") for k in range(len(MEASURES)) for f in (F.avg, F.stddev_pop))).first()
    of = np.array([x or 0.0 for x in usual], np.float32).astype(float)
    mean, scale = of[0::2], of[1::2] + 1e-6
    labelled = features.join(chosen, "doc_id").dropDuplicates(["doc_id", "h"]).orderBy(*first, "h").limit(p.labelled)
    labelled = materialize(labelled.select(F.lit(None).cast("string").alias("taught"), "y", F.lit(0.0).alias("sureness"), "doc_id", "h", *_READ), "quality-labelled")
    pool = features.where(F.col("doc_id").isNotNull() & usable).join(chosen, "doc_id", "left_anti")
    if p.pool is not None:
        pool = pool.orderBy(*first, "h").limit(p.pool)
    sample, used, rounds = labelled, set(), []

    def learn(rows: pa.Table) -> CoTrained:
        model = CoTrained(p, mean, scale)
        columns = [rows.column(c).to_pylist() for c in _READ]
        return model.fit(model.rows(columns), np.array(rows.column("y").to_pylist(), np.int64), np.array(rows.column("taught").to_pylist(), object))

    for turn in range(p.rounds + 1):
        model = fit_in_task(sample, ["taught", "sureness", "doc_id", "h"], learn, p.sample_bytes, "words")
        if turn == p.rounds or model.constant is not None:
            break
        new = materialize(exchange(pool, model, used).withColumn("doc_id", F.lit(None).cast("long")), "quality-taught")
        rounds.append(new)
        used |= {(r.taught, r.h) for r in new.select("taught", "h").collect()}  # at most rounds * 2 * exchanged
        sample = sample.unionByName(new)
    for part in (labelled, *rounds):
        discard(part)
    return model


def score_features(features: DataFrame, model: CoTrained) -> DataFrame:
    """A row per document: doc_id, score, predicted."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in (part for whole in batches for part in chunks(whole, ROWS)):
            scores = shared.value.scores(shared.value.rows([batch.column(k).to_pylist() for k in range(1, 5)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return features.select("doc_id", *_READ).mapInArrow(run, "doc_id long, score double, predicted int")


def fit(documents: DataFrame, labels: DataFrame, usable: Column, params: CoTrainParams | None = None) -> CoTrained:
    """Learn from the documents for which ``usable`` (of doc_id) holds, labelled ones and others."""
    features = materialize(featurize(documents), "quality-features")
    model = fit_features(features, labels, usable, params)
    discard(features)
    return model


def score_quality(documents: DataFrame, model: CoTrained) -> DataFrame:
    """A row per document: doc_id, score, predicted."""
    return score_features(featurize(documents), model)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of(F.col("doc_id"), 5)
    features = materialize(featurize(table(spark, sf_dir, "documents")), "quality-features")
    model = fit_features(features, table(spark, sf_dir, "labels"), fold != 3)
    return score_features(features, model).select("doc_id", (fold == 3).alias("held_out"), "score", "predicted")
