"""Language identification of mixed-language text by spans.

A word's script (by code point ranges) leaves the languages that were seen in
that script; each gets a score from its character n-gram model, and Viterbi with
a switching penalty labels the words, so that spans of one language come out.
A document's language is the one that labels most of its letters.

Cases: null text, or text without a letter, is ``und`` with score 0; where nothing
could be learned every text is ``und``; ties go to the language first in order of
code points; repeated rows each get their row; other columns are not read.

The models are learned from a sample of labelled rows, in one task: at most ``docs_per_language``
of each of the ``most_languages`` most frequent languages, those first in a hash order of
doc_id and text, equal rows once, and at most ``sample_bytes`` of whole texts.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import fit_in_task, fold_of, map_batches, sample_by_kind, table

LETTERS = re.compile(r"[^\W\d_]+")
#: First code points of script ranges, in order, each up to the next.
SCRIPTS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD800, "Other"),
]
_STARTS = [start for start, _ in SCRIPTS]
_NAMES = sorted({name for _, name in SCRIPTS})
BUCKETS = 1 << 16


@dataclass(frozen=True)
class LangParams:
    docs_per_language: int = 1500
    most_languages: int = 256
    sample_bytes: int = 64_000_000
    longest_gram: int = 4
    smoothing: float = 0.5
    penalty: float = 6.0
    #: Overlapping n-grams are not independent: a word's evidence is its mean n-gram score times this.
    word_weight: float = 3.0
    least_share: float = 0.01


def script_of(word: str) -> int:
    return _NAMES.index(SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1])


def gram_buckets(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of UTF-8 bytes of the marked words, and which word each belongs to."""
    coded = [b"\x01%b\x02" % w.encode() for w in words]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(coded)), lengths)
    value = np.zeros(len(data), np.uint64)
    buckets, owners = [], []
    for n in range(1, longest + 1):
        value = value[: len(data) - n + 1] * np.uint64(256) + data[n - 1 :] if n > 1 else data
        inside = owner[: len(value)] == owner[n - 1 :]
        mixed = (value[inside] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(48)).astype(np.int64))
        owners.append(owner[: len(value)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


#: Length of what text_counts gives.
COUNTS = BUCKETS + len(_NAMES)


def text_counts(texts: Iterable[str], longest: int, block: int = 4000) -> np.ndarray:
    """How often n-grams and then scripts occur: what LanguageModel.learn adds for these texts, each different word cut up once."""
    found: Counter[str] = Counter()
    for text in texts:
        found.update(LETTERS.findall(text.lower()))
    out, words = np.zeros(COUNTS), list(found)
    for at in range(0, len(words), block):
        part = words[at : at + block]
        times = np.fromiter(map(found.__getitem__, part), np.float64, len(part))
        buckets, owners = gram_buckets(part, longest)
        out[:BUCKETS] += np.bincount(buckets, times[owners], minlength=BUCKETS)
        out[BUCKETS:] += np.bincount([script_of(w) for w in part], times, minlength=len(_NAMES))
    return out


class LanguageModel:
    def __init__(self, p: LangParams, languages: list[str]):
        self.p, self.languages = p, languages
        self.counts = np.zeros((BUCKETS, len(languages)))
        self.scripts = np.zeros((len(_NAMES), len(languages)))

    def learn(self, label: str, text: str) -> None:
        words = LETTERS.findall(text.lower())
        if words:
            k = self.languages.index(label)
            buckets, _ = gram_buckets(words, self.p.longest_gram)
            self.counts[:, k] += np.bincount(buckets, minlength=BUCKETS)
            self.scripts[:, k] += np.bincount([script_of(w) for w in words], minlength=len(_NAMES))

    @classmethod
    def of_counts(cls, p: LangParams, counts: dict[str, np.ndarray]) -> LanguageModel:
        """From the sums of ``text_counts`` of each language."""
        model = cls(p, sorted(counts))
        for k, name in enumerate(model.languages):
            model.counts[:, k], model.scripts[:, k] = counts[name][:BUCKETS], counts[name][BUCKETS:]
        return model.finish()

    def finish(self) -> LanguageModel:
        if not self.languages:
            return self
        smooth = self.counts + self.p.smoothing
        logs = np.log(smooth / smooth.sum(axis=0))
        self.scores = (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)
        share = self.scripts / np.maximum(self.scripts.sum(axis=0), 1)
        allowed = share >= self.p.least_share
        self.barred = np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0, -1e6).astype(np.float32)
        del self.counts, self.scripts
        return self

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of scores by language for each word (none may be empty)."""
        buckets, owners = gram_buckets(words, self.p.longest_gram)
        n = np.bincount(owners, minlength=len(words))
        out = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owners, self.scores[buckets, k], minlength=len(words))
        return out / n[:, None] * self.p.word_weight + self.barred[[script_of(w) for w in words]]

    def label(self, texts: list[str | None], block: int = 400_000) -> list[tuple[str, float]]:
        """(language, share of its letters) of each text."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        held: list[tuple[int, list[str]]] = []
        total = 0
        for k, text in enumerate(texts):
            words = LETTERS.findall(text.lower()) if text else []
            if words:
                held.append((k, words))
                total += len(words)
            if held and (total >= block or k == len(texts) - 1):
                self._label_block(held, out)
                held, total = [], 0
        if held:
            self._label_block(held, out)
        return out

    def _label_block(self, held: list[tuple[int, list[str]]], out: list[tuple[str, float]]) -> None:
        ids: dict[str, int] = {}
        coded = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for _, words in held]
        distinct = list(ids)
        scores = self.word_scores(distinct)
        letters = np.fromiter(map(len, distinct), np.int64, len(distinct))
        labels = spans(scores, coded, self.p.penalty)
        for (k, _), words, marks in zip(held, coded, labels, strict=True):
            mass = np.bincount(marks, letters[words], minlength=len(self.languages))
            best = int(mass.argmax())
            out[k] = (self.languages[best], float(mass[best] / mass.sum()))


def spans(scores: np.ndarray, texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Viterbi labels of each text's words; all texts advance together, longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    words = np.concatenate([texts[i] for i in order])
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t words
    value = np.zeros((len(texts), scores.shape[1]), np.float32)
    came = np.zeros((len(words), scores.shape[1]), np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(longest):
        a = active[t]
        here = value[:a]
        best = here.argmax(axis=1)
        jump = here[np.arange(a), best] - np.float32(penalty)
        stay = here >= jump[:, None]
        at = starts[:a] + t
        came[at] = np.where(stay, own, best[:, None])
        value[:a] = np.where(stay, here, jump[:, None]) + scores[words[at]]
    marks = np.zeros(len(words), np.int64)
    label = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        marks[at] = label[:a]
        label[:a] = came[at, label[:a]]
    out: list[np.ndarray] = [marks] * len(texts)
    for k, i in enumerate(order):
        out[i] = marks[starts[k] : starts[k] + lengths[k]]
    return out


def fit(documents: DataFrame, usable: Column, params: LangParams | None = None) -> LanguageModel:
    """Learn from the documents for which ``usable`` holds and lang is not null."""
    p = params or LangParams()
    rows = documents.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = [x[0] for x in rows.groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(p.most_languages).collect()]
    sample = sample_by_kind(rows.where(F.col("kind").isin(frequent)), p.docs_per_language) if frequent else rows.limit(0)

    def learn(table: pa.Table) -> LanguageModel:
        labels = table.column("kind").to_pylist()
        model = LanguageModel(p, sorted(set(labels)))
        for label, text in zip(labels, table.column("text"), strict=True):
            model.learn(label, text.as_py())
        return model.finish()

    return fit_in_task(sample, ["h", "kind", "doc_id"] if frequent else ["doc_id"], learn, p.sample_bytes)


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """A row per document: doc_id, lang_pred, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.label(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, fold_of(F.col("doc_id"), 3) != 1)
    return identify(documents, model).withColumn("held_out", fold_of(F.col("doc_id"), 3) == 1).select("doc_id", "held_out", "lang_pred", "score")
