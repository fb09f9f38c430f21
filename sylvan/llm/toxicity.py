"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the vectors of its hashed features (the word and
its leading characters). Filters of several widths slide over the words of the
whole text; each filter's maximum goes to a logistic output. The network is
trained in numpy; feature vectors begin with how strongly a feature goes with
label 1 (a z-score by kind of feature). Thresholds are calibrated
by language, on a held-back part of the rows and with the language that a
text model predicts, and put at the same score of ``cut``: scores below all
languages' thresholds and above all of them need no language.

Cases: null or empty text is scored like a text without words; repeated labels of
a document: the highest counts; null labels are not used; without both labels
every score is the share of label 1 in it (0 if empty); repeated
rows each get their row; other columns are not read.

Labels are learned from all labelled rows, equal rows once. They are dealt by hash into units of about ``unit_rows`` rows, of which
the words are coded once. In each of ``epochs`` passes every unit goes on from the model of the pass before, in a task of its own, and
the models are averaged; one unit alone is plain training. The counts that vectors begin with, the counts of the language model (of the
rows with one of the most frequent languages) and those for the thresholds are of all these rows, too; a threshold's are counts by
language, label and logit to 1/GRID. A language's threshold is found on its held-back rows together with all languages' rows, which weigh as much as
``pooled`` positives: with few of its own it stays near the common one. With fewer than 20 held-back positives the model and its
threshold learn from the same rows.
"""

from __future__ import annotations

import copy
import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import langid
from sylvan.llm.common import PIECES, add_up, append_columns, as_bytes, discard, fold_of, free_executors, free_shuffles, lean, materialize, maybe_wanted, pieces, table, trim, whole

#: Lengths of the leading parts of a word that are features besides the word.
PREFIXES = (2, 3, 4, 5, 6, 8)
KINDS = len(PREFIXES) + 1
BUCKETS = 1 << 17
#: Logits of held-back rows are counted in cells of 1/GRID.
GRID = 64
#: Bytes of text of a unit's parts: the rows in which units are written.
PART_BYTES = 2_000_000


@dataclass(frozen=True)
class CnnParams:
    #: Labelled rows that a task learns from in a pass, on average, and the bytes of text after which it begins another unit.
    unit_rows: int = 4000
    unit_bytes: int = 16_000_000
    pooled: float = 10.0
    dims: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    held_back: float = 0.25
    cut: float = 0.3
    seed: int = 11


def features(words: list[bytes]) -> np.ndarray:
    """Buckets of each word and its leading characters: a row for each word, a column for each kind."""
    texts = [w.decode("utf-8", "replace").strip(".,;:!?*#%$&|\"'()") for w in words]
    out = np.empty((len(words), KINDS), np.int32)
    out[:, 0] = [xxhash.xxh3_64_intdigest(t) % BUCKETS for t in texts]
    longest = max(PREFIXES)
    chars = np.array(texts, f"U{longest}").view(np.uint32).reshape(-1, longest)
    h = np.zeros(len(words), np.uint64)
    for n in range(1, longest + 1):
        h = (h ^ chars[:, n - 1]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in PREFIXES:
            out[:, 1 + PREFIXES.index(n)] = (h ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return out


class Coded:
    """Distinct words' features, and each text as numbers of words."""

    def __init__(self, texts: list[bytes]):
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        parts = [t.lower().split() for t in texts]
        self.texts = [np.fromiter(map(ids.__getitem__, words), np.int32, len(words)) for words in parts]
        self.features = features(list(ids))


def _line(texts: list[np.ndarray], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end with ``side`` gaps around each: the different words, the line as numbers of these (of none in gaps), and
    each text's start and room."""
    flat = np.concatenate(texts)
    used, flat = np.unique(flat, return_inverse=True)
    lengths = np.array([len(t) for t in texts])
    rooms = np.maximum(lengths, 1)
    starts = side + np.concatenate(([0], np.cumsum(rooms + side)[:-1]))
    line = np.full(int(starts[-1] + rooms[-1] + side), len(used), np.int64)
    line[np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(len(flat))] = flat
    return used, line, starts, rooms


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, and the sums of their rows."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(values[order], first, axis=0)


class ToxicityModel:
    def __init__(self, p: CnnParams):
        rng = np.random.default_rng(p.seed)
        self.p, self.constant = p, None
        self.table = rng.normal(0, 0.02, (BUCKETS, p.dims)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.05, (w * p.dims, p.filters)).astype(np.float32) for w in p.widths}
        for w in p.widths:  # every filter begins with some look at each kind of evidence
            for f in range(p.filters):
                at = f % w
                self.filters[w][at * p.dims : at * p.dims + KINDS, f] += 0.15 + 0.35 * (np.arange(KINDS) == f % KINDS)
        self.bias = {w: np.zeros(p.filters, np.float32) for w in p.widths}
        self.out = np.full(p.filters * len(p.widths), 0.15, np.float32)
        self.offset = np.float32(-1.0)
        self.slope, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.languages: langid.LanguageModel | None = None

    def seed_table(self, seen: np.ndarray, hit: np.ndarray, share: float) -> None:
        """From the numbers of texts and of those of label 1 that hold a feature: a row for each feature, a column for each kind."""
        z = (hit.sum(axis=1) - seen.sum(axis=1) * share) / np.sqrt(seen.sum(axis=1) * share * (1 - share) + 4)
        for kind in range(KINDS):
            found = np.flatnonzero(seen[:, kind])
            self.table[found, kind] += np.clip(z[found], -2, 6).astype(np.float32)

    def _pad(self, coded: Coded, k: int) -> np.ndarray:
        """Word vectors of a text, with rows of zeros around so that every filter fits."""
        words = coded.texts[k]
        side = max(self.p.widths) - 1
        out = np.zeros((max(len(words), 1) + 2 * side, self.p.dims), np.float32)
        if len(words):
            distinct, where = np.unique(words, return_inverse=True)
            out[side : side + len(words)] = self.table[coded.features[distinct]].sum(axis=1)[where]
        return out

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, wheres = [], []
        side = max(self.p.widths) - 1
        for w in self.p.widths:
            n = len(x) - w + 1
            f = self.filters[w]
            got = sum(x[j : j + n] @ f[j * self.p.dims : (j + 1) * self.p.dims] for j in range(w))
            got = got[side - w + 1 : n - (side - w + 1)]  # the same words count for every width
            where = got.argmax(axis=0)
            pooled.append(np.maximum(got[where, np.arange(got.shape[1])] + self.bias[w], 0))
            wheres.append(where + side - w + 1)
        return np.concatenate(pooled), wheres

    def logits(self, coded: Coded, block: int = 200_000) -> np.ndarray:
        """Of all texts: each distinct word meets the filters once, the texts lie end to end with zeros between them."""
        out, held, words = [], [], 0
        for text in coded.texts:
            held.append(text)
            words += len(text)
            if words >= block:
                out.append(self._block_logits(coded, held))
                held, words = [], 0
        if held:
            out.append(self._block_logits(coded, held))
        return np.concatenate(out) if out else np.empty(0)

    def _block_logits(self, coded: Coded, texts: list[np.ndarray]) -> np.ndarray:
        used, line, starts, rooms = _line(texts, max(self.p.widths) - 1)
        vectors = self._vectors(coded, used)
        pooled = []
        for w in self.p.widths:
            begin, end = starts - w + 1, starts + rooms
            most = np.maximum.reduceat(self._looks(vectors, line, w), np.column_stack([begin, end]).ravel(), axis=0)[::2]
            pooled.append(np.maximum(most + self.bias[w], 0))
        return (np.concatenate(pooled, axis=1) @ self.out + self.offset).astype(np.float64)

    def _vectors(self, coded: Coded, used: np.ndarray) -> np.ndarray:
        """A row for each of these words, and one of zeros."""
        out = np.zeros((len(used) + 1, self.p.dims), np.float32)
        for kind in range(KINDS):
            out[:-1] += self.table[coded.features[used, kind]]
        return out

    def _looks(self, vectors: np.ndarray, line: np.ndarray, w: int) -> np.ndarray:
        """What the filters of a width make of each place of the line, and a row of zeros."""
        n = len(line) - w + 1
        got = np.zeros((n + 1, self.p.filters), np.float32)
        for j in range(w):
            got[:n] += (vectors @ self.filters[w][j * self.p.dims : (j + 1) * self.p.dims])[line[j : j + n]]
        return got

    def gradients(self, coded: Coded, k: int, label: float, weight: float, grads: dict, touched: list) -> float:
        """Adds the gradient of weight times the cross entropy of a text; returns that of the offset."""
        p, side = self.p, max(self.p.widths) - 1
        x = self._pad(coded, k)
        pooled, wheres = self._forward(x)
        error = (1 / (1 + np.exp(-(pooled @ self.out + self.offset))) - label) * weight
        grads["out"] += error * pooled
        back = error * self.out * (pooled > 0)
        for i, w in enumerate(p.widths):
            g = back[i * p.filters : (i + 1) * p.filters]
            grads["b", w] += g
            for f in np.flatnonzero(g):
                at = wheres[i][f]
                grads["f", w][:, f] += g[f] * x[at : at + w].ravel()
                for j in range(w):
                    word = at + j - side
                    if 0 <= word < len(coded.texts[k]):
                        touched.append((coded.features[coded.texts[k][word]], g[f] * self.filters[w][j * p.dims : (j + 1) * p.dims, f]))
        return float(error)

    def dense(self) -> dict:
        return {("f", w): self.filters[w] for w in self.p.widths} | {("b", w): self.bias[w] for w in self.p.widths} | {"out": self.out}

    def batch_gradients(self, coded: Coded, part: np.ndarray, labels: np.ndarray, weights: np.ndarray, grads: dict) -> tuple[float, np.ndarray, np.ndarray]:
        """What ``gradients`` adds for all these texts, at once; returns the gradient of the offset, and that of words' vectors: features of words, gradients."""
        p, side = self.p, max(self.p.widths) - 1
        used, line, starts, rooms = _line([coded.texts[k] for k in part], side)
        zero = len(used)
        vectors = self._vectors(coded, used)
        pooled, wheres = [], []
        for w in p.widths:
            got = self._looks(vectors, line, w)
            begin, end = starts - w + 1, starts + rooms
            most = np.maximum.reduceat(got, np.column_stack([begin, end]).ravel(), axis=0)[::2]
            size = end - begin
            at = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            doc, column = np.nonzero(got[at] == np.repeat(most, size, axis=0))  # in order, so that the first of equals is
            doc, place = np.repeat(np.arange(len(part)), size)[doc], at[doc]
            _, first = np.unique(doc * p.filters + column, return_index=True)
            wheres.append(place[first].reshape(len(part), p.filters))
            pooled.append(np.maximum(most + self.bias[w], 0))
        pooled = np.concatenate(pooled, axis=1)
        error = (1 / (1 + np.exp(-(pooled @ self.out + self.offset))) - labels) * weights
        grads["out"] += error @ pooled
        back = error[:, None] * self.out * (pooled > 0)
        words, pulls = [], []
        for i, w in enumerate(p.widths):
            g = back[:, i * p.filters : (i + 1) * p.filters]
            grads["b", w] += g.sum(axis=0)
            for j in range(w):
                rows = slice(j * p.dims, (j + 1) * p.dims)
                word = line[wheres[i] + j]
                grads["f", w][rows] += np.einsum("bf,bfd->df", g, vectors[word])
                hit = (word != zero) & (g != 0)
                words.append(word[hit])
                pulls.append((g[:, :, None] * self.filters[w][rows].T[None])[hit])
        words, pull = _summed(np.concatenate(words), np.concatenate(pulls))
        return float(error.sum()), coded.features[used[words]], pull

    def train(self, coded: Coded, labels: np.ndarray, share: float, state: dict, seed: tuple[int, ...]) -> None:
        """One pass over these texts; ``share`` is that of label 1 in all. ``state`` goes on from pass to pass."""
        p, rng = self.p, np.random.default_rng(seed)
        weigh = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        dense, square = self.dense(), state["square"]
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), p.batch):
            state["step"] += 1
            step = state["step"]
            part = order[begin : begin + p.batch]
            grads = {k: np.zeros_like(v) for k, v in dense.items()}
            slope, rows, pull = self.batch_gradients(coded, part, labels[part], weigh[part] / len(part), grads)
            self.offset -= np.float32(p.rate * 5 * slope)
            for key, value in dense.items():
                m, v = state[key]
                g = grads[key] + p.decay * value
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            if len(rows):
                at, pull = _summed(rows.ravel(), np.repeat(pull, KINDS, axis=0))
                square[at] += (pull * pull).mean(axis=1)
                self.table[at] -= (p.rate * pull / np.sqrt(square[at])[:, None]).astype(np.float32)

    def fresh_state(self) -> dict:
        return {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.dense().items()} | {"square": np.full(BUCKETS, 1e-2, np.float32), "step": 0}

    def packed(self, state: dict) -> np.ndarray:
        """All but the table and its squares, in one row."""
        return np.concatenate([x.ravel() for k, v in self.dense().items() for x in (v, *state[k])] + [np.array([self.offset, state["step"]])])

    def unpack(self, row: np.ndarray, state: dict) -> None:
        at = 0
        for k, v in self.dense().items():
            for x in (v, *state[k]):
                x[...] = row[at : at + x.size].reshape(x.shape)
                at += x.size
        self.offset, state["step"] = np.float32(row[at]), row[at + 1]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, languages: list[str], times: np.ndarray) -> None:
        """A logistic curve over the held-back logits, then each language's best threshold (by F1), pooled where few. An entry
        stands for so many rows as ``times`` says."""
        a, b = 1.0, 0.0
        share = times / times.sum()
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
            a -= 0.5 * (((q - labels) * logits) @ share + 1e-3 * (a - 1)) / max(1.0, logits**2 @ share)
            b -= 0.5 * (q - labels) @ share
        self.slope, self.shift = max(a, 1e-3), b
        q = 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))

        order = np.argsort(-q, kind="stable")

        def best(weights: np.ndarray) -> float:
            """The threshold of the greatest F1 of weighted rows."""
            got = np.cumsum((labels * weights)[order])
            f1 = 2 * got / (np.cumsum(weights[order]) + (labels * weights).sum())
            k = int(f1.argmax())
            below = q[order[k + 1]] if k + 1 < len(order) else 0.0
            return float(np.clip((q[order[k]] + below) / 2, 0.02, 0.98))

        self.thresholds = {"": best(times)}
        for name in sorted(set(languages)):
            own = np.array([x == name for x in languages], float) * times
            self.thresholds[name] = best(own + times * self.p.pooled / max(labels @ times, 1))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logits = self.logits(Coded(texts))
        q = 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))
        low, high = min(self.thresholds.values()), max(self.thresholds.values())
        cut, room = self.p.cut, 0.05
        out = np.where(q < low, (cut - room) * q / low, cut + room + (1 - cut - room) * (q - high) / (1 - high))
        # only between the languages' thresholds does the language matter
        between = np.flatnonzero((q >= low) & (q < high))
        if len(between):
            named = self.languages.label([texts[k].decode("utf-8", "replace") for k in between])
            for k, (name, _) in zip(between, named, strict=True):
                at = self.thresholds.get(name, self.thresholds[""])
                out[k] = cut - room + room * (q[k] - low) / (at - low) if q[k] < at else cut + room * (q[k] - at) / max(high - at, 1e-9)
        return out


@dataclass
class Unit:
    """Some labelled texts, coded: what one pass of training in a task learns from, or a part of that; of those to be judged the texts, too."""

    texts: list[np.ndarray]
    features: np.ndarray
    labels: np.ndarray
    kept: list[bytes]

    def coded(self) -> Coded:
        out = object.__new__(Coded)
        out.texts, out.features = self.texts, self.features
        return out

    @classmethod
    def of(cls, rows: list[tuple], keep: bool) -> Unit:
        coded = Coded([x[3] for x in rows])
        small = np.uint16 if len(coded.features) <= 1 << 16 else np.int32
        return cls([t.astype(small) for t in coded.texts], coded.features, np.array([x[1] for x in rows], np.float64), [x[3] for x in rows] if keep else [])

    @classmethod
    def joined(cls, parts: list[Unit]) -> Unit:
        """One unit of its parts, in which words of the same features (by 64 bits of hash) are there once."""
        features = np.concatenate([u.features for u in parts])
        factors = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1 for k in range(KINDS)], np.uint64)
        keys = sum(features[:, k].astype(np.uint64) * factors[k] for k in range(KINDS))
        _, first, where = np.unique(keys, return_index=True, return_inverse=True)
        where = where.astype(np.int32)
        shifts = np.concatenate(([0], np.cumsum([len(u.features) for u in parts])))
        texts = [where[t.astype(np.int64) + shift] for u, shift in zip(parts, shifts, strict=False) for t in u.texts]
        return cls(texts, features[first], np.concatenate([u.labels for u in parts]), [x for u in parts for x in u.kept])


def _code(rows: DataFrame, p: CnnParams, languages: list[str], hold: bool) -> DataFrame:
    """Units of the rows (shard, h, y, lang, text), in parts, and what adds up over them: numbers of rows, of texts by feature, and of
    n-grams by language. With ``hold`` a part of the rows is held back; without, all are learned from and judged."""
    longest = langid.LangParams().longest_gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        numbers = np.zeros(4)
        seen = np.zeros((2, BUCKETS * KINDS), np.float32)

        def made(unit: int, part: list[tuple]) -> Iterator[pa.RecordBatch]:
            held = [hold and (x[0] >> 32 & 0xFFFF) < p.held_back * 0x10000 for x in part]
            for name in {x[2] for x in part} & set(languages):
                grams[name] = grams.get(name, 0) + langid.text_counts((x[3].decode() for x in part if x[2] == name), longest)
            y = np.array([x[1] for x in part], np.float64)
            numbers[:] += [len(y), y.sum(), sum(held), y[held].sum()]
            learned = Unit.of([x for x, h in zip(part, held, strict=True) if not h], False)
            judged = Unit.of([x for x, h in zip(part, held, strict=True) if h or not hold], True)
            keys = learned.features.astype(np.int64) * KINDS + np.arange(KINDS)
            for words, label in zip(learned.texts, learned.labels, strict=True):
                found = keys[words].ravel()
                seen[0, found] += 1  # once, however often a key is there
                if label:
                    seen[1, found] += 1
            for kind, rows in (("learn", learned), ("judge", judged)):
                if rows.texts:
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([-1], pa.int64()), pa.array([unit], pa.int64()), pa.array([pickle.dumps(rows)], pa.binary())], names=["kind", "slice", "unit", "data"])

        part, size, total, shard, last, unit = [], 0, 0, None, None, 0
        for batch in batches:
            for s, h, y, lang, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if h == last:  # a row that is there already
                    continue
                other = s != shard or total >= p.unit_bytes
                if part and (other or size >= PART_BYTES):
                    yield from made(unit, part)
                    part, size = [], 0
                    trim()
                if other:
                    unit = unit + 1 if s == shard else s << 20
                    total, shard = 0, s
                last = h
                part.append((h, y, lang, text.encode()))
                size += len(part[-1][3])
                total += len(part[-1][3])
        if part:
            yield from made(unit, part)
            yield pieces("rows", unit, numbers)
            for name, values in (("seen", seen[0]), ("hit", seen[1]), *((f"grams {x}", v) for x, v in sorted(grams.items()))):
                yield pieces(name, unit, values)

    units = materialize(rows.mapInArrow(lean(run), PIECES), "toxicity-units", compression="zstd")
    free_executors(rows.sparkSession)
    return units


def _each_unit(units: DataFrame, kind: str, fn: Callable[[Unit, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``fn`` makes of each unit: its parts to learn from, which follow each other in one file, are joined, those to judge come one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = [], None
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column(0)[k].as_py()
                if parts and (number != last or kind == "judge"):
                    yield from fn(Unit.joined(parts), last)
                    parts = []
                    trim()
                parts.append(pickle.loads(batch.column(1)[k].as_buffer()))
                last = number
        if parts:
            yield from fn(Unit.joined(parts), last)

    return units.where(F.col("kind") == kind).select("unit", "data").mapInArrow(lean(run), schema)


def _train(units: DataFrame, model: ToxicityModel, share: float) -> None:
    """Passes over all units: each learns from the model that the pass before left, and what they make of it is averaged, weighed by
    their rows, and for a feature's vector by their texts that hold the feature."""
    p, state = model.p, model.fresh_state()
    sizes = len(model.packed(state))
    for turn in range(p.epochs):
        shared = units.sparkSession.sparkContext.broadcast((model, state))

        def learn(unit: Unit, number: int, turn: int = turn, shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            own, memory = copy.deepcopy(shared.value)
            coded = unit.coded()
            own.train(coded, unit.labels, share, memory, (p.seed + 1, turn, number))
            times = np.zeros(BUCKETS, np.float32)
            for words in coded.texts:
                times[coded.features[words].ravel()] += 1  # once, however often a feature is there
            before, squares = shared.value[0].table, shared.value[1]["square"]
            yield pieces("vectors", number, (own.table - before) * times[:, None])
            yield pieces("squares", number, (memory["square"] - squares) * times)
            yield pieces("times", number, times)
            yield pieces("dense", number, np.concatenate([own.packed(memory), [1.0]]) * len(unit.labels))

        found = add_up(_each_unit(units, "learn", learn, PIECES))
        times = np.maximum(whole(found.get("times"), BUCKETS), 1)
        model.table += (whole(found.get("vectors"), BUCKETS * p.dims).reshape(BUCKETS, p.dims) / times[:, None]).astype(np.float32)
        state["square"] += (whole(found.get("squares"), BUCKETS) / times).astype(np.float32)
        dense = whole(found.get("dense"), sizes + 1)
        model.unpack(dense[:-1] / dense[-1], state)
        shared.destroy()
        free_shuffles(units.sparkSession)  # a pass shuffles what each unit made of the model


def _calibrate(units: DataFrame, model: ToxicityModel) -> None:
    """By all rows to be judged, counted by language, label and logit to 1/GRID."""
    shared = units.sparkSession.sparkContext.broadcast(model)

    def judge(unit: Unit, number: int) -> Iterator[pa.RecordBatch]:
        names = [x for x, _ in shared.value.languages.label([x.decode() for x in unit.kept])]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(unit.labels), pa.array(shared.value.logits(unit.coded()))], names=["name", "y", "logit"])

    judged = _each_unit(units, "judge", judge, "name string, y double, logit double")
    cells = judged.groupBy("name", "y", F.floor(F.col("logit") * GRID).alias("cell")).agg(F.avg("logit").alias("logit"), F.count("*").cast("double").alias("n")).collect()
    cells.sort(key=lambda r: (r.name, r.y, r.cell))
    model.calibrate(*(np.array([r[k] for r in cells], float) for k in ("logit", "y")), [r["name"] for r in cells], np.array([r["n"] for r in cells]))
    shared.destroy()


def fit(documents: DataFrame, labels: DataFrame, usable: Column, params: CnnParams | None = None) -> ToxicityModel:
    """Learn from all labelled documents for which ``usable`` (of doc_id) holds."""
    p = params or CnnParams()
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    shards = -(-max(marks.count(), 1) // p.unit_rows)
    texts = documents.where(usable).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = maybe_wanted(texts, marks, "doc_id").join(marks, "doc_id").withColumn("h", F.xxhash64("doc_id", "text", F.lit(5)))
    rows = rows.select(F.pmod("h", F.lit(shards)).cast("long").alias("shard"), "h", "y", "lang", "text").repartition(shards, "shard").sortWithinPartitions("shard", "h", "lang")
    most = langid.LangParams().most_languages
    languages = [x[0] for x in texts.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()]
    model, hold, units = ToxicityModel(p), True, None
    free_executors(documents.sparkSession)
    while True:
        discard(units)
        units = _code(rows, p, languages, hold)
        free_shuffles(documents.sparkSession)  # the texts, of which units hold all that is needed
        found = add_up(units.where("kind not in ('learn', 'judge')"))
        n, positives, held, held_positives = whole(found.get("rows"), 4)
        if positives in (0, n):
            model.constant = positives / max(n, 1)
            break
        if hold and (held_positives < 20 or held_positives == positives):
            hold = False
            continue
        share = (positives - held_positives) / (n - held)
        named = langid.LanguageModel.of_counts(langid.LangParams(), {x: whole(found[f"grams {x}"], langid.COUNTS) for x in languages if f"grams {x}" in found})
        seen, hit = (whole(found.get(x), BUCKETS * KINDS).reshape(BUCKETS, KINDS) for x in ("seen", "hit"))
        model.seed_table(seen, hit, share)
        del found, seen, hit
        _train(units, model, share)
        model.languages = named
        _calibrate(units, model)
        break
    discard(units)
    free_shuffles(documents.sparkSession)
    free_executors(documents.sparkSession)
    return model


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents (with a string column text) with tox_score and tox_predicted (columns of these names are replaced)."""
    documents = documents.drop("tox_score", "tox_predicted")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        got, block, held = [], [], 0
        for text in as_bytes(column):
            block.append(text)
            held += len(text)
            if held > 2_000_000:
                got.append(shared.value.scores(block))
                block, held = [], 0
        if block:
            got.append(shared.value.scores(block))
        scores = np.concatenate(got) if got else np.empty(0)
        return [pa.array(scores, pa.float64()), pa.array((scores >= shared.value.p.cut).astype(np.int32))]

    return append_columns(documents, ["text"], run, "tox_score double, tox_predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(documents, labels, fold_of(F.col("doc_id"), 4) != 2)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score_toxicity(rows, model).select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))
