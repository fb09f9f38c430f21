"""Language-model scoring: the marginal likelihood of a text over all its subword segmentations.

A text is its words (A-Z lower-cased) and an end. An existing vocabulary of
pieces makes a lattice over each word: its first piece begins with the word mark,
others and a stop follow, and every character also has its byte pieces, so each
text has a path. A piece's weight starts from the vocabulary's own score and is
re-estimated by expectation maximisation over all distinct training words:
forward-backward over the lattices gives expected counts, to which the
vocabulary's weights are added as a prior. The forward recursion in log space sums
over all segmentations. A word seen in training is one more arc of its lattice,
weighted by its discounted count; what the discount frees is the weight of the
pieces' arcs (absolute discounting, with the discount from the counts of counts).
Pieces never cross words, so a text's log10 probability is the sum of its words'
and of the end's. There is one such model for each of the ``classes`` most frequent
values of a class column of the training documents (their language) and one for
all others; a text's class is unknown, so its probability is their mixture. Over all
texts the probabilities sum to one.

Cases: null or empty text is one end; a null doc_id belongs to the training
folds; repeated rows each count and get their row; without training rows the
vocabulary's weights stand alone; other columns are not read.

Words meet their counts by an equi-join on a 64-bit hash. Only words so frequent
that at most ``frequent`` of them can exist are broadcast; frequent words are
thus no hot keys of the join.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import as_bytes, chunks, fold_of, free_shuffles, materialize, slices, table, words_of

MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
NEVER = -1e30


@dataclass(frozen=True)
class LatticeParams:
    vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model"
    rounds: int = 2
    classes: int = 7
    #: The vocabulary's own weights count as this many pieces.
    prior: float = 2000.0
    frequent: int = 1 << 18
    #: Words of more characters are few; they go one by one.
    longest_batched: int = 40


class Pieces:
    """The vocabulary: pieces by a hash of their characters, with their log weights, the bytes' and the stop's."""

    def __init__(self, names: list[str], ranks: list[float]):
        names, ranks = [*names, *([] if MARK in names else [MARK])], [*ranks, *([] if MARK in names else [-float(len(names))])]
        usable = [(n, r) for n, r in zip(names, ranks, strict=True) if n and n.replace(MARK, "", 1).count(MARK) == 0 and (MARK not in n or n[0] == MARK) and not n.startswith("<")]
        self.names = [n for n, _ in usable]
        # scores of a merge-ordered vocabulary are minus the rank; a weight falls with the rank as in Zipf's law
        weight = 1.0 / (np.array([-r for _, r in usable]) + 20.0)
        weight /= weight.sum()
        self.stop = len(self.names) + 256
        self.first = np.array([n[0] == MARK for n in self.names] + [False] * 257, bool)
        self.prior = np.concatenate([weight, np.full(256, 0.01 / 256), [weight.sum() / 2]])
        self.weigh(self.prior)
        self.longest = max(map(len, self.names), default=1)
        hashes = np.array([_hash(n) for n in self.names], np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.order = hashes[order], order
        self.seen = np.zeros(1 << 21, bool)
        self.seen[(hashes >> np.uint64(43)).astype(np.int64)] = True
        self.index = {n: i for i, n in enumerate(self.names)}

    def weigh(self, mass: np.ndarray) -> None:
        """Log weights from masses: first pieces among themselves, the others with the stop among themselves."""
        self.log = np.log(mass / np.where(self.first, mass[self.first].sum(), mass[~self.first].sum()))

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        keep = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return Pieces([model.id_to_piece(i) for i in keep], [model.get_score(i) for i in keep])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.seen[(hashes >> np.uint64(43)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[some]), len(self.sorted) - 1)
        hit = self.sorted[at] == hashes[some]
        out[some[hit]] = self.order[at[hit]]
        return out


def _hash(text: str) -> int:
    value = 0
    for c in text:
        value = ((value + ord(c) + 1) * int(_P)) & 0xFFFFFFFFFFFFFFFF
        value ^= value >> 31
    return value


def _byte_ids(pieces: Pieces, code: int) -> list[int]:
    return [len(pieces.names) + b for b in chr(code).encode("utf-8", "surrogatepass")]


def score_words(models: list[Pieces], words: list[str], count: bool = False, longest_batched: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probabilities of the words under each model, a row for a model; if wanted, the pieces' expected numbers too."""
    logs = np.array([m.log for m in models])
    out = np.zeros((len(models), len(words)))
    expected = np.zeros(logs.shape)
    marked = [MARK + w for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        if n > longest_batched + 1:
            for r in rows:
                for k in range(len(models)):
                    out[k, r] = _one_word(models[k], marked[r], expected[k] if count else None)
            continue
        codes = np.frombuffer("".join(marked[r] for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n)
        out[:, rows] = _same_length(models[0], logs, codes, expected if count else None)
    return out + logs[:, models[0].stop][:, None], expected


def _same_length(pieces: Pieces, logs: np.ndarray, codes: np.ndarray, expected: np.ndarray | None) -> np.ndarray:
    """Forward (and backward) over all words and models at once, character by character."""
    many, n = codes.shape
    distinct, where = np.unique(codes, return_inverse=True)
    where = where.reshape(many, n)
    ids = [_byte_ids(pieces, int(c)) for c in distinct]
    single = np.array([logs[:, x].sum(axis=1) for x in ids]).T[:, where]  # model, word, place
    single[:, :, 0] = NEVER  # the word mark is a piece's, not a byte's
    wide = np.ascontiguousarray((codes.astype(np.uint64) + np.uint64(1)).T)
    edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for i in range(n):
        value = np.zeros(many, np.uint64)
        for j in range(i, min(i + pieces.longest, n)):
            value = (value + wide[j]) * _P
            value ^= value >> np.uint64(31)
            found = pieces.find(value)
            some = np.flatnonzero(found >= 0)
            if len(some):
                edges[i, j + 1] = (some, found[some])
    shape = (n + 1, len(logs), many)
    ahead = np.full(shape, NEVER)
    ahead[0] = 0
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1] + single[:, :, j - 1]
        for i in range(max(0, j - pieces.longest), j):
            if (i, j) in edges:
                some, found = edges[i, j]
                ahead[j][:, some] = np.logaddexp(ahead[j][:, some], ahead[i][:, some] + logs[:, found])
    total = ahead[n]
    if expected is not None:
        behind = np.full(shape, NEVER)
        behind[n] = 0
        for i in range(n - 1, -1, -1):
            behind[i] = behind[i + 1] + single[:, :, i]
            for j in range(i + 1, min(i + pieces.longest, n) + 1):
                if (i, j) in edges:
                    some, found = edges[i, j]
                    behind[i][:, some] = np.logaddexp(behind[i][:, some], behind[j][:, some] + logs[:, found])
        for k in range(len(logs)):
            for (i, j), (some, found) in edges.items():
                share = np.exp(ahead[i, k, some] + logs[k, found] + behind[j, k, some] - total[k, some])
                expected[k] += np.bincount(found, share, minlength=expected.shape[1])
            by_char = np.zeros(len(distinct))
            for i in range(1, n):
                by_char += np.bincount(where[:, i], np.exp(np.minimum(ahead[i, k] + single[k, :, i] + behind[i + 1, k] - total[k], 0)), minlength=len(distinct))
            for x, mass in zip(ids, by_char, strict=True):
                for b in x:
                    expected[k, b] += mass
    return total


def _one_word(pieces: Pieces, word: str, expected: np.ndarray | None) -> float:
    n = len(word)
    edges: list[list[tuple[int, float, tuple[int, ...]]]] = []
    for i in range(n):
        found = _byte_ids(pieces, ord(word[i]))
        here = [(i + 1, float(pieces.log[found].sum()), tuple(found))] if i else []
        for j in range(i + 1, min(i + pieces.longest, n) + 1):
            k = pieces.index.get(word[i:j])
            if k is not None:
                here.append((j, float(pieces.log[k]), (k,)))
        edges.append(here)
    ahead = [-np.inf] * (n + 1)
    ahead[0] = 0.0
    for i in range(n):
        for j, logs, _ in edges[i]:
            ahead[j] = _plus(ahead[j], ahead[i] + logs)
    if expected is not None:
        behind = [-np.inf] * (n + 1)
        behind[n] = 0.0
        for i in range(n - 1, -1, -1):
            for j, logs, _ in edges[i]:
                behind[i] = _plus(behind[i], logs + behind[j])
        for i in range(n):
            for j, logs, found in edges[i]:
                for k in found:
                    expected[k] += math.exp(ahead[i] + logs + behind[j] - ahead[n])
    return ahead[n]


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -np.inf else a + math.log1p(math.exp(b - a))


def _hash64(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def word_counts(documents: DataFrame, training: Column, kind: Column, kinds: int) -> DataFrame:
    """(word, c0, c1, ...): every word of all documents, with its numbers in the training ones of each class."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[dict[bytes, int]] = [{} for _ in range(kinds)]
        for text, learn, k in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            held = counts[k]
            if learn:
                for w in words_of(text):
                    held[w] = held.get(w, 0) + 1
            else:
                for w in words_of(text):
                    held.setdefault(w, 0)
        words = pa.array([w for held in counts for w in held], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([k for k, held in enumerate(counts) for _ in held], pa.int32()), pa.array([c for held in counts for c in held.values()], pa.int64())], names=["word", "k", "c"])

    rows = documents.select(F.col("text").cast("string").alias("text"), training.alias("learn"), kind.alias("k"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                yield from chunks(run(part))

    found = rows.mapInArrow(parts, "word string, k int, c long")
    return found.groupBy("word").agg(*(F.sum(F.when(F.col("k") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(kinds)))


def expected_pieces(words: DataFrame, models: list[Pieces], p: LatticeParams) -> np.ndarray:
    """For each class, the pieces' expected numbers in its distinct training words: a row for each piece comes to the driver, no more."""
    shared = words.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value), len(shared.value[0].log)))
        for block in _blocks(batches):
            texts = np.array(block.column(0).to_pylist(), object)
            for k, pieces in enumerate(shared.value):
                own = texts[np.asarray(block.column(k + 1)) > 0].tolist()
                total[k] += score_words([pieces], own, True, p.longest_batched)[1][0]
        kind, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[kind, piece])], names=["kind", "piece", "mass"])

    out = np.zeros((len(models), len(models[0].log)))
    for kind, piece, mass in words.mapInArrow(run, "kind int, piece int, mass double").groupBy("kind", "piece").agg(F.sum("mass")).collect():
        out[kind, piece] = mass
    return out


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 150_000) -> Iterator[pa.Table]:
    """Batches put together: words of one length are scored at once, so more of them cost less."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def score_documents(documents: DataFrame, training: Column, params: LatticeParams | None = None, class_column: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    p, spark = params or LatticeParams(), documents.sparkSession
    sc = spark.sparkContext
    named: list[str] = []
    if class_column:
        sizes = documents.where(training & F.col(class_column).isNotNull()).groupBy(class_column).count()
        named = [x[0] for x in sizes.orderBy(F.desc("count"), class_column).limit(p.classes).collect()]
    kind = F.coalesce(*[F.when(F.col(class_column) == x, F.lit(k)) for k, x in enumerate(named)], F.lit(len(named)))
    found = dict(documents.where(training).groupBy(kind.alias("k")).count().collect())
    kinds = max([len(named), 1, *(k + 1 for k in found)])  # none for the others where there are none
    kind = F.least(kind, F.lit(kinds - 1))
    ends = np.array([found.get(k, 0) for k in range(kinds)], float)
    words = materialize(word_counts(documents, training, kind, kinds), "lattice-words")
    cs = [F.col(f"c{k}") for k in range(kinds)]
    every_c = sum(cs[1:], cs[0])
    counted = words.agg(F.count(F.when(every_c > 0, 1)), *(x for c in cs for x in (F.coalesce(F.sum(c), F.lit(0)), *(F.count(F.when(rule, 1)) for rule in (c > 0, c == 1, c == 2))))).first()
    v_words, by_kind = counted[0], np.array(counted[1:], float).reshape(kinds, 4)
    n = int(by_kind[:, 0].sum() + ends.sum())
    v = v_words + (1 if ends.sum() else 0)
    pieces = Pieces.load(p.vocabulary)
    models = [copy.copy(pieces) for _ in range(kinds)]  # they share all but the weights
    for _ in range(p.rounds if v_words else 0):
        for k, mass in enumerate(expected_pieces(words, models, p)):
            mass[models[k].stop] += by_kind[k, 1]
            models[k].weigh(mass + p.prior * models[k].prior)
    once, twice = by_kind[:, 2], by_kind[:, 3]
    discount = np.clip((once + 1) / (once + 2 * twice + 2), 0.1, 0.95)
    free, total = discount * by_kind[:, 1] + 1, by_kind[:, 0] + ends + 1  # one more for the pieces, so that they always have some
    share = np.log10((ends + 1e-3) / (ends + 1e-3).sum())
    shared = sc.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            texts = block.column(0).to_pylist()
            counts = np.array([np.asarray(block.column(k + 1)) for k in range(kinds)], float)
            logs = np.empty((len(texts), kinds), np.float32)
            spelled, _ = score_words(shared.value, texts, False, p.longest_batched)
            for k in range(kinds):
                seen = np.where(counts[k] > 0, np.log(np.maximum(counts[k] - discount[k], 1e-300) / total[k]), NEVER)
                logs[:, k] = np.logaddexp(seen, np.log(free[k] / total[k]) + spelled[k]) / np.log(10)
            hashes = np.fromiter((_hash64(w.encode()) for w in texts), np.int64, len(texts))
            yield from chunks(pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts.sum(axis=0).astype(np.int64)), *(pa.array(logs[:, k]) for k in range(kinds))], names=["h", "c", *(f"lp{k}" for k in range(kinds))]))

    scored = materialize(words.mapInArrow(score, "h long, c long, " + ", ".join(f"lp{k} float" for k in range(kinds))), "lattice-scored")
    common = scored.where(F.col("c") * p.frequent > n).toArrow().sort_by("h")
    free_shuffles(spark)
    known = sc.broadcast([np.asarray(x) for x in common.columns])
    every = n + v + 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cs, *lps = known.value
        facts = [np.ones(len(keys)), np.log10((cs + 1) / every), *lps]
        for batch in (part for whole in batches for part in slices(whole, 2)):
            ids: dict[bytes, int] = {}
            coded = [np.fromiter((ids.setdefault(w, len(ids)) for w in words_of(t)), np.int64) for t in as_bytes(batch.column(2))]
            hashes = np.fromiter(map(_hash64, ids), np.int64, len(ids))
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            is_common = keys[at] == hashes if len(keys) else np.zeros(len(ids), bool)
            size = np.array([len(x) for x in coded], np.int64)
            doc = np.repeat(np.arange(len(coded)), size)
            flat = np.concatenate(coded) if len(coded) else np.empty(0, np.int64)
            common_here = is_common[flat]
            where = at[flat[common_here]]
            sums = [np.bincount(doc[common_here], x[where], minlength=len(coded)) for x in facts]
            rare, tf = np.unique(doc[~common_here] * max(len(ids), 1) + flat[~common_here], return_counts=True)
            rare_doc, rare_word = rare // max(len(ids), 1), rare % max(len(ids), 1)
            rows, docs = batch.column(0), batch.column(1)
            # a document's own row has a key of its own that no word has: it spreads, and meets nothing
            own = np.fromiter((_hash64(b"\x00%d" % r) for r in rows.to_pylist()), np.int64, len(coded))
            # its sums go in one list, so that the rows of rare words stay narrow
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(coded) + 1, dtype=np.int32) * (1 + len(sums))), pa.array(np.column_stack([size + 1, *sums]).astype(float).ravel()))
            made = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([rows, rows.take(pa.array(rare_doc))]),
                    pa.concat_arrays([docs, pa.nulls(len(rare), pa.int64())]),
                    pa.array(np.concatenate([own, hashes[rare_word]])),
                    pa.concat_arrays([pa.nulls(len(coded), pa.int32()), pa.array(tf, pa.int32())]),
                    pa.concat_arrays([lists, pa.nulls(len(rare), lists.type)]),
                ],
                names=["row", "doc_id", "h", "tf", "own"],
            )
            yield from chunks(made)

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.mapInArrow(gather, "row long, doc_id long, h long, tf int, own array<double>").join(scored.where(F.col("c") * p.frequent <= n), "h", "left")
    c = F.coalesce("c", F.lit(0))
    part = F.col("tf").isNotNull()
    own = [F.get("own", F.lit(k)) for k in range(3 + kinds)]
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(own[0]).cast("long").alias("n_tokens"),
        F.sum(F.when(part, F.when(c > 0, F.col("tf")).otherwise(0)).otherwise(own[1])).alias("known"),
        F.sum(F.when(part, F.col("tf") * F.log10((c + 1) / F.lit(float(every)))).otherwise(own[2])).alias("base"),
        *(F.sum(F.when(part, F.col("tf") * F.col(f"lp{k}").cast("double")).otherwise(own[3 + k])).alias(f"s{k}") for k in range(kinds)),
    )
    end_logs = share + np.log10(np.maximum(ends, 1e-3) / total)
    by_class = [F.col(f"s{k}") + float(end_logs[k]) for k in range(kinds)]
    most = F.greatest(*by_class) if kinds > 1 else by_class[0]
    mixed = most + F.log10(sum((F.pow(F.lit(10.0), x - most) for x in by_class), F.lit(0.0)))
    return sums.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + (1 if ends.sum() else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10((ends.sum() + 1) / every))).alias("base_score"),
        mixed.alias("score"),
    )


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of(F.col("doc_id"), 7)
    scored = score_documents(table(spark, sf_dir, "documents"), fold != 2, class_column="lang")
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
