"""Classifiers and the language model: against brute force, or by held-out accuracy."""

import itertools
import math
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm import langid, lattice, quality, toxicity
from sylvan.llm.common import add_up, fold_of, whole

SF = "/root/testdata/sf0.01"


def test_folds(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 1, 77, 123456789, -5)], "doc_id long").withColumn("f", fold_of(F.col("doc_id"), 7))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 7 for r in df.collect())
    assert spark.sql("select cast(null as bigint) as d").select(fold_of(F.col("d"), 3)).first()[0] == -1


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, fold_of(F.col("doc_id"), 3) != 1, langid.LangParams(docs_per_language=60))
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold_of(F.col("doc_id"), 3) == 1).collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 !?", 1), (4, "Ω" * 5, 1)], "doc_id long, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.languages
    none = langid.fit(docs.limit(0), F.lit(True))
    assert [r.lang_pred for r in langid.identify(odd, none).collect()] == ["und"] * 4


def test_spans_follow_viterbi():
    rng = np.random.default_rng(1)
    for _ in range(20):
        scores = rng.normal(size=(6, 3)).astype(np.float32)
        words = rng.integers(0, 6, 7)
        best = max(itertools.product(range(3), repeat=7), key=lambda path: sum(scores[w, k] for w, k in zip(words, path, strict=True)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path)))
        other = rng.integers(0, 6, 3)
        got = langid.spans(scores, [other, words], 1.5)[1]
        assert tuple(got) == best


def _brute(pieces, word):
    """Sum over all ways to cut the word into pieces and bytes."""
    marked, total = lattice.MARK + word, 0.0
    n = len(marked)
    for cuts in itertools.product([0, 1], repeat=n - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
        options = []
        for a, b in itertools.pairwise(at):
            part, ways = marked[a:b], []
            if part in pieces.index:
                ways.append(pieces.log[pieces.index[part]])
            if b - a == 1 and a:
                ways.append(sum(pieces.log[k] for k in lattice._byte_ids(pieces, ord(part))))
            options.append(ways)
        for ways in itertools.product(*options):
            total += math.exp(sum(ways))
    return math.log(total) + pieces.log[pieces.stop]


def test_lattice_sums_all_segmentations():
    names = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "é", "abab"]
    pieces = lattice.Pieces(names, [-float(i) for i in range(len(names))])
    words = ["a", "ab", "abab", "bé", "aab", "x😀", "babab"]
    for longest in (40, 0):  # in batches, and one by one
        got, mass = lattice.score_words([pieces, pieces], words, True, longest)
        assert np.allclose(got[0], [_brute(pieces, w) for w in words])
        assert np.allclose(got[0], got[1])
        assert np.isclose(mass[0][[i for i, n in enumerate(pieces.names) if n[0] == "▁"]].sum(), len(words))
    first = np.exp(pieces.log[pieces.first]).sum()
    assert np.isclose(first, 1) and np.isclose(np.exp(pieces.log[~pieces.first]).sum(), 1)


@pytest.mark.parametrize("frequent", [1, 1 << 18])
def test_language_model_digest(spark, frequent):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "é", "zx9"]) for _ in range(rng.randint(0, 9))), rng.choice(["en", "fr", None])) for i in range(60)]
    rows += [(100, None, "en"), (101, "unseen words", None), (102, "x" * 80, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = F.col("doc_id") % 7 != 2
    got = {r.doc_id: r for r in lattice.score_documents(df, learn, lattice.LatticeParams(frequent=frequent), "lang").collect()}
    counts = {}
    for i, t, _ in rows:
        if i % 7 != 2:
            for w in [*(t or "").lower().split(), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        tokens = [*(t or "").lower().split(), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens), abs_tol=1e-6)
        assert r.score < 0
    assert lattice.score_documents(df.limit(0), learn, class_column="lang").count() == 0


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold_of(F.col("doc_id"), 4) != 2)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a", 0)], "doc_id long, text string, score int")
    assert all(0 <= r.tox_score <= 1 and r.tox_predicted == int(r.tox_score >= 0.3) for r in toxicity.score_toxicity(odd, model).collect())
    got = toxicity.score_toxicity(docs.select("doc_id", "text", "lang"), model).join(labels, "doc_id").where((fold_of(F.col("doc_id"), 4) == 2) & (F.col("lang") == "en")).collect()
    toxic, clean = [r.tox_score for r in got if r.toxic == 1], [r.tox_score for r in got if r.toxic == 0]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95
    bare = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert toxicity.score_toxicity(odd, bare).agg(F.max("tox_score")).first()[0] == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """Each text is a word of its own: those that training has seen score above others, and but for the held-back quarter these are all."""
    rng = random.Random(8)
    words = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(2)) for _ in range(4100)]
    docs = spark.createDataFrame([(i, w, "zh") for i, w in enumerate(words)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 1800)) for i in range(3600)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.tox_score for r in toxicity.score_toxicity(docs, model).collect()}
    unknown = np.quantile([got[i] for i in range(3600, 4100)], 0.95)
    assert sum(got[i] > unknown for i in range(1800)) > 1250


def test_toxicity_lets_go_of_shuffles_as_it_learns(spark, monkeypatch):
    """Of the texts once they are coded, and of each pass: else what all passes shuffle lies on disk together."""
    made, add, free = [], toxicity.add_up, toxicity.free_shuffles
    monkeypatch.setattr(toxicity, "add_up", lambda rows: made.append("add") or add(rows))
    monkeypatch.setattr(toxicity, "free_shuffles", lambda session: made.append("free") or free(session))
    docs = spark.createDataFrame([(i, f"{'bad' if i % 3 == 0 else 'good'} w{i}", "en") for i in range(300)], "doc_id long, text string, lang string")
    params = toxicity.CnnParams(epochs=2)
    monkeypatch.setattr(toxicity, "discard", lambda df: df is None or made.append({f.split(".", 1)[1] for f in df.inputFiles()}))
    toxicity.fit(docs, docs.selectExpr("doc_id", "if(doc_id % 3 = 0, 1, 0) as toxic"), F.lit(True), params)
    assert made[:6] == ["free", "add"] + ["add", "free"] * params.epochs
    assert {"zstd.parquet"} in made  # units take less room so


def test_toxicity_units_and_repeats(spark):
    """Equal rows count once; the units hold every labelled row, however many they are; numbers are those of the texts."""
    rows = [(i, f"{'bad' if i % 3 == 0 else 'good'} w{i} end", "en" if i % 2 else None) for i in range(200)]
    docs = spark.createDataFrame([*rows, *rows[:50], (7, None, "de"), (900, "unlabelled", "en")], "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, y int")
    one = docs.join(marks, "doc_id").selectExpr("pmod(doc_id, 3) as shard", "xxhash64(doc_id, text) as h", "y", "lang", "coalesce(text, '') as text").repartition(2, "shard").sortWithinPartitions("shard", "h", "lang")
    for most in (16_000_000, 100):
        units = toxicity._code(one, toxicity.CnnParams(unit_bytes=most), ["en"], True).cache()
        found = add_up(units.where("kind not in ('learn', 'judge')"))
        made = [(r.kind, r.unit, pickle.loads(bytes(r.data))) for r in units.where("kind in ('learn', 'judge')").collect()]
        assert (len({n for _, n, _ in made}) == 3) == (most > 100)
        held = sum(len(u.kept) for kind, _, u in made if kind == "judge")
        assert 20 < held < 100 and sum(len(u.labels) for _, _, u in made) == 201
        numbers = whole(found["rows"], 4)
        assert numbers.tolist()[:3] == [201, 67, held]
        bad, size = int(toxicity.features([b"bad"])[0, 0]) * toxicity.KINDS, toxicity.BUCKETS * toxicity.KINDS
        assert whole(found["seen"], size)[bad] == whole(found["hit"], size)[bad] == 67 - numbers[3]
        assert np.allclose(whole(found["grams en"], langid.COUNTS), langid.text_counts([t for _, t, x in rows if x == "en"], 4))


def test_toxicity_features_are_of_leading_characters():
    got = toxicity.features([b"abcdefghij", b"(abcdefghij!)", b"abcdexxxxx", "äb€d".encode(), "äb€".encode(), b"ab", b"", b"\xff"])
    assert got.shape == (8, toxicity.KINDS) and got.min() >= 0 and got.max() < toxicity.BUCKETS and np.array_equal(got[0], got[1])
    assert (got[0] == got[2]).tolist() == [False] + [n <= 5 for n in toxicity.PREFIXES]
    assert (got[3] == got[4]).tolist() == [False] + [n <= 3 for n in toxicity.PREFIXES]
    assert len(set(got[5].tolist())) == toxicity.KINDS


def test_toxicity_parts_of_a_unit_join():
    texts = [b"a b a", b"c", b"", b"b c d e"]
    parts = [toxicity.Unit.of([(0, 1, None, t) for t in some], True) for some in (texts[:1], texts[1:3], texts[3:])]
    unit, want = toxicity.Unit.joined(parts), toxicity.Coded(texts)
    assert len(unit.features) == 5 and unit.kept == texts and len(unit.labels) == 4
    for got, text in zip(unit.texts, want.texts, strict=True):
        assert np.array_equal(unit.features[got], want.features[text])


def test_text_counts_are_those_of_learning():
    texts = ["Das ist, das war", "η γλώσσα", "", "das x" * 30]
    p = langid.LangParams()
    slow = langid.LanguageModel(p, ["a"])
    for t in texts:
        slow.learn("a", t)
    fast = langid.text_counts(texts, p.longest_gram, block=3)
    assert np.array_equal(fast, np.concatenate([slow.counts[:, 0], slow.scripts[:, 0]]))


def _small_network():
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel(toxicity.CnnParams())
    words = [b"w%d" % k for k in range(30)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 30, n)) for n in (0, 1, 2, 3, 17, 60)]
    coded = toxicity.Coded(texts)
    model.table += rng.normal(0, 0.3, model.table.shape).astype(np.float32)
    return model, coded


def test_toxicity_logits_of_a_block_are_those_of_its_texts():
    model, coded = _small_network()
    want = [float(model._forward(model._pad(coded, k))[0] @ model.out + model.offset) for k in range(len(coded.texts))]
    for block in (1, 5, 10_000):
        assert np.allclose(model.logits(coded, block), want, atol=1e-4)


def test_toxicity_gradients_of_a_batch_are_the_sum_of_its_texts():
    model, coded = _small_network()
    part, labels, weights = np.array([5, 0, 3, 4, 2]), np.array([1.0, 0, 1, 0, 0]), np.array([0.3, 0.1, 0.2, 0.5, 0.4])
    grads, want = ({key: np.zeros_like(v) for key, v in model.dense().items()} for _ in range(2))
    touched = []
    offset = sum(model.gradients(coded, k, y, x, want, touched) for k, y, x in zip(part, labels, weights, strict=True))
    got, rows, pull = model.batch_gradients(coded, part, labels, weights, grads)
    tables = np.zeros((2, *model.table.shape))
    for at, g in touched:
        np.add.at(tables[0], at, g)
    for at, g in zip(rows, pull, strict=True):
        np.add.at(tables[1], at, g)
    assert np.isclose(got, offset) and np.allclose(tables[0], tables[1], atol=1e-6) and tables[0].any()
    assert all(np.allclose(grads[key], want[key], atol=1e-5) for key in grads)


def test_toxicity_gradients_by_finite_differences():
    model, coded = _small_network()
    for name in ("table", "out", "offset"):
        setattr(model, name, np.asarray(getattr(model, name), np.float64))
    model.filters = {w: f.astype(np.float64) for w, f in model.filters.items()}
    model.bias = {w: b.astype(np.float64) + 0.3 for w, b in model.bias.items()}
    k, y = 4, 1.0
    model._pad = lambda c, i: np.concatenate([np.zeros((2, 12)), model.table[c.features[c.texts[i]]].sum(axis=1), np.zeros((2, 12))])

    def loss():
        z = model._forward(model._pad(coded, k))[0] @ model.out + model.offset
        return math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z))

    dense = model.dense()
    grads, touched = {key: np.zeros_like(v) for key, v in dense.items()}, []
    model.gradients(coded, k, y, 1.0, grads, touched)
    table = np.zeros_like(model.table)
    for rows, g in touched:
        for r in rows:
            table[r] += g
    rng, step = np.random.default_rng(0), 1e-6
    for values, got in [*((dense[key], grads[key]) for key in dense), (model.table, table)]:
        used = np.flatnonzero(got) if got is table else np.arange(got.size)
        for at in rng.choice(used, 8):
            was = values.flat[at]
            values.flat[at] = was + step
            up = loss()
            values.flat[at] = was - step
            down = loss()
            values.flat[at] = was
            assert math.isclose((up - down) / (2 * step), got.flat[at], rel_tol=1e-3, abs_tol=1e-6)


def test_samples_are_bounded_and_blind_to_repeats(spark):
    from sylvan.llm.common import fit_in_task, sample_by_kind

    rows = [("a", i, f"text {i}") for i in range(900)] + [("b", 7, "the same")] * 500 + [("c", i, "x" * 100) for i in range(5)]
    df = spark.createDataFrame(rows, "kind string, doc_id long, text string")
    got = [sorted(tuple(r)[:3] for r in sample_by_kind(df.repartition(n), 50).collect()) for n in (2, 7)]
    assert got[0] == got[1]
    assert {k: sum(r[0] == k for r in got[0]) for k in "abc"} == {"a": 50, "b": 1, "c": 5}
    assert fit_in_task(sample_by_kind(df, {"c": 9}), ["h"], lambda t: t.num_rows, 350) == 3
    assert fit_in_task(df.limit(0), ["doc_id"], lambda t: t.num_rows, 350) == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, fold_of(F.col("doc_id"), 5) != 3, quality.CoTrainParams(pool=300, exchanged=30))
    got = quality.score_quality(docs, model).join(labels, "doc_id").where(fold_of(F.col("doc_id"), 5) == 3).collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en")], "doc_id long, text string, source string, lang string")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(odd, model).collect())
    none = quality.fit(docs, labels.limit(0), F.lit(True), quality.CoTrainParams(pool=10))
    assert [r.score for r in quality.score_quality(odd, none).collect()] == [0.5, 0.5]


def test_quality_exchange(spark):
    """One exchange over copies and ties in several tasks is what sorting all different documents gives."""
    p = quality.CoTrainParams(exchanged=7, sure=0.6)
    docs = spark.createDataFrame([(i, f"word{i % 23} {'x' * (i % 5)}", f"s{i % 3}", "en", i % 11) for i in range(120)], "doc_id long, text string, source string, lang string, n_chars long")
    features = quality.featurize(docs).repartition(5).cache()
    rng = np.random.default_rng(0)
    model = quality.CoTrained(p, np.zeros(len(quality.MEASURES)), np.ones(len(quality.MEASURES)))
    model.share, model.curves = 0.3, [(1.0, 0.0), (1.0, 0.1)]
    for m in model.models.values():
        m.w = rng.normal(size=len(m.w))
    rows = features.orderBy("doc_id").toArrow()
    odds = model.log_odds(model.rows([rows.column(c).to_pylist() for c in ("words", "shares", "measured", "page")]))
    hashes = rows.column("h").to_pylist()
    used = {("page", hashes[int(np.argmax(odds[0]))])}
    want = set()
    for mine, other in ((0, "page"), (1, "content")):
        for y, most in ((1, 2), (0, 5)):
            sure = {h: s for h, s in zip(hashes, odds[mine] if y else -odds[mine], strict=True) if s >= np.log(0.6 / 0.4) and (other, h) not in used}
            want |= {(other, y, h) for h, _ in sorted(sure.items(), key=lambda x: (-x[1], x[0]))[:most]}
    got = quality.exchange(features, model, used).collect()
    assert {(r.taught, r.y, r.h) for r in got} == want and len(got) == len(want) > 4


def test_quality_views():
    """Logits of whole tables are those of the rows; the page view does not read the text."""
    p = quality.CoTrainParams()
    rng = np.random.default_rng(2)
    model = quality.CoTrained(p, np.zeros(len(quality.MEASURES)), np.ones(len(quality.MEASURES)))
    columns = [[], [], [], []]
    for text in ("", "a b a\nc", "x"):
        c, v = quality.text_features(text, {})
        for column, value in zip(columns, (c.astype(np.uint16).tobytes(), v.astype(np.float16).tobytes(), quality.measures(text).tolist(), np.array(quality.page_buckets("s", None, 5), np.uint16).tobytes()), strict=True):
            column.append(value)
    rows = model.rows(columns)
    for view, m in model.models.items():
        m.w, m.b = rng.normal(size=len(m.w)), 0.25
        assert np.allclose(rows.logits(view, m), m.logits([rows.row(view, i) for i in range(3)]))
    assert len(set(rows.logits("page", model.models["page"]))) == 1


def test_quality_edges(spark):
    """Empty tables, null and repeated ids, odd and long texts, null metadata, and columns with the operator's own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, h int, y int, taught string, score string"
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1), (9, 1)], "doc_id long, quality int")
    rows = [(1, "a b", "en", "s", 3, 0, 0, "x", "x"), (2, None, None, None, None, 0, 0, None, None), (2, "c " * 40_000, "de", "t", -1, 1, 1, "", ""), (None, "", "", "", 0, 0, 0, "", ""), (3, "퟿ \U0001f600 1|!", "en", "s", 9, 0, 0, "", "")] * 2
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    model = quality.fit(docs, labels, F.lit(True))
    assert model.constant is None
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score_quality(none, model).count() == 0
    empty = quality.fit(none, labels, F.lit(True))
    assert {r.score for r in quality.score_quality(docs, empty).collect()} == {0.5}
