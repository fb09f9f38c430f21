"""Jaccard join and line deduplication against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sylvan.llm import jaccard, linededup

DOC = "doc_id long, text string"


def _grams(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split()
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _classes(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[a] > label[b] and linked(a, b):
                    label[a] = label[b]
                    changed = True
    return label


def _corpus(rng, n=90):
    vocab = [f"w{i}" for i in range(40)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 6, 12, 40, 120]))] for _ in range(20)]
    shared = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.3:
            words = words + shared
        rows.append((i, " ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, rows[0][1].upper())]


@pytest.mark.parametrize(("seed", "params"), [(1, jaccard.JoinParams()), (2, jaccard.JoinParams(pairs_per_row=0))])
def test_jaccard_matches_all_pairs(spark, seed, params):
    rows = _corpus(random.Random(seed), 60)
    sets = {i: _grams(t) for i, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both > 0 and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)

    want = _classes([i for i, _ in rows], linked)
    df = spark.createDataFrame(rows, DOC).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, params).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i, _ in rows}


def test_jaccard_edge_cases(spark):
    empty = spark.createDataFrame([], DOC + ", region string, n int")
    assert jaccard.jaccard_components(empty).count() == 0
    rows = [(5, "a b c d e f", "x", 1), (5, "a b c d e f", "x", 1), (None, "a b c d e f", None, None), (3, "a b c d e f", "y", 2), (9, None, None, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOC + ", region string, label int"))
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=str) == sorted([(5, 3), (5, 3), (None, None), (3, 3), (9, 9)], key=str)


def test_jaccard_links_the_texts_of_a_repeated_id(spark):
    texts = [" ".join(f"{x}{i}" for i in range(9)) for x in "abcd"]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[0]), (9, texts[1]), (7, texts[2]), (7, texts[3]), (7, None), (8, texts[3])]
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOC).repartition(3)).collect())
    assert got == [(3, 3, 5), (5, 3, 5), (5, 3, 5), (7, 7, 0), (7, 7, 5), (7, 7, 5), (8, 7, 5), (9, 3, 5)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in jaccard.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_within_edits(spark, errors):
    rng = random.Random(errors)
    rows = []
    for _ in range(400):
        a = [rng.choice("abé😀") for _ in range(rng.randint(1, 14))]
        b = list(a)
        for _ in range(rng.randint(0, errors + 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "bb"])
        rows.append(("".join(a), "".join(b) or "a"))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup.within_edits(F.col("a"), F.col("b"), errors).alias("near"))
    assert all(r.near == (_distance(r.a, r.b) <= errors) for r in df.collect())


def test_line_keys_meet(spark):
    """A line within two edits meets another under a key."""
    rng, p = random.Random(5), linededup.LineParams()
    rows = []
    for k in range(60):
        line = [rng.choice("abcdefgh é") for _ in range(rng.randint(27, 60))]
        other = list(line)
        for _ in range(2):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice([[], ["x"], ["x", other[at]]])
        rows += [(2 * k, "".join(line)), (2 * k + 1, "".join(other))]
    lines = spark.createDataFrame(rows, "h1 long, line string").withColumn("chars", F.char_length("line"))
    keys = [lines.select("h1", F.explode(f(F.col("line"), F.col("chars"), p)).alias("key")) for f in (linededup._segment_keys, linededup._probe_keys)]
    own, probes = ({(r.h1, r.key) for r in df.where("key is not null").collect()} for df in keys)
    for k in range(60):
        short, long = sorted((2 * k, 2 * k + 1), key=lambda n: len(rows[n][1]))
        assert {key for n, key in own if n == short} & {key for n, key in probes if n == long}


def test_code_over_all_lines_is_small_enough_to_be_compiled(spark, monkeypatch):
    """The JVM interprets methods of more than 8,000 bytes; over every line, none is near that."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes, write = {}, linededup.materialize

    def measured(df, label):
        stats = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        sizes[label] = max(stats.apply(n)._3().maxMethodCodeSize() for n in range(stats.size()))
        return write(df, label)

    monkeypatch.setattr(linededup, "materialize", measured)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        linededup.duplicate_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), linededup.ALL_LINES)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert max(sizes.values()) < 7000


def test_wide_lines_meet_as_strings_do(spark):
    rng, p = random.Random(7), linededup.LineParams()
    rows = [(k, "".join(rng.choice("abé😀") for _ in range(rng.randint(25, 28)))) for k in range(80)]
    rows += [(100 + k, line[:3] + line[4:]) for k, line in rows]
    lines = spark.createDataFrame(rows, "h1 long, line string").withColumn("chars", F.char_length("line")).withColumn("wide", F.encode("line", linededup.WIDE))
    met = []
    for line, width in (("line", 1), ("wide", linededup.WIDTH)):
        own, probes = (lines.select(F.col("h1").alias(n), F.explode(f(F.col(line), F.col("chars"), p, width)).alias("key")) for n, f in (("a", linededup._segment_keys), ("b", linededup._probe_keys)))
        met.append({tuple(r) for r in own.join(probes, "key").select("a", "b").collect()})
    assert met[0] == met[1] and len(met[0]) > 160


def test_what_is_made_for_each_line_is_compiled_and_made_once(spark, monkeypatch):
    """A text's hashes are made below the step that takes it apart, not for each of its lines; keys are not made inside functions
    over lists, which are interpreted."""
    plans, write = {}, linededup.materialize

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(linededup, "materialize", seen)
    linededup.duplicate_lines(spark.createDataFrame([(1, "a line of some characters and more\nb"), (2, "c")], DOC), linededup.ALL_LINES)
    above, below = plans["lines-distinct"].split("Generate posexplode")
    assert "xxhash64(text" not in above and "xxhash64(text" in below
    assert "xxhash64(line" in above and "transform(" not in above


@pytest.mark.parametrize("seed", [1])
def test_lines_match_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(25, 60))) for _ in range(12)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
            lines.append("".join(line))
        docs.append((i, "\n".join([*lines, "short"])))
    docs += [(98, None), (99, "")]
    where = [(i, k, x) for i, t in docs if t for k, x in enumerate(t.split("\n")) if len(x) >= 25]
    label = _classes(list(range(len(where))), lambda a, b: _distance(where[a][2], where[b][2]) <= 2)
    drops = {}
    for n, (i, k, _) in enumerate(where):
        if label[n] != n:
            drops.setdefault(i, set()).add(k)
    got = linededup.duplicate_lines(spark.createDataFrame(docs, DOC).repartition(3))
    assert {r.doc_id: set(r.drops) for r in got.collect()} == drops
    cleaned = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup_lines(spark.createDataFrame(docs, DOC)).collect()}
    for i, t in docs:
        keep = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drops.get(i, ()))
        assert cleaned[i] == (keep, len(drops.get(i, ())))


def test_lines_edge_cases(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0
    line = "x" * 30
    rows = [(1, line, "k"), (1, line, "k"), (2, line + "\n" + line, "k"), (None, line, None)]
    got = sorted(((r.doc_id, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, DOC + ", key string")).collect()), key=str)
    assert got == sorted([(1, line), (1, line), (2, ""), (None, "")], key=str)


def test_short_lines_go_as_exact_copies(spark, tmp_path):
    long = "a line of more than twenty-five characters"
    rows = [(1, "Les.\n\nx\n" + long), (2, "Les.\n\nLet.\nx"), (3, "own\n \nLes.\n" + long[:-1]), (4, " \nLes."), (5, None)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.op6_linededup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], 4, 0), 2: ("\nLet.", 4, 2), 3: ("own\n ", 4, 2), 4: (" ", 2, 1), 5: (None, 0, 0)}


def test_lines_of_rows_without_an_id_or_with_the_same(spark):
    """Each line stays or goes by its own text and document, all pairs compared; nothing unique is lost."""
    rng = random.Random(5)
    common = [f"{x * 8} is a line that many of the documents have" for x in "abcdef"]
    docs = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"line {i} {k} of its own: {rng.random()}" for k in range(rng.randint(1, 6))]
        docs.append((rng.choice([None, 5, 5, i]), "\n".join(lines), "clash", i))
    ordered = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    df = spark.createDataFrame(docs, DOC + ", drops string, n_lines int").repartition(3)
    got = {}
    for r in linededup.dedup_lines(df).collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped, r.drops))
    assert sum(map(len, got.values())) == len(docs)
    left = [x for rows in got.values() for text, *_ in rows for x in text.split("\n")]
    own = [x for _, t, *_ in docs for x in t.split("\n") if x not in common]
    assert sorted(x for x in left if x and x not in common) == sorted(own)
    used = {x for _, t, *_ in docs for x in t.split("\n") if x in common}
    assert sorted(x for x in left if x in common) == sorted(used)
    # a common line stays in a document of the smallest doc_id that has it
    for x in used:
        keeper = next(d[0] for d in ordered if x in d[1].split("\n"))
        assert any(x in text.split("\n") for text, *_ in got[keeper])
    assert all(d == "clash" and n == text.count("\n") + 1 + k or k for rows in got.values() for text, n, k, d in rows)
