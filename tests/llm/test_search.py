"""Top-k search, decontamination, mixing and wrappers against plain versions."""

import collections
import itertools
import math
import random
import re

import pytest

from sylvan.llm import decontamination, mixing, topk, wrappers


def test_topk_matches_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(40)], i) for i in range(300)]
    rows += [(1000, None, 0), (1001, [1.0] * 39 + [None], 0), (1002, [1.0] * 39 + [math.nan], 0), (1003, [math.inf] + [0.0] * 39, 0), (1004, [0.5] * 7, 0), (1100, [0.25] * 7, 0), (None, [1.0] * 40, 0), (1200, [], 0), (1005, [-math.inf] * 40, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    import numpy as np

    fine = {i: [math.floor(float(np.float32(x)) * 1024) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in fine:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(fine[q], fine[c], strict=True)), c) for c in fine if c != q and len(fine[c]) == len(fine[q]))
            want += [(q, k, c, -s) for k, (s, c) in enumerate(scored[:10], 1)]
    for params in ({}, {"query_block": 1, "width": 3}):
        got = topk.top_k(df, **params)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(huge).orderBy("rank").collect()] == [1, 2]


def _item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def _report(docs, items):
    windows = collections.defaultdict(set)
    for name, text in items:
        words = _item_words(text)
        if words and name is not None:
            n = min(8, len(words))
            for i in range(len(words) - n + 1):
                windows[tuple(words[i : i + n])].add(name)
    out = []
    for doc, text in docs:
        words, hit, found = _item_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    found |= windows[tuple(words[i : i + n])]
                    hit |= set(range(i, i + n))
        out.append((doc, len(words), len(hit), len(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_decontamination_matches_all_windows(spark, seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "é", "7", "dd"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, say(rng.choice([2, 5, 8, 9, 20]))) for i in range(12)] + [(3, say(9)), (50, None), (51, "!!"), (None, say(9))]
    docs = [(i, say(rng.randint(0, 40)).upper() + (rng.choice(items)[1] or "")) for i in range(40)] + [(90, None), (91, ""), (91, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination_report(d, b)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()), key=str) == _report(docs, items)
    blocks = decontamination.scan_benchmark(d, b, block_words=25)
    assert sorted(((r.doc_id, len(r.bench_items)) for r in blocks.collect()), key=str) == sorted(((x[0], x[3]) for x in _report(docs, items)), key=str)


def test_decontamination_cuts_and_drops(spark):
    passage = "one two three four five six seven eight nine"
    items = spark.createDataFrame([(1, passage), (2, "k l m n o p q r s t")], "item_id long, text string")
    clean = "this text has nothing to do with any of the others at all, truly, and it goes on for long enough"
    docs = [(1, f"{clean}. {passage.upper()}! {clean}", "s"), (2, f"{clean} {passage} k l m n o p q r s t", "s"), (3, clean, "s"), (4, passage, "s"), (5, None, None)]
    got = {r.doc_id: r.text for r in decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, hits string"), items).collect()}
    assert got == {1: f"{clean}. ! {clean}", 3: clean, 5: None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination_report(spark.createDataFrame(docs, "doc_id long, text string, n_items string"), none).where("n_hit > 0").count() == 0


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        more = {s for s in free if share[s] > 3 * sizes[s]}
        if not more:
            return {s: share.get(s, 3 * sizes[s]) for s in order}
        capped |= more


@pytest.mark.parametrize("seed", range(1))
def test_mixing_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "Z", "é", None, "tiny"]
    rows = [(i, " ".join("w" * 1 for _ in range(rng.choice([0, 1, 5, 50, 300]))), rng.choices(names, [50, 5, 5, 20, 1, 3, 0.3])[0]) for i in range(400)] + [(900, None, "a"), (901, "w", "lone"), (901, "w", "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = _targets(sizes)
    by_size = {(s, round(want[s], 6)) for s in want}
    for block in (7, 1024):
        got = mixing.mix_report(df.repartition(4), mixing.MixParams(block=block, rows_per_bucket=16)).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
        again = mixing.mix_report(df.repartition(2), mixing.MixParams(block=block, rows_per_bucket=16)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, again))
        source = {i: s for i, _, s in rows}
        taken = collections.Counter()
        for r in got:
            taken[source[r.doc_id]] += r.taken
            assert (source[r.doc_id], round(r.target, 6)) in by_size
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert mixing.mix_report(spark.createDataFrame([], "doc_id long, text string, source string, target int")).count() == 0


def test_mixing_interleaves_sources(spark):
    df = spark.createDataFrame([(i, "w " * 100, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    pieces, placed = mixing.mix_sources(df, mixing.MixParams(block=100))
    rows = pieces.join(placed.select("row_no", "source_no"), "row_no").orderBy("slot").collect()
    for k in range(30, len({r.slot for r in rows}), 30):  # every prefix is near 1 : 2
        first = [r for r in rows if r.slot < k]
        share = sum(r.n for r in first if r.source_no == 2) / sum(r.n for r in first)
        assert abs(share - 2 / 3) < 0.06


PAGES = {
    "nav": '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><article><h1>Head &amp; more</h1><p>One <b>two</b>\n three.<p>Four<br>five</article><div class="comments"><p>nice</p></div><footer>(c)</footer></body></html>',
    "bare": '<html><body><div id="menu"><a href="/">Home</a></div><div class="text"><p>{}</p><p>Body {} of it, long enough to be the text.</p></div><div class="sidebar">Same</div><p>Same words on all pages.</p></body></html>',
}


def test_wrappers(spark):
    rows = [(1, "http://x.example/a", PAGES["nav"]), (2, None, PAGES["nav"]), (3, "http://x.example/b", None), (4, "http://x.example/c", "")]
    rows += [(10 + i, f"https://y.example/{i}", PAGES["bare"].format(f"Title {i}", i)) for i in range(5)]
    rows += [(30, "z", "<article><p>cut &am"), (31, "z", "plain"), (32, "z", "<div>" * 3000 + "deep"), (33, "z", "<article><script>var a='</p>';</script><form>f</form><p>x&lt;y</p></article>")]
    got = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "Head & more One two three. Four five"
    assert got[3] == got[4] == ""
    assert got[12] == "Title 2 Body 2 of it, long enough to be the text."
    assert got[30] == "cut &am" and got[31] == "plain" and got[32] == "deep" and got[33] == "x<y"
    joined = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), wrappers.WrapperParams(broadcast_hosts=0))
    assert {r.page_id: r.text for r in joined.collect()} == got
    assert wrappers.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _texts(pages, p=wrappers.WrapperParams()):
    """The texts of a host's pages, in plain Python."""
    held = None
    for page in pages:
        held = wrappers.align(held, wrappers.wrapper_of(wrappers.parse(page), p), p)
    rule = wrappers.content_rule(held)
    return [wrappers.main_text(x, rule) for x in pages]


def test_all_articles_of_a_page_are_joined():
    page = '<body><article class="lead"><p>One {0}</p></article><article><p>two and more {0}</p></article><article class="teaser"><p>Read this other story, longer than all</p></article><article class="comment"><p>nice</p></article></body>'
    assert _texts([page.format(i) for i in range(4)])[2] == "One 2 two and more 2"
    assert _texts(['<article class="teaser"><p>alone</p></article>']) == ["alone"]
    blocks = '<body><div class="text"><p>Part one of {0}, long enough.</p></div><hr><div class="advert">x</div><div class="text"><p>And part two of {0}.</p></div></body>'
    assert _texts([blocks.format(i) for i in range(4)])[1] == "Part one of 1, long enough. And part two of 1."


def test_long_lists_keep_all_children():
    name = lambda k: "".join(chr(97 + int(d)) for d in f"{k:03}")
    block = lambda k, text: f'<div id="{name(k)}"><p>{text}</p></div>'
    # more signatures than a list holds, all different on every page, before the text and a notice that all pages have
    page = lambda i: "<body>" + "".join(block(100 * i + k, f"a{i}") for k in range(100)) + f'<section><p>Text of {i}.</p></section><div id="zzz">Same</div></body>'
    got = _texts([page(i) for i in range(5)])
    assert got == _texts([page(i) for i in (3, 4, 0, 2, 1)])[2:3] + got[1:] and all(x == "a%d " % i * 100 + f"Text of {i}." for i, x in enumerate(got))
    # the same signatures on all pages, more than a list holds: the last has the text
    long = lambda i: "<body>" + "".join(block(k, "Same") for k in range(200)) + f"<section><p>Text of {i}, which is all.</p></section></body>"
    assert _texts([long(i) for i in range(4)])[3] == "Text of 3, which is all."


def test_copies_of_a_page_keep_their_text(spark):
    page = '<body><div id="menu">Home</div><h1>Head</h1><div class="text"><p>{}</p></div><div>Notice</div></body>'
    for texts, want in ((["Copy."] * 6, "Head Copy. Notice"), (["Copy."] * 6 + ["Other."], "Head Copy. Notice"), (["Copy."] * 6 + ["Other.", "Third."], "Copy.")):
        rows = [(i, "http://c.example/", page.format(t)) for i, t in enumerate(texts)]
        got = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
        assert len(got) == len(rows) and {r.text for r in got if r.page_id < 6} == {want}


@pytest.mark.parametrize(
    "inside, want",
    [
        ('<svg class="i"/>', "a b c"),
        ("<math/>", "a b c"),
        ('<svg/><p>x</p><svg><title>T</title><path d="m"/></svg>', "a x b c"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "a x = 1 b c"),
        ('<object data="f"><p>instead</p></object>', "a instead b c"),
        ("<iframe src='f'>", "a b c"),
        ("<svg>", "a b c"),
        ("<textarea>in</textarea>", "a b c"),
        ("<script>s", "a"),
    ],
)
def test_raw_elements_end_where_they_should(inside, want):
    page = f"<article><p>a</p>{inside}<p>b</p></article><article><p>c</p></article>"
    assert wrappers.main_text(page, wrappers.NO_RULE | {"path": ["article"]}) == want


def _plain_pages(n):
    """Pages of one host whose markup says nothing: divs without names, the frame the same, the text and an optional part their own."""
    rng = random.Random(n)
    say = lambda k: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(k))
    pages, want = [], []
    for k in range(n):
        parts = [say(30) for _ in range(rng.randint(2, 6))]
        extra = say(25) if k % 2 else ""
        pages.append(f"<html><body><div><div>Home</div><div>All about us</div></div><div><div>{'</div><div>'.join(parts)}</div>{f'<blockquote>{extra}</blockquote>' if extra else ''}</div><div>Write to the owner</div></body></html>")
        want.append(" ".join([*parts, *([extra] if extra else [])]))
    return pages, want


def test_the_wrapper_tells_content_where_names_do_not():
    pages, want = _plain_pages(8)
    assert _texts(pages) == want
    without = [wrappers.main_text(x, wrappers.NO_RULE) for x in pages]
    assert all(a != b and b in a for a, b in zip(without, want, strict=True))


def test_slots_outweigh_names():
    """An article element that is the same on all pages is no content where another element's texts differ."""
    pages, want = _plain_pages(6)
    framed = [x.replace("<div>Write to the owner</div>", "<article>Win a prize today</article>") for x in pages]
    assert _texts(framed) == want


@pytest.mark.parametrize("seed", range(5))
def test_alignment_is_a_longest_common_subsequence(seed):
    """The streams of two pages against all subsequences; and each page fits the expression made of both."""
    rng = random.Random(seed)
    p = wrappers.WrapperParams()
    for _ in range(40):
        one, two = ([rng.choice("abcd") for _ in range(rng.randint(0, 6))] for _ in "12")
        a, b = ([[x, 0, 1, None, 0, []] for x in side] for side in (one, two))
        got = wrappers._merged(a, b, p)
        common = lambda s, t: max((len(c) for k in range(len(s) + 1) for c in itertools.combinations(s, k) if _inside(c, t)), default=0)
        together = [n for n in got if not n[1] & (wrappers.OPTIONAL | wrappers.REPEATED)]
        if not any(n[1] & wrappers.REPEATED for n in got):
            assert len(together) == common(one, two) and len(got) == len(one) + len(two) - len(together)
        pattern = "".join("(?:" + n[0] + ")" + ("*" if n[1] & wrappers.REPEATED else "?" if n[1] & wrappers.OPTIONAL else "") for n in got)
        if not any(n[1] & wrappers.REPEATED for n in got):
            assert all(re.fullmatch(pattern, "".join(side)) for side in (one, two))


def _inside(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def test_deep_nesting_keeps_comments_out():
    deep = "<div>" * 400 + "the article <section class='comments'><div>a reader says</div></section> goes on" + "</div>" * 400
    page = f"<body><article><p>It begins.</p>{deep}<p>It ends.</p></article><footer>foot</footer></body>"
    assert wrappers.main_text(page, wrappers.NO_RULE | {"path": ["article"]}) == "It begins. the article goes on It ends."
