"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_clean_documents_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF).cache()
        assert kept.columns == COLUMNS, name
        assert 0.6 * docs.count() < kept.count() <= docs.count(), name
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        docs = kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where("taken > 3 * size").count() == 0


def test_planted_cases(spark):
    words = " ".join(f"word{i}" for i in range(60))
    line = "this very line stands in many documents of the corpus"
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, words), (2, words.replace("word7 ", "other ")), (3, "quite another text, " + " ".join(f"x{i}" for i in range(40))), (4, line + "\nfirst has more to say than that"), (5, line + "\nsecond has other things to say, too"), (6, line), (7, f"a text with {item} inside it and then some more"), (8, None), (8, None), (None, "no id but a text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long"), "extra": F.lit(1)})
    stages = dict(corpus_pipeline.STAGES)
    lines = {r.doc_id: r.text for r in stages["line dedup"](spark, docs, SF).collect()}
    assert lines[5] == "second has other things to say, too" and 6 not in lines and {1, 2, 3, 4, 7, 8, None} <= set(lines)
    near = sorted((r.doc_id for r in stages["n-gram Jaccard join"](spark, docs, SF).collect()), key=str)
    assert near == sorted([1, 3, 4, 5, 6, 7, 8, None], key=str)


def test_short_lines_keep_their_document(spark):
    line = "this very line stands in many documents of the corpus"
    rows = [(1, line), (2, line + "\nroses are red\nviolets are blue"), (3, line + "\n\n \t"), (4, "一行诗\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long")})
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_copied_lines(spark, docs, SF).collect()}
    assert got == {1: line, 2: "roses are red\nviolets are blue", 4: "一行诗"}


def test_rows_with_the_same_or_no_id_are_told_apart(spark):
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[2] + " end"), (7, ""), (7, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long")})
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.remove_near_copies(spark, docs.repartition(3), SF).collect()), key=str)
    either = [sorted([(5, texts[0]), (5, texts[1]), (None, t), (7, ""), (None, ""), (None, None)], key=str) for t in (texts[2], texts[2] + " end")]
    assert got in either


def test_stages_begin_with_executors_that_gave_back_memory(spark):
    """Python's workers share an executor's memory with its JVM, which shrinks in a full collection alone."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans

    def collections():
        return sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())

    before = collections()
    corpus_pipeline._documents(spark.read.parquet(f"{SF}/documents.parquet"))
    assert collections() > before
