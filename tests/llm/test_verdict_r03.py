"""Cases that lost rows, links or texts before."""

import random

from pyspark.sql import functions as F

from quillmark.llm import near_dedup, quality, toxicity, vector_join


def text(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n))


def changed(t):
    words = t.split()
    words[len(words) // 2] = "other"
    return " ".join(words)


def test_rows_of_one_id_with_unlike_texts_all_stay(spark):
    a, b = text(1), text(2)
    docs = spark.createDataFrame([(7, a, "x"), (7, b, "y"), (8, a, "copy"), (9, text(3), "z"), (None, a, "null")], "doc_id long, text string, source string")
    got = {(r["doc_id"], r["text"], r["source"]) for r in near_dedup.deduplicated(docs).collect()}
    assert got == {(7, a, "x"), (7, b, "y"), (9, text(3), "z"), (None, a, "null")} and near_dedup.deduplicated(docs).columns == docs.columns


def test_repeated_rows_leave_one(spark):
    a = text(1)
    docs = spark.createDataFrame([(7, a), (7, a), (7, changed(a)), (3, a)], "doc_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in near_dedup.deduplicated(docs).collect()] == [(3, a)]
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_any_text_of_an_id_links(spark):
    a, b = text(1), text(2)
    docs = spark.createDataFrame([(7, min(a, b)), (7, max(a, b)), (9, changed(max(a, b))), (11, changed(min(a, b))), (5, text(9))], "doc_id long, text string")
    got = {r["doc"]: (r["cluster"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {7: (7, True), 9: (7, False), 11: (7, False), 5: (5, True)}


def test_labels_with_commas_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, [2.0], "a,1.0"), (2, [1.0, 2.0], "a"), (3, [1.0, 2.0], "a")], "vec_id long, embedding array<double>, label string")
    got = {r["id"]: (r["n_links"], r["component"]) for r in vector_join.near_duplicates(rows).collect()}
    assert got == {1: (0, 1), 2: (1, 2), 3: (1, 2)}


def test_long_labelled_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad junk there ") * 20_000) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] % 2 for r in quality.selected(docs, labels).collect()} == {1}
    assert toxicity.fit(docs, labels.withColumn("doc_id", F.col("doc_id") + 100)) is None  # labels without documents teach nothing
