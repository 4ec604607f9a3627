"""What the first round's advice asked for: each test fails on the code before it."""

import random

from pyspark.sql import functions as F

from quillmark.llm import common, quotes, toxicity


def test_toxic_words_of_ordinary_syllables(spark):
    rng = random.Random(5)
    syllables = ["ach", "lich", "keit", "ver", "ung", "ein", "heit", "schaft", "be", "ge", "en", "tz", "pf", "st", "sch", "auf", "zu", "an", "er", "ie", "ab"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    toxic_word = lambda: "achlich" + rng.choice(syllables)
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        text = [word() for _ in range(150)]
        for _ in range(8 if toxic else 0):
            text[rng.randrange(150)] = toxic_word()
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = docs.where(common.remainder("doc_id", 5) == 0).join(labels, "doc_id").withColumn("score", toxicity.score("text", model))
    got = {r["toxic"]: r["found"] for r in held.groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("found")).collect()}
    assert got[1] >= 0.75 and got[0] <= 0.05


def test_quote_of_two_lines_of_four(spark):
    said = "first line\nsecond line\nthird line\nfourth line"
    rows = [
        ("c", 0, "user", said),
        ("c", 1, "assistant", "> second line\n>  Third line\nI agree"),
        ("c", 2, "user", "> second line\n> fourth line\nnot together there"),
        ("d", 0, "user", "one\ntwo\n\nthree"),
        ("d", 1, "assistant", "> two\n> three\na blank line parts them"),
        ("d", 2, "user", "> one\n> two\nyes"),
    ]
    m = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {(r["conv"], r["turn"]): (r["quotes"], r["links"], r["parent"], r["root"]) for r in quotes.conversations(m).collect()}
    assert got == {
        ("c", 0): (0, 0, None, 0), ("c", 1): (1, 1, 0, 0), ("c", 2): (1, 0, None, 2),
        ("d", 0): (0, 0, None, 0), ("d", 1): (1, 0, None, 1), ("d", 2): (1, 1, 0, 0),
    }
