"""Near-dedup, toxicity and quality against brute force, with edge cases."""

import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import common, near_dedup, quality, toxicity

DOCS = "doc_id long, text string, extra string"
#: What learning may hold for a byte of sample text.
LEARNING_BYTES = 20


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 6)), max_size=4))
def test_aligned_equals_plain_lcs(a, edits):
    b = list(a)
    for at, x in edits:
        b.insert(min(at, len(b)), x) if x % 2 else b.pop(min(at, len(b) - 1)) if len(b) > 1 else None
    m = lcs(a, b)
    plain = m / (len(a) + len(b) - m)
    got = near_dedup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
    assert got == pytest.approx(plain if plain >= 0.8 else 0.0)


def shingles(text):
    w = (text or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_clusters(docs):
    over = {i: i for i, _ in docs}

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    s = [(i, shingles(t)) for i, t in docs]
    for n, (i, a) in enumerate(s):
        for j, b in s[:n]:
            m = lcs(a, b)
            if a == b or (a and b and m / (len(a) + len(b) - m) >= 0.8):
                x, y = sorted((root(i), root(j)))
                over[y] = x
    return {i: root(i) for i in over}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs, base = [], [[rng.choice(words) for _ in range(n)] for n in (3, 5, 30, 80, 120)]
    passage = [rng.choice(words) for _ in range(20)]
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append((i, " ".join(t)))
    docs += [(100 + i, " ".join(passage + [rng.choice(words) for _ in range(25)])) for i in range(15)]
    docs += [(200, ""), (201, None), (202, " \n"), (203, docs[0][1].upper()), (204, docs[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(None, "w1", "y"), (204, docs[0][1], "again")], DOCS)
    got = {r["doc"]: (r["cluster"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    want = brute_clusters([(i, t) for i, t in docs])
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(kept == (i == c) for i, (c, kept) in got.items())
    left = near_dedup.deduplicated(df.withColumn("doc", F.lit(1)).withColumn("cluster", F.lit(2)))
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert left.columns == ["doc_id", "text", "extra", "doc", "cluster"] and left.where("doc_id is null").count() == 1


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"v{rng.randrange(5000)}" for _ in range(100)]
    rows = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(100)] = f"u{i}"
        rows.append((i, " ".join(t), ""))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).where("kept").collect()
    assert [r["doc"] for r in got] == [0]


def test_near_copies_on_one_template(spark):
    rng = random.Random(3)
    template = [f"t{i}" for i in range(88)]
    docs = [(i, " ".join(template + [f"o{i}_{j}" for j in range(12)])) for i in range(150)]
    for i in range(1000, 1040, 2):
        own, same = [f"o{i}_{j}" for j in range(12)], rng.randrange(4, 8)
        docs += [(i, " ".join(template + own)), (i + 1, " ".join(template + own[:same] + [f"p{i}_{j}" for j in range(12 - same)]))]
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in docs], DOCS)).collect()
    assert {r["doc"]: r["cluster"] for r in got} == brute_clusters(docs)


def test_near_copies_of_common_shingles_alone(spark):
    """Texts of shared passages in one order, some left out: no shingle is rare, only a few pairs are alike."""
    rng = random.Random(4)
    parts = [[f"q{p}_{j}" for j in range(15)] for p in range(14)]
    docs = []
    for i in range(150):
        taken = sorted(rng.sample(range(14), 8))
        docs.append((i, " ".join(w for p in taken for w in parts[p])))
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in docs], DOCS)).collect()
    assert {r["doc"]: r["cluster"] for r in got} == brute_clusters(docs)


def test_no_pair_of_common_shingles_depends_on_representatives(spark, monkeypatch):
    """Texts of the same six passages with words of their own between these are alike, others aren't; a hundred texts or more hold each passage."""
    monkeypatch.setattr(near_dedup, "BLOCK", 20, raising=False)
    monkeypatch.setattr(near_dedup, "REPRESENTATIVES", 1)
    rng = random.Random(6)
    parts = [" ".join(f"q{p}_{j}" for j in range(60)) for p in range(12)]
    chosen = rng.sample(list(itertools.combinations(range(12), 6)), 300)
    chosen += chosen[:80]
    rows = [(i, "".join(f"{parts[p]} own{i}_{p} " for p in c), "") for i, c in enumerate(chosen)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), samples=4).collect()
    assert {r["doc"]: r["cluster"] for r in got} == {i: chosen.index(c) for i, c in enumerate(chosen)}


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    over = {}

    def root(x):
        while over.setdefault(x, x) != x:
            x = over[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        over[y] = x
    want = {x: root(x) for x in over if any(x in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want


def corpus(n=400):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es", "or", "in"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(8, 60))]
        toxic, good = i % 4 == 0, i % 5 != 1
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["wretchling", "scumbag", "fuzzbrain"]))
        if not good:
            w = [x + rng.choice(["%%%", "###", "&&&"]) for x in w]
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = corpus()
    edge = [(1000, None, ""), (1001, "", ""), (1002, "er on " * 30_000, ""), (None, "th er on", ""), (0, docs[0][1], "again")]
    d, lb = spark.createDataFrame(docs + edge, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], LABELS)
    model = toxicity.fit(d, lb)
    rows = d.withColumn("score", toxicity.score("text", model)).collect()
    assert len(rows) == len(docs) + len(edge) and all(0 <= r["score"] <= 1 for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held]) >= 0.9
    assert all(r["score"] < 0.5 for r in rows if r["doc_id"] in (1000, 1001, 1002))
    assert toxicity.fit(d, lb.where("toxic = 0")) is None
    none = d.limit(0)
    assert none.withColumn("score", toxicity.score("text", model)).count() == 0


def test_ngrams_by_hand():
    grams, doc = quality.ngrams(["Aa aa %%%", None, "b", ""])
    by = [sorted(grams[doc == i].tolist()) for i in range(4)]
    assert len(by[0]) == 5 and 1 in by[0] and by[1] == [] and len(by[2]) == 1 and by[3] == []
    assert quality.ngrams(["b"])[0][0] == by[2][0]


def test_kth_largest(spark):
    rng = random.Random(4)
    keys = [rng.choice([rng.gauss(0, 1e-3), rng.gauss(0, 1e6), 7.0]) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k double")
    for k in (1, 10, 1500, 2999):
        assert quality.kth_largest(df, "k", k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, "k", 0) == float("inf") and quality.kth_largest(df.limit(0), "k", 3) == float("inf") and quality.kth_largest(df, "k", 3000) == float("-inf")


def test_resampling_keeps_good_and_is_exact(spark):
    docs, labels = corpus()
    d, lb = spark.createDataFrame(docs + [(1000, None, ""), (None, "th er", "")], DOCS), spark.createDataFrame(labels, LABELS)
    got = quality.resample(d, lb).collect()
    good = {i: g for i, g, _ in labels}
    held = [r for r in got if r["doc_id"] in good and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["selected"] == bool(good[r["doc_id"]]) for r in held]) >= 0.9
    ten = quality.resample(d, lb, k=10).collect()
    best = sorted((r["gumbel_key"] for r in ten), reverse=True)[9]
    assert [r["selected"] for r in ten] == [r["gumbel_key"] >= best for r in ten] and sum(r["selected"] for r in ten) == 10
    kept = quality.selected(d.withColumn("log_weight", F.lit("mine")), lb)
    assert kept.columns == [*d.columns, "log_weight"] and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if r["selected"])
    assert quality.resample(d.limit(0), lb).count() == 0
    assert quality.resample(d, lb.limit(0)).where("not selected").count() == 0


def test_resampling_is_in_proportion_to_weights(spark):
    """With k = 1, row i is drawn with probability w_i / sum w: Gumbel noise at temperature 1."""
    w = [0.0, 1.0, 2.0]
    draws = spark.range(30000).select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("w")) for i, x in enumerate(w)))).alias("r"), F.col("id").alias("draw"))
    keyed = draws.withColumn("key", F.concat_ws("/", "draw", "r.i")).select("draw", F.col("r.i").alias("i"), (F.col("r.w") + quality.gumbel("key", 0)).alias("k"))
    won = {r["i"]: r["count"] / 30000 for r in keyed.groupBy("draw").agg(F.max_by("i", "k").alias("i")).groupBy("i").count().collect()}
    for i, x in enumerate(w):
        assert won[i] == pytest.approx(np.exp(x) / np.exp(w).sum(), abs=0.012)


def test_ngram_model_equals_brute_force(spark):
    docs, _ = corpus(60)
    docs += [(100, None, ""), (101, "", ""), (102, "er on an " * 40_000, "")]
    rows = spark.createDataFrame([(t, i % 3 == 0) for i, t, _ in docs], "text string, target boolean").repartition(40)
    got = quality.counted(rows)
    want = np.zeros((2, quality.BUCKETS), np.int64)
    for i, t, _ in docs:
        grams, _ = quality.ngrams([t])
        for g in grams.tolist():
            want[0, g] += 1
            want[1, g] += i % 3 == 0
    assert (got == want).all()
    scale = want[1].sum() / want[0].sum()
    ratio = quality.ratios(got)
    text = docs[5][1]
    grams, _ = quality.ngrams([text])
    plain = sum(np.log(want[1, g] + quality.PRIOR) - np.log(want[0, g] * scale + quality.PRIOR) for g in grams)
    assert quality.log_weights([text, None, ""], ratio).tolist() == pytest.approx([plain, 0, 0])


def test_driver_gets_the_counts_of_one_task(spark, monkeypatch):
    rows = spark.createDataFrame([(f"word{i} beside", i % 2 == 0) for i in range(64)], "text string, target boolean")
    frame, sizes = type(rows), []
    collect = frame.collect

    def sized(df):
        out = collect(df)
        sizes.append(sum(len(r["counts"]) for r in out))
        return out

    monkeypatch.setattr(frame, "collect", sized)
    few, many, most = (quality.counted(rows.repartition(n)) for n in (1, 32, 40))
    assert (few == many).all() and (few == most).all() and few[0].sum() == 64 * 3
    assert sizes == [2 * quality.BUCKETS * 8] * 3


def test_fit_gives_the_drivers_memory_back(spark, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    done = []
    monkeypatch.setattr(toxicity, "fit", lambda *_: done.append("fit"))
    monkeypatch.setattr(common, "given_back", lambda: done.append("given back"))
    monkeypatch.setattr(common, "table", lambda *_: None)
    docs = spark.createDataFrame([(1, "a", "")], DOCS)
    assert corpus_pipeline.without_toxic(spark, docs, "").count() == 1
    assert done == ["fit", "given back"]


def test_learning_holds_a_word_once_and_spans_by_place():
    rng = random.Random(5)
    known = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(300)]
    texts = [" ".join(rng.choices(known, k=3000)) for _ in range(60)]
    toxic = [t + " vilesort" * 3 for t in texts[:30]]
    tracemalloc.start()
    try:
        toxicity.learned(toxic, texts[30:])
        most = tracemalloc.get_traced_memory()[1]
        learner = toxicity.Learner([toxicity.words(t) for t in toxic], [toxicity.words(t) for t in texts[30:]])
    finally:
        tracemalloc.stop()
    assert most < LEARNING_BYTES * sum(map(len, texts))
    kept = [h for h in learner.held if h is not None]
    assert sum(x.nbytes for h in kept for x in h) <= 7 * sum(len(h[0]) for h in kept) > 0


def test_the_drivers_heap_shrinks_before_learning(spark, monkeypatch):
    done = []
    monkeypatch.setattr(common, "cleaned", lambda _: done.append("cleaned"))
    monkeypatch.setattr(toxicity, "learned", lambda *_: done.append("learned"))
    docs = spark.createDataFrame([(i, "some text", "") for i in range(20)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    assert done == ["cleaned", "learned"]


def test_marks_are_looked_for_in_few_words_at_a_time(monkeypatch):
    of = [f"w{i}rd{i * i}".encode() for i in range(200)]
    marked = np.unique(np.concatenate([h[::3] for _, h, _, _ in toxicity.spans(of)]))
    whole, held, spans = toxicity.covered(of, marked), [], toxicity.spans
    monkeypatch.setattr(toxicity, "COVERED", 7)
    monkeypatch.setattr(toxicity, "spans", lambda some: held.append(len(some)) or spans(some))
    assert toxicity.covered(of, marked) == whole and whole and toxicity.covered([], marked) == {}
    assert max(held) == 7 and sum(held) == 200


def test_no_join_is_broadcast_from_the_driver(spark, monkeypatch):
    plans, written = [], common.written

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, tag)

    monkeypatch.setattr(common, "written", seen)
    words = [f"w{i}" for i in range(40)]
    docs = [(i % 9, " ".join(words[i % 5 :] + words[: i % 3]), "x") for i in range(12)]
    left = near_dedup.deduplicated(spark.createDataFrame(docs, DOCS))
    plans.append(left._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
