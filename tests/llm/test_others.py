"""Search, mixing, vector join, quotes, revisits, packing, scoring and the pipeline against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import asof, common, lm_scoring, mixing, packing, queries, quotes, topk, vector_join, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark):
    import duckdb

    from tests.test_catalogue import TABLES, plain

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    import pandas as pd

    pd.testing.assert_frame_equal(plain(queries.QUERIES[name](spark, SF).toPandas()), plain(duck.execute(queries.ORACLE_SQL[name]).df()))


def test_topk_equals_brute_force_with_ties(spark):
    rng = np.random.RandomState(0)
    rows = [(i, [float(x) for x in rng.randint(-3, 4, 6) / 8]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(50)] + [(400, None), (401, [float("nan")] * 6), (402, []), (None, rows[0][1]), (403, [1.0, 2.0]), (404, [1e30] * 5 + [-3e29]), (405, [600000.0, 1.0, 0.0, 0.0, 0.0, -0.5]), (450, [600000.0, 1.0, 0.0, 0.0, 0.0, 0.0]), (50, rows[7][1])]
    df = spark.createDataFrame(rows, "id long, x array<double>").select("id", topk.scaled(F.col("x")).alias("v"), F.lit("clash").alias("score"), F.lit("clash").alias("rank"))
    with pytest.raises(Exception, match="fit a long"):
        topk.search(df, df.where("id = 450")).collect()
    rows = [r for r in rows if r[0] != 404]
    df = df.where("id <> 404")
    got = collections.defaultdict(list)
    for r in topk.search(df, df.where("id % 50 = 0"), 5, query_rows=3, index_rows=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(np.isfinite(v))]
    for q, v in fine:
        if q % 50 == 0 and q != 50:
            want = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v)))[:5]
            assert got[q] == [(i, -s) for s, i in want], q
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def vector_brute(rows, threshold=0.98):
    fine = [(n, i, np.array(v, float), lb) for n, (i, v, lb) in enumerate(rows) if i is not None and lb is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    over = {i: i for i, _, _ in rows if i is not None}

    def root(x):
        while over[x] != x:
            x = over[x]
        return x

    links = collections.Counter()
    for a in fine:
        for b in fine:
            if a[0] < b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= threshold:
                links[a[0]] += 1
                links[b[0]] += 1
                x, y = sorted((root(a[1]), root(b[1])))
                over[y] = x
    return sorted((i, links[n], root(i)) for n, (i, _, _) in enumerate(rows) if i is not None)


def test_vector_join_equals_brute_force(spark):
    rng = np.random.RandomState(1)
    centres = rng.randn(6, 8)
    rows = [(i, [float(x) for x in centres[i % 6] * rng.uniform(0.5, 2) + rng.randn(8) * rng.choice([0.02, 0.15, 1])], i % 2) for i in range(260)]
    rows += [(300 + i, rows[3][1], rows[3][2]) for i in range(20)] + [(400, None, 1), (401, [0.0] * 8, 1), (402, [None] * 8, 1), (403, rows[0][1], None), (404, [1.0, 0.0], 1), (405, [2.0, 0.0], 1), (406, [float("inf")] * 8, 0)]
    # Rows of one id and different vectors have their own links, and tie their classes together.
    rows += [(501, [1.0, 0.0], 5), (501, [0.0, 1.0], 5), (502, [1.0, 0.01], 5), (503, [0.01, 1.0], 5), (502, rows[0][1], 0), (499, [0.0, 1.0], 7), (503, [0.0, 1.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("size", F.lit("clash"))
    got = sorted((r["id"], r["n_links"], r["component"]) for r in vector_join.near_duplicates(df, block_rows=16).collect())
    assert got == vector_brute(rows)
    assert vector_join.near_duplicates(df.limit(0)).count() == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 30), "big" if i < 600 else rng.choice("abc")) for i in range(800)] + [(900, None, "big"), (901, "", None), (902, None, "void"), (5, "again twice", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit(1))
    out = mixing.drawn(df, target_entropy=0.9, max_repeats=5.0)
    got = out.collect()
    spent, budget = collections.Counter(), {}
    for r in got:
        spent[r[mixing.SOURCE]] += r[mixing.TOKENS]
        budget[r[mixing.SOURCE]] = r[mixing.BUDGET]
    total = sum(len((t or "").split()) for _, t, _ in rows)
    w = [budget[s] / total for s in "abc"] + [budget["big"] / total]
    assert -sum(x * math.log(x) for x in w) <= 0.9 * math.log(4) + 1e-3
    assert all(budget[s] - 35 <= spent[s] <= budget[s] for s in ("a", "b", "c", "big"))
    have = collections.Counter()
    for i, t, s in rows:
        have[s or mixing.NO_SOURCE] += len((t or "").split())
    assert all(budget[s] <= 5.01 * have[s] for s in "abc")
    draws = collections.Counter((r["doc_id"], r["text"], r[mixing.EPOCH]) for r in got)
    assert set(draws.values()) == {1}
    with pytest.raises(ValueError):
        mixing.drawn(df, max_repeats=2.0, budget_share=3.0)
    nameless = spark.createDataFrame([(None, f"t{i} x", "s") for i in range(50)] + [(None, "long " * 30_000, "s")], "doc_id long, text string, source string")
    assert len({r[mixing.BLOCK] for r in mixing.drawn(nameless).collect()}) > 1
    assert mixing.mixed(df).columns == df.columns and mixing.mixed(df.limit(0)).count() == 0


def test_asof_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(5000), rng.random() < 0.4, i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, t long, full boolean, i long")
    got = {r["i"]: r["o"] for r in asof.latest_earlier(df, ["k"], "t", F.when(F.col("full"), F.struct("t", "i")), ~F.col("full"), "o", partitions=13).collect()}
    for k, t, full, i in rows:
        if not full:
            want = max(((u, j) for kk, u, f, j in rows if f and kk == k and u < t), default=None)
            assert (tuple(got[i]) if got[i] else None) == want


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, 10, "http://www.A.com/x/?utm_source=f#top", "response", 200, h(ETag='"1"', Content_Type="text/html", Date="d1"), "p1"),
        (2, 20, "https://a.com/x", "response", 404, h(ETag='"9"'), "p9"),
        (3, 30, "https://a.com:443/x", "revisit", 304, h(etag='W/"1"', Date="d3", Content_Length="0"), None),
        (4, 40, "http://m.a.com/x", "response", 200, h(ETag='"2"'), "p2"),
        (5, 50, "http://a.com/x", "revisit", 304, h(ETag='"1"'), None),
        (6, 5, "http://a.com/x", "revisit", 304, None, None),
        (7, 60, None, "revisit", 304, h(), None),
        (8, 70, "http://b.com/?b=2&a=1", "response", 200, None, "q"),
        (9, 80, "http://b.com?a=1&b=2", "revisit", 304, None, "q"),
        (10, 40, "http://a.com/x", "revisit", 304, h(ETag='"1"'), None),
    ]
    df = spark.createDataFrame(rows, "record_id long, ts long, url string, kind string, status int, headers map<string,string>, digest string").withColumn("body", F.concat(F.lit("body "), "record_id"))
    got = {r["record_id"]: r for r in warc.resolve_revisits(df, ("body",)).collect()}
    assert {i: (r["full_id"], r["verdict"]) for i, r in got.items()} == {3: (1, "resolved"), 5: (4, "changed"), 6: (None, "orphan"), 7: (None, "orphan"), 9: (8, "resolved"), 10: (1, "resolved")}
    assert got[3]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "date": "d3"} and got[3]["body"] == "body 1" and got[5]["body"] is None
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    clash = warc.resolve_revisits(df.union(df), ("digest",)).where("record_id = 3").collect()
    assert [r["digest"] for r in clash] == ["p1", "p1"]


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I\nsort a list?"),
        (1, 1, "assistant", "> how  do I\n> SORT a list?\nUse sorted()."),
        (1, 2, "user", "Another thing."),
        (1, 3, "user", "> > How do I sort a list?\n> Use sorted().\nThanks"),
        (1, 4, "user", "> nobody said this\nHm"),
        (1, 5, None, "> sort a list?\nOne line of it"),
        (2, 0, "user", None), (2, 1, "user", ""), (None, 1, "user", "> x"), (3, None, "user", "y"), (1, 2, "user", "Another thing."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    got = quotes.conversations(df)
    r = {(x["conv"], x["turn"]): x for x in got.collect()}
    assert got.count() == len(rows)
    assert r[1, 1]["parent"] == 0 and r[1, 1]["text"] == "Use sorted()."
    assert (r[1, 3]["parent"], r[1, 3]["root"], r[1, 3]["links"]) == (1, 0, 2)
    assert (r[1, 4]["parent"], r[1, 4]["quotes"], r[1, 4]["links"]) == (None, 1, 0) and r[1, 5]["parent"] == 0
    order = sorted(((x["position"], x["turn"]) for x in got.collect() if x["conv"] == 1))
    assert order == [(1, 0), (2, 1), (3, 3), (4, 5), (5, 2), (6, 2), (7, 4)]
    assert r[None, 1]["position"] is None and quotes.conversations(df.limit(0)).count() == 0


def quotes_brute(rows):
    """{(conv, turn): (quotes, links, parent)} of rows without repeats, by comparing every quote with everything said before."""
    blank, mark = re.compile(r"[ \t\x0b\f\r]*$"), re.compile(r"((?:[ \t]*>)+)[ \t]?")
    plain = lambda lines: re.sub(r"[ \t\x0b\f\r\n]+", " ", " ".join(lines)).strip(" ").lower()

    def passages(text):
        out, last = [], None
        for line in re.split("\r\n|\n|\r", text or ""):
            m = mark.match(line)
            body = line[m.end() :] if m else line
            level = None if blank.match(body) else m.group(1).count(">") if m else 0
            if level is not None:
                out[-1][1].append(body) if level == last else out.append((level, [body]))
            last = level
        return out

    said = collections.defaultdict(list)
    for conv, turn, _, text in rows:
        said[conv].append((turn, passages(text)))
    out = {}
    for conv, turns in said.items():
        for turn, parts in turns:
            quotes = {(level, plain(lines), len(lines)) for level, lines in parts if level}
            found = []
            for level, text, n in quotes:
                earlier = [u for u, ps in turns if u < turn for lv, lines in ps if lv == 0 and (plain(lines) == text or any(plain(lines[i : i + k]) == text for k in {1, n} for i in range(len(lines) - k + 1)))]
                found.append((level, max(earlier, default=None)))
            linked = [(level, -u) for level, u in found if u is not None]
            out[conv, turn] = (len({(q[0], q[1]) for q in quotes}), len(linked), -min(linked)[1] if linked else None)
    return out


def test_quoting_stream_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "delta", "eps"])
    line = lambda: " ".join(word() for _ in range(rng.randrange(1, 5)))
    rows = [(c, t, "user", "\n".join(rng.choice([line(), line(), line(), ""]) for _ in range(rng.randrange(1, 7)))) for c in range(12) for t in range(9)]
    rows += [(50, 0, "user", "word " * 40_000 + "\nend"), (50, 1, "user", "ok"), (50, 2, "user", None)]
    df = quotes.quoting_stream(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = quotes_brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    got = {(r["conv"], r["turn"]): (r["quotes"], r["links"], r["parent"]) for r in quotes.conversations(df).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 40


def test_word_encoder_equals_tokenizer():
    rng = random.Random(3)
    encoder = packing.WordEncoder()
    bits = ["a", "B", "é", "É", "ß", "'s", "'", "3", ".", ",", "!", "…", " ", "\n", "\t", "\x0b", "\x85", "<|endoftext|>", "<|", "é", "Σ", "İ", "日", "×", "»", ".)", "\x1c", "ﬁ"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)]
    for i in range(0, len(texts), 300):
        for t, ids in zip(texts[i : i + 300], encoder.encode(texts[i : i + 300])):
            assert ids.tolist() == [*encoder._ids_of(t), packing.END_ID]


def test_encoder_is_kept_until_given_back():
    first = packing._encoder(None)
    assert packing._encoder(None) is first
    common.given_back()
    assert packing._encoder(None) is not first


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["er", "on", "the."]) for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(400)] + [(500, None), (501, "the " * 700), (1, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack_documents(df, capacity=256, with_ids=True).collect()
    assert collections.Counter(r["doc_id"] for r in got if r["piece"] == 0) == collections.Counter(i for i, _ in rows)
    assert all(len(r["ids"]) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(by) <= math.ceil(total / 256) * 1.02 + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_best_fit_by_hand():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins[0] == bins[2] and bins[1] == bins[3] == bins[4]


def ctw_brute(train, text, depth):
    """Context-tree weighting by the book: nodes in a dictionary, mixed bit by bit."""
    nodes = collections.defaultdict(lambda: [0, 0])
    lower = lambda t: (t or "").encode().lower()

    def paths(data):
        data = b"\0" * depth + data + b"\0"
        for i in range(depth, len(data)):
            node = 1
            for j in range(7, -1, -1):
                bit = data[i] >> j & 1
                yield data[i - depth : i], node, bit
                node = node * 2 + bit

    for t in train:
        for context, node, bit in paths(lower(t)):
            for d in range(depth + 1):
                nodes[context[depth - d :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = collections.defaultdict(float)
    log_pw, stop = {}, {}
    for (context, node), (a, b) in sorted(nodes.items(), key=lambda x: -len(x[0][0])):
        own = kt(a, b)
        if len(context) < depth:
            both = np.logaddexp(own, children[context, node]) + math.log(0.5)
            stop[context, node] = math.exp(own + math.log(0.5) - both)
            own = both
        log_pw[context, node] = own
        if context:
            children[context[1:], node] += own
    total = 0.0
    for context, node, bit in paths(lower(text)):
        q = None
        for d in range(depth, -1, -1):
            key = (context[depth - d :], node)
            if key in nodes:
                a, b = nodes[key]
                own = (b + 0.5) / (a + b + 1)
                q = own if q is None else stop[key] * own + (1 - stop[key]) * q
        q = 0.5 if q is None else q
        total += math.log10(q if bit else 1 - q)
    return total


def test_scores_equal_brute_force_in_any_passes(spark):
    texts = [(i, t) for i, t in enumerate(["The cat sat on the mat.", "the dog sat", "A cat and a dog é", "", None, "zzz unseen QQQ \t the", "the cat"])] + [(0, "The cat sat on the mat.")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    train = df.where("doc_id <= 4")
    counts = collections.Counter()
    for i, t in texts:
        if i <= 4:
            counts.update([w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None])
    n, v = sum(counts.values()), len(counts)
    for entries in (10**9, 50):
        model = lm_scoring.Model(train, depth=3, pass_entries=entries)
        assert (model.tokens, model.vocabulary) == (n, v) and (len(model.passes) > 1) == (entries == 50)
        rows = lm_scoring.scored(df, model).collect()
        assert len(rows) == len(texts)
        by = {r["id"]: r for r in rows}
        for i, t in texts:
            words = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
            assert by[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
            assert (by[i]["n_tokens"], by[i]["n_known"]) == (len(words), sum(counts[w] > 0 for w in words))
            assert by[i]["score"] == pytest.approx(ctw_brute([t for j, t in texts if j <= 4], t, 3), rel=1e-5)
    none = lm_scoring.scored(df, lm_scoring.Model(df.limit(0), depth=3)).where("id = 6").first()
    assert none["score"] == pytest.approx(8 * 8 * math.log10(0.5)) and none["n_known"] == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= kept
        kept = now
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} == kept
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_bits_of_nearly_certain_nodes_are_finite():
    (level,) = lm_scoring.levels_of(np.array([97], np.uint64), np.array([10**9]), 0, 0)
    node, p, _, _ = lm_scoring.mixed(level, 0, None)
    got = lm_scoring.bits(np.array([97, 64], np.uint64), 0, lm_scoring._tag(node, 0), lm_scoring.signed(p))
    # "@" leaves "a" at the third bit, and no node is known from there on.
    assert -1e-6 < got[0] < 0 and abs(got[1] - (np.log10(0.5 / (1e9 + 1)) + 5 * np.log10(0.5))) < 1e-6


def test_counts_are_dealt_out_before_they_are_summed(spark, monkeypatch):
    plans, written = [], common.written
    monkeypatch.setattr(common, "written", lambda df, tag: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, tag))
    got = lm_scoring.counts(spark.createDataFrame([("ab ab",), ("ab",)], "text string").repartition(2), "text", 1)
    assert plans[0].rindex("HashAggregate") < plans[0].index("Exchange")
    assert sorted(r["n"] for r in got.where("word").collect()) == [3] and got.where("not word").agg(F.sum("n")).first()[0] == 9
