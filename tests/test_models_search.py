"""Greedy selection, exact rounding, halved calls, canonical queries, search on text and refreshes with outcomes."""

import hashlib
import itertools
import json
import math
import os
import random
import struct
import sys

import duckdb
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillmark.functions import score
from quillmark.operators import generate, independent, models, ranking, similarity
from quillmark.plans import catalogue
from quillmark.schemas import RECORD
from quillmark.streaming import refresh

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize("seed", range(4))
def test_greedy_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([*"abcdefgh", None]), rnd.randint(0, 12), f"s{rnd.randint(0, 60)}") for i in range(rnd.choice([1, 60, 400]))]
    rows += [(1000 + i, f"chain{i // 2}", 100 + (i + 1) // 2, f"c{i}") for i in range(14)]  # each waits for the one before
    rows += [(2000 + i, "hot", 999, f"h{i}") for i in range(200)]
    seen, want = [set(), set(), set()], []
    for n, *keys in rows:
        if not any(k in s for k, s in zip(keys, seen)):
            want.append(n)
            for k, s in zip(keys, seen):
                s.add(k)
    df = spark.createDataFrame(rows, "n long, a string, b long, c string").repartition(5)
    got = independent.greedy(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, [F.col("n")])
    assert sorted(r["n"] for r in got.collect()) == want and got.columns == df.columns
    assert independent.greedy(df.limit(0), {"a": F.col("a")}, [F.col("n")]).count() == 0


def test_distinct_cases_keep_what_a_case_lost_by_id_had_not_taken(spark):
    rows = [("x", "one two", 0), ("x", "three four", 1), ("y", "four three", 2), ("z", "Two  one!", 3), ("w", "ring", 4)]
    made = spark.createDataFrame([(i, q, p, 0, 0, "star-lt100") for i, q, p in rows], "id string, query string, pos long, t int, i int, star_tier string")
    assert {r["pos"] for r in generate.distinct_cases(made).collect()} == {0, 2, 4}
    out = spark.createDataFrame([("RING",)], "query string")
    assert {r["pos"] for r in generate.distinct_cases(made, out).collect()} == {0, 2}


def test_rounding_equals_python(spark):
    rnd = random.Random(7)
    xs = [k / 128 for k in range(-3000, 3000)] + [k / 2**j for j in range(1, 45) for k in (1, 3, 5, 7, 1001, 999999)]
    xs += [rnd.random() for _ in range(30000)] + [rnd.uniform(-1e3, 1e3) for _ in range(20000)] + [round(rnd.random(), 7) for _ in range(20000)] + [rnd.randint(0, 10**7) / 2e6 for _ in range(10000)]
    xs += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(62)))[0] for _ in range(5000)]
    xs += [rnd.uniform(2**30, 2**40) for _ in range(5000)] + [rnd.randint(0, 2**50) / 2**rnd.randint(0, 20) for _ in range(5000)]
    xs += [0.0, -0.0, 5e-7, 2.5e-6, 1e-300, 1e300, -1e-9, math.inf, -math.inf, 2.0**31, 2.0**52, 2.0**53 + 2]
    df = spark.createDataFrame([(x,) for x in xs if not math.isnan(x)] + [(None,)], "x double")
    for places in (6, 8, 0, 3):
        for r in df.select("x", score.rounded(F.col("x"), places).alias("y")).collect():
            want = None if r["x"] is None else r["x"] if math.isinf(r["x"]) else round(r["x"], places)
            assert r["y"] == want and (not want or math.copysign(1, r["y"]) == math.copysign(1, want)), (r["x"], places)
    assert math.isnan(spark.range(1).select(score.rounded(F.lit(float("nan")))).first()[0])
    with pytest.raises(ValueError):
        score.rounded(F.lit(1.0), 9)


def test_halved_calls_blame_single_items():
    calls = []

    def call(items):
        calls.append(len(items))
        if "bad" in items:
            raise ConnectionError("no")
        return items[:-1] if "short" in items and len(items) > 1 else items

    items = [str(i) for i in range(14)] + ["bad", "short"]
    got = models.halved(items, call)
    assert got == [(i, None) if i != "bad" else (None, "no") for i in items] and len(calls) < 12
    assert models.halved([], call) == []


def test_canonical_queries_in_three_modes(spark):
    def chat(prompts):
        out = []
        for p in prompts:
            queries = json.loads(p)["queries"]
            out.append(json.dumps({"queries": [q.upper() for q in queries if q != "drop me"]}))
        return out

    q = spark.createDataFrame([(1, "a"), (2, "drop me"), (3, "B"), (4, "a"), (5, None)], "qid int, query string")
    got = {m: {r["qid"]: (r["variants"], r["canonical_error"]) for r in models.canonicalised(q, chat, m, batch=3).collect()} for m in models.MODES}
    assert got["off"][1] == (["a"], None) and got["canonical"][1] == (["A"], None) and got["merge"][1] == got["merge"][4] == (["a", "A"], None)
    assert got["merge"][3] == (["B"], None) and got["canonical"][2][0] == ["drop me"] and got["canonical"][2][1] and got["merge"][5][0] == [None]
    with pytest.raises(ValueError):
        models.canonicalised(q, chat, "other")


def test_search_on_text(spark):
    entries = generate.synthetic_entries(spark, 40, 16)
    embed = lambda texts: models.hash_embedding(texts, 16)
    texts = entries.select("repo_id", "pos", "metadata", F.concat_ws(" ", "metadata.summary", "repo_id").alias("input"))
    from quillmark.operators import index

    entries = index.embedded(texts, embed, 16).drop("input").checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else index.embedded(texts, embed, 16).drop("input").cache()
    meta = spark.createDataFrame([("m", 3, 2, 16)], "embedding_model string, embedding_input_version int, record_schema_version int, dimension int")
    q = spark.createDataFrame([(1, "python library", ["python library", "rust tool"], "rust"), (2, "zzz unknown", None, None)], "qid long, query string, variants array<string>, rerank_query string")
    one = {r["qid"]: r for r in ranking.search_text(entries, meta, q.select("qid", "query"), embed, "m", "semantic", 3, 0.05).collect()}
    both = {r["qid"]: r for r in ranking.search_text(entries, meta, q, embed, "m", "semantic", 3, 0.05).collect()}
    assert one[1]["considered"] == 40 and one.keys() == {1, 2}
    assert both[1]["hits"][0]["score"] >= one[1]["hits"][0]["score"] and both[2]["abstained"] == one[2]["abstained"]
    vectors = spark.createDataFrame([(1, "python library", v) for v in embed(["python library", "rust tool"])], "qid long, query string, vector array<double>")
    want = [(r["rk"], r["repo_id"]) for r in ranking.search_semantic(entries, vectors, 3, 0.05).orderBy("rk").collect()]
    assert [(h["rk"], h["repo_id"]) for h in both[1]["hits"]] == want
    read = []

    def rerank(query, documents):
        assert query in ("rust", "zzz unknown")
        return [float(len(d)) for d in documents]

    hits = {r["qid"]: r["hits"] for r in ranking.search_text(entries, meta, q, embed, "m", "rerank", 5, 0.05, rerank, candidate_limit=4).collect()}
    assert 0 < len(hits[1]) <= 4 and not read
    for change, error in (({"model": "other"}, ranking.IndexMismatch), ({"strategy": "magic"}, ValueError), ({"strategy": "rerank"}, ValueError)):
        with pytest.raises(error):
            ranking.search_text(entries, meta, q, embed, **({"model": "m"} | change))
    with pytest.raises(ValueError, match="without a valid vector"):
        ranking.search_text(entries.withColumn("vector", F.slice("vector", 1, 3)), meta, q, embed, "m")
    with pytest.raises(ValueError, match="empty text"):
        ranking.search_text(entries, meta, spark.createDataFrame([(1, " ")], "qid long, query string"), embed, "m")
    with pytest.raises(ValueError, match="zero vector"):
        similarity.candidate_diagnostics(entries, spark.createDataFrame([(1, [0.0] * 16)], "qid long, vector array<double>"), 3)


def test_refresh_keeps_an_outcome_for_each_record(spark, tmp_path):
    log = str(tmp_path / "asked")

    def chatting(bad):
        def chat(prompts):
            if any(bad and bad in p for p in prompts):
                raise ConnectionError("poisoned")
            with open(f"{log}-{os.getpid()}", "a") as f:
                f.writelines(json.dumps(json.loads(p)["repo_id"]) + "\n" for p in prompts)
            return ['{"summary": "made"}' for _ in prompts]

        return chat

    def asked():
        return list(itertools.chain(*([json.loads(x) for x in open(tmp_path / n)] for n in os.listdir(tmp_path) if n.startswith("asked-"))))

    rows = generate.synthetic_records(spark, 100)
    rows.write.json(str(tmp_path / "in"))
    run = lambda bad: refresh.refresh_incrementally(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), chatting(bad), "m", F.lit("now"), F.lit("due"))
    run("repo-000042")
    store = refresh.outcomes(spark, str(tmp_path / "out"))
    got = {r["repo_id"]: r for r in store.current().collect()}
    assert len(got) == 100 and [k for k, r in got.items() if r["error"]] == ["synthetic/repo-000042"] and got["synthetic/repo-000042"]["error"] == "poisoned"
    assert len(asked()) == len(set(asked())) == 99
    rows = spark.read.schema(f"pos BIGINT, {RECORD}").json(str(tmp_path / "in"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    rows.write.json(str(tmp_path / "in"), mode="append")  # the same records again: only the failed one is asked about
    run(None)
    assert sorted(asked())[:100] == sorted(set(asked())) and len(asked()) == 100
    now = {r["repo_id"]: r for r in store.current().collect()}
    assert now["synthetic/repo-000042"]["attempts"] == 2 and not any(r["error"] for r in now.values())
    refresh.retried(store, rows, chatting(None), "m", F.lit("now"))
    assert len(asked()) == 100
    done = refresh.applied(rows, store).collect()
    assert len(done) == 100 and all(r["llm_profile"]["summary"] == "made" and r["refresh_error"] is None for r in done)
    changed = rows.where("pos = 3").withColumn("github", F.col("github").withField("description", F.lit("new evidence")))
    refresh.refresh_batch(store, changed, chatting(None), "m", F.lit("now"), F.lit("due"))
    assert len(asked()) == 101
    for attempts in (1, 2, 3, 3):
        refresh.refresh_batch(store, rows.where("pos = 7").withColumn("url", F.lit("u")), chatting("repo-000007"), "m", F.lit("now"), F.lit("due"))
        assert {r["attempts"] for r in store.current().where("repo_id like '%000007'").collect()} == {attempts}


def test_greedy_with_a_lone_key_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(n, rng.randrange(40) if rng.random() < 0.4 else 1000 + n, rng.randrange(25), rng.choice([None, 1, 2, 3, 4, 5])) for n in range(160)]
    df = spark.createDataFrame(rows, "n long, a long, b long, c long")
    want, seen = [], (set(), set(), set())
    for n, *keys in rows:
        if not any(k in s for k, s in zip(keys, seen)):
            want.append(n)
            for k, s in zip(keys, seen):
                s.add(k)
    got = independent.greedy(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, [F.col("n")], lone="a")
    assert sorted(r["n"] for r in got.collect()) == want
    left = independent._first_of_lone(df.where("a >= 1000").select(F.col("a").alias("x"), F.lit(1).alias("y"), F.struct("n").alias("__greedy_o")), "x", ["x", "y"])
    assert left.count() == 1


def test_strata_are_cut_before_they_meet(spark):
    made = spark.range(400).select("id", F.lit("q").alias("query"), F.lit("simple").alias("query_type"), F.when(F.col("id") % 40 == 0, "star-lt100").otherwise("star-100-999").alias("star_tier"))
    got = generate.stratified(made.withColumn("id", F.concat(F.lit("c"), "id")), 30)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    nth, ranked = {}, []
    for draw, i in sorted((hashlib.md5(f"0:c{i}".encode()).hexdigest(), i) for i in range(400)):
        nth[i % 40 == 0] = nth.get(i % 40 == 0, 0) + 1
        ranked.append((nth[i % 40 == 0] > 2, draw, f"c{i}"))
    assert [r["id"] for r in got.collect()] == [i for _, _, i in sorted(ranked)[:30]]


def test_synthetic_ids_are_shown_as_sql_cuts_them(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT unnest([7::BIGINT, 999999, 1000000, 1234567]) AS p_partkey) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = sorted(con.sql(catalogue.ORACLE_SQL["sc19_synthetic_index"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["sc19_synthetic_index"](spark, str(tmp_path)).collect())) == want
