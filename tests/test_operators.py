"""Operators on small inline tables, edge cases first."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import score, text
from quillmark.operators import evaluation, index, ingest, models, ranking, records, similarity
from quillmark.sources import files, hosting


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_and_language(spark):
    r = one(
        spark, text.tokens(F.lit("C++ & node.js, Go")).alias("t"), text.tokens(F.lit(None).cast("string")).alias("none"), text.metadata_language(F.lit("Jupyter Notebook")).alias("l"),
        text.metadata_language(F.lit("prose")).alias("nl"), text.keywords(F.lit("python library for 2024 parsing-tools")).alias("k"), text.expanded(F.lit("parsing-tools")).alias("e"),
    )
    assert r["t"] == ["c++", "node.js", "go"] and r["none"] == [] and r["l"] == "jupyter notebook" and r["nl"] is None
    assert r["k"] == ["parsing-tools"]
    assert set(r["e"]) == {"parsing-tools", "parsing", "tools", "parsing-tool", "parsings", "tool"}


@pytest.mark.parametrize(
    "query,kind",
    [("", "empty"), ("owner/repo", "exact_name"), ("fast parser", "exact_name"), ("alternative to redis now", "alternative"), ("log pipelines for kafka streams", "domain"), ("a tool to use", "functional")],
)
def test_intent(spark, query, kind):
    assert one(spark, text.intent_type(F.lit(query)).alias("i"))["i"] == kind


@pytest.mark.parametrize(
    "query,kind",
    [("use acme/Widget now", "repo_id"), ("widget", "exact_value"), ("acme", "exact_value"), ("the_widget", "name_mention"), ("widgets", "none"), ("如何使用widget解析", "contextual_name_mention"), ("如何解析", "none")],
)
def test_identity(spark, query, kind):
    got = one(spark, text.identity_kind(F.lit(query), F.lit("acme/widget"), F.lit("Widget"), F.array(F.lit("the widget"), F.lit(" "))).alias("k"))
    assert got["k"] == kind


def test_fingerprint_is_python_json(spark):
    import hashlib

    value = 'é "q" \\ \n\x0b\x1f 日'
    want = hashlib.sha256(json.dumps({"embedding_input_version": 3, "text": value}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert one(spark, text.fingerprint(F.lit(value)).alias("f"))["f"] == want
    assert one(spark, text.fingerprint(F.lit("")).alias("f"))["f"] is None


def test_repo_parse_and_excerpt(spark):
    cases = {"https://github.com/a/b/tree": ("a/b", None), "https://gitlab.com/a/b": (None, "not_github"), " a/b ": ("a/b", None), "a": (None, "not_owner_repo"), "": (None, "empty"), "http://github.com/a": (None, "no_owner_and_repo")}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.repo_parse(F.col("v")).alias("r")).collect()
    assert {r["v"]: (r["r"]["repo_id"], r["r"]["reason"]) for r in rows} == cases
    readme = "# Title\n\n[![x](badge.svg)]\n---\n  text here \n![pic](a)\n"
    assert one(spark, text.readme_excerpt(F.lit(readme)).alias("x"))["x"] == "# Title\ntext here"
    assert one(spark, text.readme_excerpt(F.lit("\n")).alias("x"))["x"] is None


def test_cosine_and_numbers(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    r = one(spark, score.cosine(v(1, 0), v(0, 0)).alias("zero"), score.cosine(v(3, 4), v(3, 4)).alias("same"), score.number(F.lit("12,345")).alias("n"), score.number(F.lit("many")).alias("bad"), score.star_tier(F.lit(-1)).alias("t"))
    assert r["zero"] == 0 and abs(r["same"] - 1) < 1e-12 and r["n"] == 12345 and r["bad"] is None and r["t"] == "star-unknown"
    with pytest.raises(Exception, match="differ"):
        one(spark, score.cosine(v(1, 0), v(1)).alias("x"))
    with pytest.raises(ValueError):
        score.confidence(F.lit(0.5), 2.0)


ENTRY = "repo_id string, pos long, vector array<float>, metadata struct<name:string,url:string,aliases:array<string>,description:string,topics:array<string>,language:string,stars:string,forks:long,archived:boolean,disabled:boolean,pushed_at:string,summary:string,use_cases:array<string>,capabilities:array<string>,project_type:string,ecosystem:array<string>,replaces:array<string>,related_projects:array<string>,search_text:string,search_phrases:array<string>>"


def entries_of(spark, *rows):
    blank = (None, None, [], None, [], None, None, None, False, False, None, None, [], [], None, [], [], [], None, [])
    return spark.createDataFrame([(r, i, v, (name, *blank[1:])) for i, (r, name, v) in enumerate(rows)], ENTRY)


def test_ranking_pins_identity_and_abstains(spark):
    e = entries_of(spark, ("a/far", "far", [0.0, 1.0]), ("b/near", "near", [1.0, 0.0]), ("c/mid", "mid", [0.8, 0.6]))
    q = spark.createDataFrame([(1, "far", [1.0, 0.0]), (2, "nothing like it", [-1.0, 0.0])], "qid long, query string, vector array<double>")
    hits = ranking.search(e, q, "metadata", 5).orderBy("qid", "rk").collect()
    assert [h["repo_id"] for h in hits if h["qid"] == 1][0] == "a/far" and hits[0]["confidence"] == "high_confidence"
    rows = {r["qid"]: r for r in ranking.answers(q, ranking.search(e, q, "semantic", 5)).collect()}
    assert rows[2]["abstained"] and [h["repo_id"] for h in rows[1]["hits"]] == ["b/near", "c/mid"]
    assert ranking.search(e, q, "semantic", 0).count() == 0
    with pytest.raises(ValueError):
        ranking.search(e, q, "magic")


def test_blocked_scores_equal_native(spark):
    e = entries_of(spark, *((f"o/r{i}", f"r{i}", [float(i % 5), float(i % 7), 1.0]) for i in range(40)))
    q = spark.createDataFrame([(i, "q", [1.0, float(i), 0.5]) for i in range(5)] + [(0, "q", [0.0, 1.0, 0.0])], "qid long, query string, vector array<double>")
    a = {(r["qid"], r["repo_id"]): r["semantic"] for r in similarity.scored_pairs(e, q, 100).collect()}
    b = {(r["qid"], r["repo_id"]): r["semantic"] for r in similarity.scored_pairs_native(e, q).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_index_guard(spark):
    meta = spark.createDataFrame([("m", 3, 2)], "embedding_model string, embedding_input_version int, record_schema_version int")
    ranking.check_index(meta, "m", 3, 2)
    with pytest.raises(ranking.IndexMismatch):
        ranking.check_index(meta, "other", 3, 2)
    with pytest.raises(ValueError):
        ranking.check_vectors(entries_of(spark, ("a/b", "b", None)))


def test_files(spark, tmp_path):
    (tmp_path / "repos.txt").write_text("# c\n\na/b\nhttps://github.com/c/d\na/b\n")
    assert [r["repo_id"] for r in files.repo_list(spark, str(tmp_path / "repos.txt")).orderBy("pos").collect()] == ["a/b", "c/d", "a/b"]
    (tmp_path / "r.json").write_text(json.dumps([{"repo_id": "a/b", "schema_version": 2, "github": {"stars": 3}, "readme": {"path": "x"}}, {"repo_id": 7}]))
    rows = files.records(spark, str(tmp_path / "r.json")).orderBy("pos").collect()
    assert rows[0]["github"]["stars"] == 3 and len(rows) == 2
    (tmp_path / "bad.json").write_text('[{"a": 1}, 5]')
    with pytest.raises(files.SourceError):
        files.records(spark, str(tmp_path / "bad.json"))
    (tmp_path / "c.jsonl").write_text('{"repo_id": "a/b", "name": "old"}\n\n{"repo_id": "a/b", "name": "new"}\n{"repo_id": "x')
    assert [r["name"] for r in files.checkpoint(spark, str(tmp_path / "c.jsonl")).collect()] == ["new"]
    (tmp_path / "d.jsonl").write_text('{"repo_id": "a\n{"repo_id": "a/b"}\n')
    with pytest.raises(files.SourceError):
        files.checkpoint(spark, str(tmp_path / "d.jsonl"))
    (tmp_path / "f.json").write_text('{"failed": [{"repo_id": "a/b"}, {"repo_id": " "}]}')
    assert [r[0] for r in files.failed_ids(spark, str(tmp_path / "f.json")).collect()] == ["a/b"]


def test_vectors_decode(spark):
    import base64

    good = base64.b64encode(np.array([1, 2], "<f4").tobytes()).decode()
    df = spark.createDataFrame([(good,), ("[1, 2]",), ("!!",), ("[1]",), (None,)], "raw string")
    assert [r["vector"] for r in files.decoded(df, "raw", 2).collect()] == [[1.0, 2.0], [1.0, 2.0], None, None, None]


def test_eval_and_gate(spark):
    cases = spark.createDataFrame([("c1", "q one", "a/b", ["x/y"], ["f"], ["t"], 0), ("c2", "q", "n/o", [], [], [], 1)], "id string, query string, expected_repo_id string, acceptable_repo_ids array<string>, acceptable_families array<string>, tags array<string>, pos long")
    families = spark.createDataFrame([("f", ["g/h"])], "family string, repo_ids array<string>")
    hits = spark.createDataFrame([("c1", 1, "g/h", "high_confidence"), ("c1", 2, "a/b", "exploratory")], "qid string, rk int, repo_id string, confidence string")
    r = evaluation.case_results(cases, hits, evaluation.members(families))
    status = {x["id"]: x["top1_status"] for x in r.collect()}
    assert status == {"c1": "acceptable", "c2": "serious_mismatch"}
    m = evaluation.metrics(r)
    row = m.first()
    assert (row["exact_hit_at_1"], row["mrr_exact"], row["recall_at_1"], row["abstain_rate"]) == (0.0, 0.25, 0.5, 0.5)
    assert [x["ok"] for x in evaluation.gate(m).collect()] == [False, False, False]
    assert evaluation.violations(cases.withColumn("acceptable_families", F.array(F.lit("no"))), families).count() == 2


def test_results_by_member_rows_equal_those_by_sets(spark):
    """Large, overlapping and empty families, cases of several or none, null lists, hits that nothing accepts."""
    rng = np.random.default_rng(11)
    ids = [f"o/r{i}" for i in range(60)]
    families = {"all": ids, "few": ids[:7], "some": ids[5:30], "none": []}
    cases = [
        (f"c{i}", ids[rng.integers(60)], None if i % 5 == 0 else [str(x) for x in rng.choice(ids, 3)], None if i % 7 == 0 else [str(x) for x in rng.choice(["few", "some", "none"] + ["all"] * (i % 4 == 0), 2)])
        for i in range(80)
    ]
    hits = [(c[0], k + 1, str(r), "exploratory") for i, c in enumerate(cases) for k, r in enumerate(rng.choice(ids, i % 6, replace=False))]
    made = spark.createDataFrame(cases, "id string, expected_repo_id string, acceptable_repo_ids array<string>, acceptable_families array<string>")
    members = evaluation.members(spark.createDataFrame(list(families.items()), "family string, repo_ids array<string>"))
    got = {r["id"]: (r["top_repo_id"], r["exact_rank"], r["acceptable_rank"], r["acceptable_match"]) for r in evaluation.case_results(made, spark.createDataFrame(hits, "qid string, rk int, repo_id string, confidence string"), members).collect()}
    shown = {r["id"]: r["acceptable_set"] for r in evaluation.acceptable(made, members).collect()}
    for name, want, own, named in cases:
        fine = {want, *(own or []), *(x for f in named or [] for x in families[f])}
        mine = [(k, r) for c, k, r, _ in hits if c == name]
        assert shown[name] == sorted(fine)
        assert got[name] == (
            next((r for k, r in mine if k == 1), None), min((k for k, r in mine if r == want), default=None), min((k for k, r in mine if r in fine), default=None), any(k == 1 and r in fine for k, r in mine)
        )


def test_search_bounds_lose_nothing(spark):
    """Entries whose metadata lifts or lowers them, in several batches: the cut search equals one over all pairs."""
    from quillmark.operators import generate

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        e = generate.synthetic_entries(spark, 300, 4).repartition(3, "pos").cache()
        q = e.where("pos % 60 = 0").select(F.col("pos").alias("qid"), F.concat_ws(" ", F.lower("metadata.language"), F.get("metadata.topics", 0)).alias("query"), "vector")
        got = ranking.search_metadata(e, q, 5, 0.3).select("qid", "rk", "repo_id", F.round("score", 9).alias("score")).collect()
        every = similarity.scored_pairs_native(e, q).where("semantic >= 0.3").withColumn("identity", F.lit("none"))
        named = ranking.identity_pairs(e, q)
        every = every.drop("identity").join(named, ["qid", "repo_id", "pos"], "left").fillna("none", ["identity"])
        want = ranking.presented(ranking.adjusted(every, e, q, 0.3), 5, *ranking.best_order()).select("qid", "rk", "repo_id", F.round("score", 9).alias("score")).collect()
        assert named.isEmpty() and len(want) == 25 and sorted(got) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_models(spark):
    assert models.vectors_of({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, 2) == [[1], [2]]
    assert models.scores_of({"rankings": [{"index": 1, "logit": 5}, {"index": 0, "logit": 1}]}, 2) == [1.0, 5.0]
    for bad in ([{"index": 0, "score": 1}] * 2, [{"index": 5, "score": 1}, {"index": 0, "score": 1}], [1]):
        with pytest.raises(models.ModelError):
            models.scores_of(bad, 2)
    assert models.queries_of('Sure: {"queries": [" a "]}', 1) == ["a"]
    with pytest.raises(models.ModelError):
        models.queries_of('{"queries": ["a"]} and more', 1)
    rows = spark.createDataFrame([(1, "x"), (2, "boom")], "id int, p string")
    got = {r["id"]: (r["answer"], r["error"]) for r in models.asked(rows, "p", lambda ps: [p.upper() for p in ps], 1).collect()}
    assert got == {1: ("X", None), 2: ("BOOM", None)}


def test_hosting(spark, tmp_path):
    clock = [0.0]
    pool = hosting.TokenPool(["a", "b"], lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    assert [pool.take() for _ in range(3)] == ["a", "b", "a"]
    pool.rest("a", 50)
    pool.rest("b", 70)
    assert pool.take() is None
    pool.wait(100)
    assert clock[0] == 55 and pool.take() == "a"
    with pytest.raises(hosting.HostError):
        pool.wait(1)
    (tmp_path / "repos/a/b/git/trees").mkdir(parents=True)
    (tmp_path / "repos/a/b.json").write_text(json.dumps({"full_name": "a/b", "name": "b", "html_url": "https://h/a/b", "description": "d", "default_branch": "main", "topics": ["t"]}))
    (tmp_path / "repos/a/b/git/trees/main.json").write_text(json.dumps({"tree": [{"path": "src/x"}, {"path": "go.mod"}]}))
    spark.dataSource.register(hosting.SnapshotSource)
    df = spark.read.format("repo_snapshots").option("repos", "a/b,no/ne").option("fixtures", str(tmp_path)).load()
    rows = {r["repo_id_requested"]: r for r in df.collect()}
    assert rows["no/ne"]["status"] == 404 and rows["a/b"]["paths"] == ["src/x", "go.mod"]
    record = ingest.records_of(df, F.lit("now")).first()
    assert record["repo_id"] == "a/b" and record["structure"]["signals"] == ["has_go_mod", "has_src_directory"] and record["evidence_gaps"] == ["missing_readme_excerpt"]


def test_incremental_equals_one_shot(spark, tmp_path):
    from quillmark.operators import generate
    from quillmark.streaming import index as stream

    made = generate.synthetic_records(spark, 30)
    embed = lambda texts: models.hash_embedding(texts, 8)
    one_shot = index.build(made, spark.createDataFrame([], ENTRY + ", embedding_input_fingerprint string"), embed, 8)
    want = {r["repo_id"]: list(r["vector"]) for r in one_shot.collect()}
    for part in (made.where("pos < 10"), made.where("pos >= 10")):
        part.write.mode("append").json(str(tmp_path / "in"))
        stream.build_incrementally(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), embed, 8)
    got = {r["repo_id"]: list(r["vector"]) for r in stream.current(spark, str(tmp_path / "out")).collect()}
    assert got == want


def test_records_by_id_and_merge(spark):
    r = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("", 2, "z")], "repo_id string, pos long, name string")
    assert [(x["repo_id"], x["name"]) for x in records.by_id(r).collect()] == [("a", "y")]
    done = spark.createDataFrame([("a", 0, "new"), ("b", 1, "b")], "repo_id string, pos long, name string")
    merged = records.ordered_merge(r.where("repo_id = 'a' and pos = 0"), done.select("repo_id", "pos"), done).orderBy("first").collect()
    assert [(x["repo_id"], x["name"]) for x in merged] == [("a", "new"), ("b", "b")]


def evidenced(records):
    return records.withColumns({"structure": F.lit(None).cast("struct<signals:array<string>>"), "evidence_gaps": F.array().cast("array<string>")})


def test_models_are_asked_for_due_rows_only(spark, tmp_path):
    from quillmark.operators import generate

    rows = evidenced(generate.synthetic_records(spark, 6).coalesce(1))
    log = str(tmp_path / "asked")

    def chat(prompts):
        with open(log, "a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        return ['{"summary": "new"}' for _ in prompts]

    due = F.when(F.col("pos") == 3, F.lit("why"))
    got = models.refreshed(rows, chat, "m", F.lit("now"), due, "be brief").collect()
    asked = [json.loads(line) for line in open(log)]
    assert len(got) == 6 and len(asked) == 1 and json.loads(asked[0])["repo_id"] == "synthetic/repo-000003"
    made = {r["pos"]: r["new_profile"] for r in got}
    assert made[3]["summary"] == "new" and made[3]["prompt_hash"] == text.prompt_hash(2, "be brief") and not any(v for p, v in made.items() if p != 3)
    some = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, p string")
    assert {r["id"]: r["answer"] for r in models.asked(some, "p", lambda ps: [p.upper() for p in ps]).collect()} == {1: None, 2: "X", 3: None}
    report = ingest.refresh_report(models.refreshed(rows, chat, "m", F.lit("now"), due).withColumn("resumed", F.lit(False)), due).first()
    assert (report["input_count"], report["refreshed_count"], report["skipped_count"], report["failed_count"]) == (6, 1, 5, 0)


def test_build_keeps_rows_of_repeated_ids(spark):
    from quillmark.operators import generate

    made = generate.synthetic_records(spark, 4).withColumn("repo_id", F.lit("one/id"))
    none = spark.createDataFrame([], ENTRY + ", embedding_input_fingerprint string")
    got = index.build(made, none, lambda texts: models.hash_embedding(texts, 8), 8).collect()
    assert len(got) == 4 and len({tuple(r["vector"]) for r in got}) == 4


def test_verify_finds_each_fault(spark):
    from quillmark.operators import generate

    made = generate.synthetic_records(spark, 10)
    full = index.build(made, spark.createDataFrame([], ENTRY + ", embedding_input_fingerprint string"), lambda texts: models.hash_embedding(texts, 8), 8)
    counts = lambda e: {r["name"]: r["n"] for r in index.verify(made, e, 8, {"record_count": 10}).collect()}
    fine = counts(full)
    assert fine["missing_vectors"] == fine["stale_vectors"] == fine["duplicate_vectors"] == fine["extra_vectors"] == fine["record_count_mismatch"] == 0 and fine["vector_count"] == 10
    odd = full.where("pos > 0").withColumns({"repo_id": F.when(F.col("pos") == 1, "ex/tra").when(F.col("pos") == 3, F.lit("synthetic/repo-000002")).otherwise(F.col("repo_id")), "vector": F.when(F.col("pos") == 5, F.slice("vector", 1, 3)).when(F.col("pos") != 6, F.col("vector")), "embedding_input_fingerprint": F.when(F.col("pos") == 7, "").otherwise(F.col("embedding_input_fingerprint"))})
    got = counts(odd)
    assert {k: got[k] for k in ("missing_vectors", "stale_vectors", "missing_fingerprints", "invalid_vectors", "dimension_mismatch", "duplicate_vectors", "extra_vectors")} == {"missing_vectors": 3, "stale_vectors": 2, "missing_fingerprints": 1, "invalid_vectors": 1, "dimension_mismatch": 1, "duplicate_vectors": 1, "extra_vectors": 1}


def test_judge(spark):
    from quillmark.operators import generate

    recs = evidenced(generate.synthetic_records(spark, 3))
    name = "synthetic/repo-00000"
    results = spark.createDataFrame([("a", "q", name + "0", name + "1", False, False), ("b", "q", name + "0", name + "0", True, True), ("c", "q", name + "0", None, False, False)], "id string, query string, expected_repo_id string, top_repo_id string, exact_match boolean, acceptable_match boolean")
    got = models.judged(results, recs, lambda ps: [json.dumps({"verdict": "acceptable_substitute"}) if json.loads(p)["top1_repo"]["repo_id"] == name + "1" else "no" for p in ps]).collect()
    assert [(r["id"], r["verdict"], r["judge_error"]) for r in got] == [("a", "acceptable_substitute", None)]
    with pytest.raises(Exception, match="no record of"):
        models.judge_inputs(results.withColumn("top_repo_id", F.lit("x/y")), recs).collect()
    assert evaluation.judge_counts(spark.createDataFrame([("serious_mismatch", "large")], "verdict string, difference_size string")).count() == 2


def test_endpoints(tmp_path):
    from quillmark.sources import endpoints

    env = {"A": "kept"}
    (tmp_path / ".env").write_text("# c\nA=1\nB = 'two'\nEMBEDDING_API_KEY=k\nEMBEDDING_BASE_URL=http://h/v1/\n")
    endpoints.load_env(str(tmp_path / ".env"), env)
    assert env["A"] == "kept" and env["B"] == "two"
    with pytest.raises(endpoints.NotConfigured, match="EMBEDDING_MODEL"):
        endpoints.endpoint("embedding", env)
    config = endpoints.endpoint("embedding", env | {"EMBEDDING_MODEL": "m"})
    assert "'k'" not in repr(config)
    calls = []

    def post(url, body, headers, timeout):
        calls.append(url)
        if url.endswith("/embeddings"):
            raise endpoints.EndpointError("no", 404)
        return [[1.0]] * len(body["inputs"])

    assert endpoints.embedder(config, post)(["a", "b"]) == [[1.0], [1.0]] and calls == ["http://h/v1/embeddings", "http://h/embed"]
    with pytest.raises(ValueError):
        endpoints.embedded_query(endpoints.embedder(config, post), " ")
    tries = []

    def flaky(url, body, headers, timeout):
        tries.append(body["temperature"])
        if len(tries) < 3:
            raise endpoints.EndpointError("busy", 503)
        return {"choices": [{"message": {"content": "{}"}}]}

    assert endpoints.chatter(config, "s", flaky, sleep=lambda s: None)(["p"]) == ["{}"] and tries == [0, 0, 0]
    assert endpoints.tokens({"GITHUB_TOKENS": "a, b", "GITHUB_TOKEN": "c"}) == ["a", "b"] and endpoints.tokens({"GITHUB_TOKEN": "c"}) == ["c"] and endpoints.tokens({}) == []


def test_graph_snapshots_and_ingest(spark, tmp_path):
    from quillmark.operators import health

    known = {"nameWithOwner": "a/b", "name": "b", "url": "https://h/a/b", "description": "d", "repositoryTopics": {"nodes": [{"topic": {"name": "t"}}, {"topic": None}]}, "issues": {"totalCount": 2}, "pullRequests": {"totalCount": 3}, "readme1": {"text": "hello"}, "tree": {"entries": [{"name": "src", "object": {"entries": [{"name": "x", "object": {"entries": [{"name": "y"}]}}]}}, {"name": "go.mod", "object": {}}]}}

    def transport():
        def post(query, variables):
            return {"data": {f"r{i}": known if variables[f"name{i}"] == "b" else None for i in range(len(variables) // 2)}}

        return post

    repos = spark.createDataFrame([("a/b", 0), ("no/ne", 1)], "repo_id string, pos long")
    rows = {r["repo_id_requested"]: r for r in hosting.graph_snapshots(repos, transport).collect()}
    assert rows["no/ne"]["status"] == 404 and rows["a/b"]["paths"] == ["src", "go.mod", "src/x", "src/x/y"] and rows["a/b"]["readme_path"] == "README.markdown"
    record = ingest.records_of(hosting.graph_snapshots(repos, transport), F.lit("now")).first()
    assert record["github"]["open_issues"] == 5 and record["github"]["topics"] == ["t"] and record["repo_id"] == "a/b"
    with pytest.raises(ValueError):
        hosting.graph_query([])
    path, none = str(tmp_path / "ck"), spark.createDataFrame([], "repo_id string, pos long")
    merged, outcomes = ingest.run(repos, none, lambda r: hosting.graph_snapshots(r, transport), path, F.lit("now"))
    assert {r["repo_id"]: r["outcome"] for r in outcomes.collect()} == {"a/b": "generated", "no/ne": "failed"} and ingest.succeeded(outcomes)
    assert {r["repo_id"]: r["name"] for r in merged.collect()} == {"a/b": "b"}
    with pytest.raises(health.Refused):
        ingest.run(repos, none, lambda r: hosting.graph_snapshots(r, transport), path, F.lit("now"))


def test_files_round_trip(spark, tmp_path):
    from quillmark.operators import generate

    e = generate.synthetic_entries(spark, 5, 4).withColumn("metadata", F.col("metadata"))
    files.write_index(e, str(tmp_path / "index.json"), {"index_version": 3, "dimension": 4})
    back, meta = files.index(spark, str(tmp_path / "index.json"))
    want = {r["repo_id"]: list(r["vector"]) for r in e.collect()}
    assert {r["repo_id"]: list(r["vector"]) for r in back.collect()} == want and meta.first()["record_count"] == 5
    files.write_json(spark.range(3), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"id": 0}, {"id": 1}, {"id": 2}]
    files.write_json(spark.range(0), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == []
    files.append_checkpoint(spark.createDataFrame([("a/b", "n")], "repo_id string, name string"), str(tmp_path / "ck"))
    assert files.checkpoint(spark, str(tmp_path / "ck/*.json")).first()["name"] == "n"
    (tmp_path / "d.json").write_text(json.dumps({"schema_version": 1, "dataset_name": "d", "families": {"f": ["a/b"]}, "cases": [{"id": "c", "query": "alternative to redis", "expected_repo_id": "a/b", "tags": ["t"]}]}))
    cases, families = files.dataset(spark, str(tmp_path / "d.json"))
    assert cases.first()["acceptable_families"] == [] and families.first()["repo_ids"] == ["a/b"]
    (tmp_path / "q.json").write_text('{"c": "redis"}')
    assert files.canonical_queries(spark, str(tmp_path / "q.json"), cases).first()["canonical"] == "redis"
    (tmp_path / "rep.json").write_text(json.dumps({"dataset_name": "d", "results": [{"id": "c", "query": "q", "top1_status": "serious_mismatch", "tags": ["t"]}]}))
    results, _ = files.eval_report(spark, str(tmp_path / "rep.json"))
    assert evaluation.inspected(results, "serious_mismatch", "t").count() == 1
    assert evaluation.selected_cases(cases, "t", "alternative", 5).count() == 1 and evaluation.selected_cases(cases, "u").count() == 0


def test_health(spark, tmp_path):
    from quillmark.operators import health

    rows = {r["name"]: r["status"] for r in health.doctor(spark, {"records": str(tmp_path / "none")}, {}).collect()}
    assert rows == {"embedding": "error", "rerank": "warn", "llm": "warn", "records": "warn"}
    repos = spark.createDataFrame([("a/b",)], "repo_id string")
    cases = spark.createDataFrame([("c", "a/b", ["a/b", "x/y"])], "id string, expected_repo_id string, acceptable_set array<string>")
    meta = spark.createDataFrame([(1,)], "record_count long")
    results = spark.createDataFrame([("exact",)], "top1_status string")
    got = {r["name"]: r["ok"] for r in health.smoke(repos, repos, repos, meta, results, cases).collect()}
    assert got == {"repos": True, "records": True, "index": True, "eval_report": True, "eval_dataset": False}
    hits = spark.createDataFrame([(1, "a/b", 0.5, "exploratory")], "rk int, repo_id string, score double, confidence string")
    assert health.hit_lines(hits.collect()) == ["1. a/b  0.5  exploratory"] and health.hit_lines([]) == ["no results"]
    assert health.gate_lines(evaluation.gate(spark.createDataFrame([(1.0, 1.0, 0.0)], "exact_top1_rate double, effective_top1_rate double, serious_top1_error_rate double")).collect())[0] == "ok exact_top1_rate 1 >= 0.88"


def test_scoring_holds_the_best_of_a_task_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"r/{i:03d}", i, rng.standard_normal(4).tolist()) for i in range(300)]
    e = spark.createDataFrame(rows, "repo_id string, pos long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(i % 20, rng.standard_normal(4).tolist()) for i in range(30)], "qid long, vector array<double>")
    gone = spark.createDataFrame([(q, f"r/{i:03d}") for q in range(0, 20, 2) for i in range(0, 300, 3)], "qid long, repo_id string")
    every = {}
    for r in similarity.scored_pairs_native(e, asked).join(gone, ["qid", "repo_id"], "left_anti").collect():
        every.setdefault(r["qid"], []).append((r["semantic"], r["repo_id"]))
    monkeypatch.setattr(similarity, "CELLS", 200)
    monkeypatch.setattr(similarity, "HELD", 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for block in (8192, 7):
            monkeypatch.setattr(similarity, "QUERY_BLOCK", block)
            got = {}
            for r in similarity.scored_pairs(e, asked, 3, without=gone).collect():
                got.setdefault(r["qid"], []).append((r["semantic"], r["repo_id"]))
            for q, want in every.items():
                want = sorted(want, reverse=True)[:3]
                assert [i for _, i in sorted(got[q], reverse=True)[:3]] == [i for _, i in want]
                assert max(abs(a - b) for (a, _), (b, _) in zip(sorted(got[q], reverse=True), want)) < 1e-12
            if block > 30:  # each batch of ten handed on three before
                assert sum(map(len, got.values())) == 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reranking_keeps_no_more_for_what_queries_name(spark, monkeypatch):
    kept, scored = [], similarity.scored_pairs
    monkeypatch.setattr(similarity, "scored_pairs", lambda e, q, keep, *a, **k: kept.append(keep) or scored(e, q, keep, *a, **k))
    rows = [(f"r/{i}", i, [1.0, float(i)]) for i in range(9)]
    e = spark.createDataFrame(rows, "repo_id string, pos long, vector array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "qid long, vector array<double>")
    named = spark.createDataFrame([(1, f"r/{i}", i) for i in range(4, 9)], "qid long, repo_id string, pos long")
    got = ranking.rerank_candidates(e, q, 2, named).collect()
    assert kept == [2]
    assert sorted((r["qid"], r["semantic_rank"], r["repo_id"]) for r in got) == [(1, 1, "r/3"), (1, 2, "r/2"), (2, 1, "r/0"), (2, 2, "r/1")]
