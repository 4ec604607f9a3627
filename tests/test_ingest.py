"""Shared quotas, halved batches, protocols that stand in for each other, and ingest runs that try failures again."""

import json
import os
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillmark.operators import ingest, records
from quillmark.sources import hosting, quota

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


class FileClock(quota.Clock):
    """A clock that tasks and the driver share: a file that holds the time."""

    def __init__(self, path):
        self.path = path

    def now(self):
        with open(self.path) as f:
            return float(f.read())

    def sleep(self, seconds):
        now = self.now()
        with open(self.path + f".{os.getpid()}", "w") as f:
            f.write(str(now + seconds))
        os.replace(self.path + f".{os.getpid()}", self.path)


class FixtureHost:
    """A host that knows owner/<n>: each token has so many calls until its reset, poisoned ids fail every graph batch, and calls are logged."""

    def __init__(self, folder, calls, resets, poisoned=(), unknown=()):
        self.folder, self.calls, self.resets, self.poisoned, self.unknown = folder, calls, resets, set(poisoned), set(unknown)
        self.clock = FileClock(f"{folder}/clock")
        self.clock.sleep if os.path.exists(f"{folder}/clock") else open(f"{folder}/clock", "w").write("0")

    def spend(self, token, what):
        log = f"{self.folder}/calls-{token}"
        now = self.clock.now()
        before = sum(1 for line in open(log)) if os.path.exists(log) else 0
        with open(log, "a") as f:
            f.write(json.dumps([now, what]) + "\n")
        # A token's quota lasts for so many calls; the next is refused until the reset, and from then on it has no limit.
        if before >= self.calls.get(token, 1 << 30) and now < self.resets[token]:
            raise hosting.HostError("quota is used up", 403, self.resets[token])

    def get(self, path, token):
        self.spend(token, path)
        repo = "/".join(path.split("/")[1:3])
        if repo in self.unknown or path.count("/") > 2:
            raise hosting.HostError(f"not found: {path}", 404)
        return {"full_name": repo, "name": repo.split("/")[1], "html_url": f"https://h/{repo}", "description": "by rest"}

    def post(self, query, variables, token):
        asked = [f"{variables[f'owner{i}']}/{variables[f'name{i}']}" for i in range(len(variables) // 2)]
        self.spend(token, asked)
        if self.poisoned & set(asked):
            return {"data": None, "errors": [{"message": "something went wrong"}]}
        lost = [i for i, r in enumerate(asked) if r in self.unknown]
        data = {f"r{i}": None if i in lost else {"nameWithOwner": r, "name": r.split("/")[1], "url": f"https://h/{r}", "description": "by graph"} for i, r in enumerate(asked)}
        return {"data": data, "errors": [{"type": "NOT_FOUND", "path": [f"r{i}"], "message": "unknown"} for i in lost]}

    def client(self):
        return quota.Host(self.get, self.post, self.clock)

    def log(self, token):
        path = f"{self.folder}/calls-{token}"
        return [json.loads(line) for line in open(path)] if os.path.exists(path) else []


def repos(spark, n):
    return spark.createDataFrame([(f"o/{i}", i) for i in range(n)], "repo_id string, pos long")


def test_rounds_share_tokens_and_wait_for_their_renewal(spark, tmp_path):
    host = FixtureHost(str(tmp_path), {"a": 2, "b": 9}, {"a": 900.0, "b": 4000.0})
    got = quota.rounds(repos(spark, 300), host.client, ["a", "b"], str(tmp_path / "rounds"), batch=10, task_wait=60, clock=host.clock)
    rows = {r["repo_id_requested"]: r for r in got.collect()}
    assert rows.keys() == {f"o/{i}" for i in range(300)} and all(r["error"] is None and r["protocol"] == "graph" for r in rows.values())
    asked = {}
    for token, calls in host.calls.items():
        log = host.log(token)
        refused = log[calls][0]
        assert all(not refused < at < host.resets[token] for at, _ in log[calls + 1 :]), token  # none between the refusal and the reset
        asked[token] = len(log)
    assert len(os.listdir(tmp_path / "rounds")) >= 2 and asked["a"] > 3
    # Every repository was answered once; refused calls are asked again.
    assert sum(asked.values()) <= 30 + 2 + 4


def test_quota_that_is_renewed_too_late_is_an_error_of_the_rows_left(spark, tmp_path):
    host = FixtureHost(str(tmp_path), {"a": 1}, {"a": 1e6})
    rows = quota.rounds(repos(spark, 30), host.client, ["a"], str(tmp_path / "rounds"), batch=10, round_wait=100, clock=host.clock).collect()
    assert len(rows) == 30 and sum(r["error"] is None for r in rows) == 10
    assert {re.sub(r"\d+", "n", r["error"]) for r in rows if r["error"]} == {"quota is renewed in n s, more than the n s allowed"}


def test_a_poisoned_batch_is_halved_and_the_other_protocol_stands_in(spark, tmp_path):
    host = FixtureHost(str(tmp_path), {}, {}, poisoned=["o/7"], unknown=["o/13", "o/7"])
    asker = quota.Asker(host.client(), quota.Quota(["t"], host.clock))
    rows = {r["repo_id_requested"]: r for r in asker.batch([f"o/{i}" for i in range(20)])}
    errors = {k: r["error"] for k, r in rows.items() if r.get("error")}
    assert len(rows) == 20 and errors.keys() == {"o/7", "o/13"} and rows["o/7"]["status"] == 404
    assert errors["o/7"] == "graph: something went wrong; rest: not found: repos/o/7"
    batches = [what for _, what in host.log("t") if isinstance(what, list)]
    assert len(batches) <= 2 * 5 + 1  # not one for each repository
    host = FixtureHost(str(tmp_path), {}, {}, poisoned=["o/7"])
    rows = quota.rounds(repos(spark, 20), host.client, ["u"], str(tmp_path / "r"), clock=host.clock)
    made = {r["repo_id"]: r["github"]["description"] for r in ingest.records_of(rows, F.lit("now")).collect()}
    assert made == {f"o/{i}": "by rest" if i == 7 else "by graph" for i in range(20)}
    first = quota.Asker(host.client(), quota.Quota(["v"], host.clock), first="rest")
    assert next(first.batch(["o/1"]))["protocol"] == "rest"


def test_source_deals_disjoint_tokens_and_hands_rows_back(spark, tmp_path):
    folder = str(tmp_path)
    host = FixtureHost(folder, {"a": 1, "b": 50}, {"a": 5000.0, "b": 6000.0})

    class Fixture(quota.QuotaSource):
        def host(self):
            return host.client()

    reader = Fixture({"repos": ",".join(f"o/{i}" for i in range(40)), "tokens": "a,b,c"}).reader(None)
    own = [p.value[1] for p in reader.partitions()]
    assert sorted(sum(own, [])) == [0, 1, 2] and len(own) == 3
    spark.dataSource.register(Fixture)
    read = spark.read.format("shared_quota").options(repos=",".join(f"o/{i}" for i in range(40)), tokens="a,b", batch="5")
    rows = read.load().collect()
    left = {r["repo_id_requested"] for r in rows if r["kind"] == "left"}
    assert len(left) == 15 and {r["repo_id_requested"] for r in rows if r["kind"] == "answer"} | left == {f"o/{i}" for i in range(40)}
    assert [(r["token"], r["ready"]) for r in rows if r["kind"] == "token"] == [(0, 5000.0)]
    before = len(host.log("a"))
    again = spark.read.format("shared_quota").options(repos=",".join(sorted(left)), tokens="a,b", batch="5", ready='{"0": 5000}').load().collect()
    assert len(host.log("a")) == before and {r["repo_id_requested"] for r in again if r["kind"] == "left"} < left


def test_graph_errors_carry_the_reset_time():
    payload = {"data": {"rateLimit": {"resetAt": "2026-01-01T00:00:00Z"}, "r0": None}, "errors": [{"message": "limited"}]}
    with pytest.raises(hosting.HostError, match="limited") as e:
        hosting.graph_answer(payload, 1)
    assert e.value.reset == 1767225600.0
    assert hosting.graph_answer({"data": {"r0": {"name": "x"}, "r1": None}, "errors": [{"type": "NOT_FOUND", "path": ["r1"]}]}, 2) == [{"name": "x"}, None]
    with pytest.raises(hosting.HostError):
        hosting.graph_answer({"errors": [{"type": "NOT_FOUND", "path": ["r0", "tree"]}]}, 1)


def test_ingest_tries_failures_again_and_keeps_only_records(spark, tmp_path):
    path, none = str(tmp_path / "ck"), spark.createDataFrame([], "repo_id string, pos long")
    down = FixtureHost(str(tmp_path), {}, {}, unknown=[f"o/{i}" for i in range(3)])
    up = FixtureHost(str(tmp_path), {}, {})
    take = lambda host: lambda rows: quota.rounds(rows, host.client, ["t"], str(tmp_path / "rounds"), clock=host.clock)
    merged, outcomes = ingest.run(repos(spark, 4), none, take(down), path, F.lit("now"))
    assert {r["repo_id"]: r["outcome"] for r in outcomes.collect()} == {"o/0": "failed", "o/1": "failed", "o/2": "failed", "o/3": "generated"}
    assert [r["repo_id"] for r in merged.collect()] == ["o/3"]
    merged, outcomes = ingest.run(repos(spark, 4), none, take(up), path, F.lit("now"), resume=True)
    assert {r["repo_id"]: (r["outcome"], r["error"]) for r in outcomes.collect()} == {"o/0": ("generated", None), "o/1": ("generated", None), "o/2": ("generated", None), "o/3": ("resumed", None)}
    assert [r["repo_id"] for r in merged.orderBy("first").collect()] == ["o/0", "o/1", "o/2", "o/3"]


def test_ingest_profiles_in_the_same_run_and_retries_a_report(spark, tmp_path):
    host = FixtureHost(str(tmp_path), {}, {})
    none = spark.createDataFrame([], "repo_id string, pos long")
    take = lambda rows: quota.rounds(rows, host.client, ["t"], str(tmp_path / "rounds"), clock=host.clock)

    def profile(rows):
        bad = F.col("repo_id") == "o/1"
        return rows.withColumns({"new_profile": F.when(~bad, F.struct(F.lit("s").alias("summary"))), "refresh_error": F.when(bad, F.lit("no answer"))})

    path = str(tmp_path / "ck")
    merged, outcomes = ingest.run(repos(spark, 3), none, take, path, F.lit("now"), profile=profile)
    assert {r["repo_id"]: r["error"] for r in outcomes.collect()} == {"o/0": None, "o/1": "no answer", "o/2": None}
    assert {r["repo_id"]: r["llm_profile"]["summary"] for r in merged.collect()} == {"o/0": "s", "o/2": "s"}
    old = spark.createDataFrame([("o/1", 0, "stale"), ("o/2", 1, "kept")], "repo_id string, pos long, name string")
    failed = spark.createDataFrame([("o/1",)], "repo_id string")
    merged, outcomes = ingest.run(repos(spark, 3), old, take, str(tmp_path / "again"), F.lit("now"), failed=failed)
    assert {r["repo_id"]: r["outcome"] for r in outcomes.collect()} == {"o/0": "skipped", "o/1": "generated", "o/2": "skipped"}
    assert {r["repo_id"]: r["name"] for r in merged.collect()} == {"o/1": "1", "o/2": "kept"}


def test_merge_leaves_out_ids_without_a_record(spark):
    have = spark.createDataFrame([("a", 0, "x")], "repo_id string, pos long, name string")
    asked = spark.createDataFrame([("b", 0), ("c", 1)], "repo_id string, pos long")
    made = spark.createDataFrame([("c", 0, "y")], "repo_id string, pos long, name string")
    assert [(r["repo_id"], r["name"]) for r in records.ordered_merge(have, asked, made).orderBy("first").collect()] == [("a", "x"), ("c", "y")]
