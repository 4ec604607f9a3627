"""Snapshots from a host that limits each token: tokens dealt out to tasks, batches halved, protocols that stand in for each other.

A token belongs to one task at a time, so tasks share nothing: a task asks with
its own tokens in turn, lets one rest until its quota is renewed, waits a little,
and else hands its remaining rows and its tokens' times back. rounds() plans the
next round from those: rows left go to the tokens that are ready, or wait for the
first that will be. Each round is a written table, so a lost executor repeats its
own calls at most.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import hosting
from .hosting import HostError, TokenPool

BATCH = 20
#: Seconds that a task waits for its own tokens before it hands its rows back, and that rounds() waits in all for one round.
TASK_WAIT, ROUND_WAIT = 60.0, 3600.0
#: What a task gives: answers by protocol, rows left over (kind 'left'), and its tokens' times (kind 'token').
ANSWERS = f"kind string, token int, ready double, answer string, {hosting.SNAPSHOT}"
_NAMES = [f.split(" ")[0] for f in ANSWERS.split(", ")]


class Clock:
    """Time and waiting; tests put another one in."""

    def now(self) -> float:
        return time.time()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds)


class OutOfQuota(RuntimeError):
    """No token of this task is ready soon enough."""


@dataclass
class Host:
    """A host's two protocols, each call with a token: get(path, token) and post(query, variables, token)."""

    get: Callable[[str, str], dict]
    post: Callable[[str, dict, str], dict]
    clock: Clock = field(default_factory=Clock)


class Quota:
    """Calls with a task's own tokens, none before its quota is renewed."""

    def __init__(self, tokens: list[str], clock: Clock, longest: float = TASK_WAIT, ready: dict[str, float] | None = None):
        self.pool, self.longest = TokenPool(tokens, clock.now, clock.sleep), longest
        self.pool.resting.update(ready or {})

    def ask(self, call: Callable[[str], dict]) -> dict:
        """call(token), with the next token where one's quota is used up."""
        while True:
            token = self.pool.take()
            if token is None:
                try:
                    self.pool.wait(self.longest)
                except HostError as e:
                    raise OutOfQuota(str(e)) from e
                continue
            try:
                return call(token)
            except HostError as e:
                if e.reset is None:
                    raise
                self.pool.rest(token, e.reset)


class Asker:
    """One task's calls: graph batches that are halved when they fail, and the other protocol for what fails alone."""

    def __init__(self, host: Host, quota: Quota, first: str = "graph"):
        if first not in ("graph", "rest"):
            raise ValueError(f"no such protocol: {first}")
        self.host, self.quota, self.first = host, quota, first

    def graph(self, repos: list[str]) -> list[dict | None]:
        def call(token: str) -> dict:
            payload = hosting.attempted(lambda: self.host.post(*hosting.graph_query(repos), token), self.host.clock.sleep)
            return {"got": hosting.graph_answer(payload, len(repos))}

        return self.quota.ask(call)["got"]

    def rest(self, repo: str) -> dict:
        row = hosting.snapshot(repo, lambda path: self.quota.ask(lambda token: self.host.get(path, token)), self.host.clock.sleep)
        if row["error"] is not None:
            raise HostError(row["error"], row["status"])
        return row

    def _one(self, repo: str, protocol: str) -> dict:
        if protocol == "rest":
            return self.rest(repo)
        got = self.graph([repo])[0]
        if got is None:
            raise HostError(f"not found: {repo}", 404)
        return self._row(repo, got)

    @staticmethod
    def _row(repo: str, answer: dict) -> dict:
        return {"repo_id_requested": repo, "answer": json.dumps(answer, ensure_ascii=False), "protocol": "graph"}

    def single(self, repo: str, failed: HostError | None = None) -> dict:
        """A repository's row by the first protocol, unless that has failed already, or else by the other; an error names both."""
        other = "rest" if self.first == "graph" else "graph"
        if failed is None:
            try:
                return self._one(repo, self.first)
            except HostError as e:
                failed = e
        try:
            return self._one(repo, other)
        except HostError as e:
            return {"repo_id_requested": repo, "error": f"{self.first}: {failed}; {other}: {e}", "status": e.status or failed.status, "protocol": other}

    def batch(self, repos: list[str]) -> Iterator[dict]:
        """Rows of these repositories; a batch that fails is asked for by halves."""
        if self.first == "rest" or len(repos) == 1:
            for repo in repos:
                yield self.single(repo)
            return
        try:
            got = self.graph(repos)
        except HostError:
            half = len(repos) // 2
            yield from self.batch(repos[:half])
            yield from self.batch(repos[half:])
            return
        for repo, answer in zip(repos, got):
            yield self._row(repo, answer) if answer is not None else self.single(repo, HostError(f"not found: {repo}", 404))


def answered(repos: Iterator[str], asker: Asker, numbers: dict[str, int], batch: int = BATCH) -> Iterator[dict]:
    """Rows of ANSWERS: what the asker gives, then, once it is out of quota, the rows left, and its tokens' times."""
    held: list[str] = []
    out = False

    def ask(part: list[str]) -> Iterator[dict]:
        nonlocal out
        known = set()
        if not out:
            try:
                for row in asker.batch(part):
                    known.add(row["repo_id_requested"])
                    yield {"kind": "answer", **row}
            except OutOfQuota:
                out = True
        for repo in part:
            if repo not in known:
                yield {"kind": "left", "repo_id_requested": repo}

    for repo in repos:
        held.append(repo)
        if len(held) == batch:
            yield from ask(held)
            held = []
    if held:
        yield from ask(held)
    for token, ready in asker.quota.pool.resting.items():
        yield {"kind": "token", "token": numbers[token], "ready": ready}


def rounds(
    repos: DataFrame, host: Callable[[], Host], tokens: list[str], folder: str, first: str = "graph", batch: int = BATCH, column: str = "repo_id",
    task_wait: float = TASK_WAIT, round_wait: float = ROUND_WAIT, clock: Clock | None = None,
) -> DataFrame:
    """Snapshots (hosting.SNAPSHOT) of a table's distinct repositories, whatever number of rounds the tokens' quotas take.

    host() makes a client in each task. Tables of the rounds go to `folder`, shared
    by all machines. Once no token is renewed within round_wait seconds, what is left
    is rows with that error. The driver sees a count and a time for each token.
    """
    if not tokens:
        raise ValueError("a host with quotas needs a token")
    clock, spark = clock or Clock(), repos.sparkSession
    left, ready, done = repos.select(F.col(column).alias("repo")).where("repo is not null").distinct(), {}, []
    while True:
        now = clock.now()
        able = [i for i in range(len(tokens)) if ready.get(i, 0.0) <= now]
        if not able:
            pause = min(ready.values()) - now
            if pause > round_wait:
                why = F.lit(f"quota is renewed in {pause:.0f} s, more than the {round_wait:.0f} s allowed")
                done.append(left.select(F.col("repo").alias("repo_id_requested"), F.lit("answer").alias("kind"), why.alias("error")))
                break
            clock.sleep(pause)
            continue

        def run(batches: Iterator[pd.DataFrame], able=able) -> Iterator[pd.DataFrame]:
            own = able[TaskContext.get().partitionId() % len(able)]
            client = host()
            asker = Asker(client, Quota([tokens[own]], client.clock, task_wait), first)
            rows: list[dict] = []
            for row in answered((r for pdf in batches for r in pdf["repo"]), asker, {tokens[own]: own}, batch):
                rows.append(row)
                if len(rows) >= 10 * batch:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

        path = f"{folder.rstrip('/')}/round-{len(done):04d}-{uuid.uuid4().hex}"
        left.repartition(len(able)).mapInPandas(run, ANSWERS).write.parquet(path)
        got = spark.read.schema(ANSWERS).parquet(path)
        done.append(got.where("kind = 'answer'"))
        ready |= {r["token"]: r["ready"] for r in got.where("kind = 'token'").groupBy("token").agg(F.max("ready").alias("ready")).collect()}
        left = got.where("kind = 'left'").select(F.col("repo_id_requested").alias("repo"))
        if left.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    return snapshots_of(every)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(k) for k in _NAMES] for r in rows], columns=_NAMES).astype({"token": "Int32", "status": "Int32", "ready": "Float64", "truncated": "boolean"})


def snapshots_of(answers: DataFrame) -> DataFrame:
    """Snapshots of rows of ANSWERS, of either protocol."""
    fields = [f.split(" ")[0] for f in hosting.SNAPSHOT.split(", ")]
    graph = hosting.graph_rows(answers.where("kind = 'answer' and answer is not null"))
    return answers.where("kind = 'answer' and answer is null").select(*fields).unionByName(graph.select(*fields))


class QuotaSource(DataSource):
    """spark.read.format("shared_quota"): rows of ANSWERS for a list of repositories, by partitions that own disjoint tokens.

    Options: repos and tokens, separated by commas; first (graph or rest), batch, wait
    (seconds a task waits for its tokens) and ready (JSON, seconds by token's number).
    A subclass gives the host. Rows left are read again with the ready times that came.
    """

    @classmethod
    def name(cls) -> str:
        return "shared_quota"

    def schema(self) -> str:
        return ANSWERS

    def host(self) -> Host:
        raise NotImplementedError("a subclass of QuotaSource knows its host")

    def reader(self, schema) -> DataSourceReader:
        return QuotaReader(self)


class QuotaReader(DataSourceReader):
    def __init__(self, source: QuotaSource):
        listed = lambda k: [x.strip() for x in source.options.get(k, "").split(",") if x.strip()]
        self.source, self.repos, self.tokens = source, list(dict.fromkeys(listed("repos"))), listed("tokens")
        if not self.tokens:
            raise ValueError("a host with quotas needs a token")

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(len(self.tokens), len(self.repos)))
        return [InputPartition((self.repos[i::n], list(range(i, len(self.tokens), n)))) for i in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        repos, own = partition.value
        options, host = self.source.options, self.source.host()
        numbers = {self.tokens[i]: i for i in own}
        known = json.loads(options.get("ready", "{}"))
        ready = {self.tokens[i]: float(known[str(i)]) for i in own if str(i) in known}
        quota = Quota(list(numbers), host.clock, float(options.get("wait", TASK_WAIT)), ready)
        for row in answered(iter(repos), Asker(host, quota, options.get("first", "graph")), numbers, int(options.get("batch", BATCH))):
            yield tuple(row.get(k) for k in _NAMES)
