"""Index builds keep what they have paid for, and runs stay few."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillmark.operators import generate, models
from quillmark.streaming import index as stream
from quillmark.streaming.runs import Runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def model(folder, fail_at=None):
    """An embedding client that logs each text it answers, and fails on a text that contains fail_at."""

    def embed(texts):
        if fail_at and any(fail_at in t for t in texts):
            raise ConnectionError("the model is down")
        with open(f"{folder}/asked-{os.getpid()}", "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return models.hash_embedding(texts, 8)

    return embed


def asked(folder):
    return [json.loads(line) for name in os.listdir(folder) if name.startswith("asked-") for line in open(f"{folder}/{name}")]


def test_failed_build_resumes_without_asking_twice(spark, tmp_path):
    folder, out = str(tmp_path), str(tmp_path / "out")
    rows = generate.synthetic_records(spark, 400)
    rows.write.json(str(tmp_path / "in"))
    with pytest.raises(Exception, match="the model is down"):
        stream.build_incrementally(spark, str(tmp_path / "in"), out, str(tmp_path / "ck"), model(folder, "000399"), 8, calls=1)
    before = asked(folder)
    store = stream.vectors(spark, out)
    kept = store.current().count()
    assert 0 < kept == len(before) == len(set(before)) and stream.current(spark, out).count() == 0
    stream.build_incrementally(spark, str(tmp_path / "in"), out, str(tmp_path / "ck"), model(folder), 8, calls=1)
    texts = asked(folder)
    assert len(texts) == len(set(texts)) == store.current().count()
    got = stream.current(spark, out)
    assert got.count() == 400 and got.where(F.size("vector") != 8).count() == 0
    # The same records again cost nothing; one changed text costs one call.
    rows.write.json(str(tmp_path / "in"), mode="append")
    stream.build_incrementally(spark, str(tmp_path / "in"), out, str(tmp_path / "ck"), model(folder), 8)
    assert len(asked(folder)) == len(texts)
    rows.where("pos = 5").withColumn("github", F.col("github").withField("description", F.lit("another text"))).write.json(str(tmp_path / "in"), mode="append")
    stream.build_incrementally(spark, str(tmp_path / "in"), out, str(tmp_path / "ck"), model(folder), 8)
    assert len(asked(folder)) == len(texts) + 1
    assert [r["metadata"]["description"] for r in stream.current(spark, out).where("pos = 5").collect()] == ["another text"]


def test_killed_build_keeps_finished_rounds(spark, tmp_path, monkeypatch):
    """The driver dies between rounds: what was committed is not asked for again."""
    folder, out = str(tmp_path), str(tmp_path / "out")
    rows = generate.synthetic_records(spark, 600)
    append, rounds = Runs.append, []

    def dies(self, batch, df):
        if rounds:
            raise KeyboardInterrupt
        rounds.append(batch)
        append(self, batch, df)

    monkeypatch.setattr(Runs, "append", dies)
    with pytest.raises(KeyboardInterrupt):
        stream.build_batch(spark, rows, 0, out, model(folder), 8, calls=1)
    monkeypatch.undo()
    kept = {r["fingerprint"] for r in stream.vectors(spark, out).current().select("fingerprint").collect()}
    done = len(asked(folder))
    stream.build_batch(spark, rows, 0, out, model(folder), 8, calls=1)
    assert 0 < len(kept) < done  # a round whose answers weren't committed is asked again, and no other
    assert len(asked(folder)) == done + 600 - len(kept)
    stream.build_batch(spark, rows, 0, out, model(folder, "synthetic"), 8)  # a replayed batch asks nothing
    assert stream.current(spark, out).count() == 600


def test_runs_stay_few_and_latest_rows_win(spark, tmp_path, monkeypatch):
    from quillmark.streaming import runs

    monkeypatch.setattr(runs, "BUCKET_ROWS", 20)
    table, want = Runs(spark, str(tmp_path / "t"), "k string, v long", "k"), {}
    for n in range(12):
        rows = [(f"k{(7 * n + i) % 90}", 100 * n + i) for i in range(10)]
        want |= dict(rows)
        table.append(n, spark.createDataFrame(rows, "k string, v long"))
        table.append(n, spark.createDataFrame([("k0", -1)], "k string, v long"))  # replayed: nothing
        assert len(table.spans()) <= 5
    assert {r["k"]: r["v"] for r in table.current().collect()} == want
    some = spark.createDataFrame([("k1",), ("k2",), ("no",)], "k string")
    assert {r["k"]: r["v"] for r in table.lookup(some).collect()} == {k: want[k] for k in ("k1", "k2")}
    assert any("run_bucket=b" + c in name for c in "0123456789abcdef" for _, names, _ in os.walk(tmp_path) for name in names)  # large runs are split
    assert Runs(spark, str(tmp_path / "none"), "k string, v long", "k").current().count() == 0
