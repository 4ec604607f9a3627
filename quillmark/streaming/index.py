"""Incremental index builds from a folder of record files, with Structured Streaming, that keep every vector they have asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..schemas import ENTRY, RECORD
from .runs import Runs

#: Calls that a task makes before its vectors are committed.
CALLS = 16
_PAID = "fingerprint string, vector array<float>"


class BuildError(RuntimeError):
    """The model failed; what it had answered before is kept."""


def _asked(embed: Callable, dimension: int | None, batch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(fingerprint, vector, error): a task stops asking at its first error, and gives what it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        error = None
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                vectors: list = [None] * len(part)
                if error is None:
                    try:
                        got = [np.asarray(v, np.float32) for v in embed(part["input"].tolist())]
                        if len(got) != len(part) or any(v.ndim != 1 or len(v) != (dimension or len(got[0])) for v in got):
                            raise ValueError(f"not {len(part)} vectors of one length")
                        vectors = got
                    except Exception as e:  # the build fails with it, once what was answered is kept
                        error = str(e) or type(e).__name__
                yield pd.DataFrame({"fingerprint": part["fingerprint"], "vector": pd.Series(vectors, part.index, dtype=object), "error": error if vectors[0] is None else None})

    return run


def paid(store: Runs, inputs: DataFrame, embed: Callable, dimension: int | None = None, batch: int = index.BATCH, calls: int = CALLS) -> None:
    """Adds the vectors of (fingerprint, input) that the store lacks, each text asked for once, in rounds of `calls` batches a task.

    Each round is a run of the store before the next is asked for, so an error or
    a killed build costs the answers of one round at most, and an error none that
    had come. The rounds' inputs are written once, beside the store.
    """
    spark = store.spark
    need = inputs.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("input").alias("input"))
    held = store.lookup(need.select("fingerprint")).select("fingerprint")
    path = f"{store.folder}/todo-{uuid.uuid4().hex}"
    tasks = spark.sparkContext.defaultParallelism
    missing = need.join(held, "fingerprint", "left_anti")
    size = batch * calls * tasks
    # Rounds by hash of the fingerprint, so that they are of about equal sizes without an order of all rows.
    count = missing.count()
    rounds = -(-count // size)
    if not rounds:
        return
    missing.withColumn("round", F.pmod(F.xxhash64("fingerprint"), F.lit(rounds))).repartition("round").write.partitionBy("round").parquet(path)
    for number in range(rounds):
        todo = spark.read.schema("fingerprint string, input string, round long").parquet(path).where(F.col("round") == number).drop("round")
        answers = f"{path}-answers-{number}"
        todo.repartition(tasks).mapInPandas(_asked(embed, dimension, batch), f"{_PAID}, error string").write.parquet(answers)
        got = spark.read.schema(f"{_PAID}, error string").parquet(answers)
        store.append(store.next_batch(), got.where("error is null").drop("error"))
        failed = got.where("error is not null").first()
        if failed is not None:
            raise BuildError(failed["error"])
    store.drop(path)


def vectors(spark: SparkSession, entries_dir: str) -> Runs:
    return Runs(spark, f"{entries_dir.rstrip('/')}/vectors", _PAID, "fingerprint")


def entry_runs(spark: SparkSession, entries_dir: str) -> Runs:
    return Runs(spark, f"{entries_dir.rstrip('/')}/entries", ENTRY, "repo_id")


def build_batch(spark: SparkSession, batch: DataFrame, number: int, entries_dir: str, embed: Callable, dimension: int | None = None, calls: int = CALLS) -> None:
    """Adds one batch of records to the index of a folder; a batch that is there already, or a text that was paid for, is not asked for again."""
    runs, store = entry_runs(spark, entries_dir), vectors(spark, entries_dir)
    if runs.holds(number):
        return
    rows = index.wanted(batch)
    last = rows.groupBy("repo_id").agg(F.max_by(F.struct("fingerprint", "input", "metadata", "pos"), "pos").alias("r")).select("repo_id", "r.*")
    paid(store, last, embed, dimension, calls=calls)
    have = store.lookup(last.select("fingerprint").where("fingerprint is not null"))
    runs.append(number, last.join(have, "fingerprint").withColumnRenamed("fingerprint", "embedding_input_fingerprint"))


def build_incrementally(spark: SparkSession, records_dir: str, entries_dir: str, checkpoint_dir: str, embed: Callable, dimension: int | None = None, calls: int = CALLS):
    """Takes what is new in records_dir (JSON lines) and adds the entries that it needs; returns the finished query.

    A batch's vectors come from those of earlier texts of its fingerprints, and the
    rest from the model; nothing regroups history, see runs. A batch that is
    replayed after a failure asks for what it has no answer to yet.
    """
    incoming = spark.readStream.schema(f"pos BIGINT, {RECORD}").json(records_dir)

    def take(batch: DataFrame, number: int) -> None:
        build_batch(batch.sparkSession, batch, number, entries_dir, embed, dimension, calls)

    query = incoming.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, entries_dir: str) -> DataFrame:
    """The last version of each entry."""
    return entry_runs(spark, entries_dir).current()
