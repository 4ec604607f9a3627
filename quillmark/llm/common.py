"""What the training-data operators share: work tables, splits and components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Prefix of the columns that operators add for themselves, so that they clash
#: with no column of the caller's.
OWN = "__qm_"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for work tables; see session.work_dir."""
    return session.work_dir(spark)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written as a table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, mod `mod`; null ids count as the text ''."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """A worker's object of that key, made once and kept from task to task until given_back()."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def given_back() -> None:
    """Drops what a worker keeps of other operators' tasks and returns freed memory to the system.

    Workers outlive the tasks of one operator, and allocators would hold the
    most that any task needed: stages of a pipeline would add up.
    """
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def cleaned(spark: SparkSession) -> None:
    """Has the driver collect its garbage: its heap shrinks, and what finished jobs shuffled and broadcast is deleted.

    Else an operator of many jobs fills the driver's heap to its limit first.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge: component is the smallest node reachable.

    Alternates the large-star and small-star steps on edges (child, parent), so
    that no task needs a whole component and the driver sees only a count and a
    checksum; joins are merges, as broadcasts would be built in the driver, one after another. Nulls and self-loops link nothing; a node without an edge to
    another node gets no row.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = written(
        edges.where((x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("p")).distinct(), "edges"
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "p").cast("decimal(38,0)")).alias("h")).first()

    before = mark(now)
    while before["n"]:
        # Large star: each node tells its larger neighbours of the smallest one it knows.
        both = now.union(now.select("p", "u"))
        low = both.groupBy("u").agg(F.min("p").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("p > u").join(low.hint("merge"), "u").select(F.col("p").alias("u"), F.col("m").alias("p")).distinct()
        # Small star: each node's smaller neighbours, and itself, hang under the smallest.
        low = large.groupBy("u").agg(F.min("p").alias("m"))
        joined = large.join(low.hint("merge"), "u")
        small = joined.where("p > m").select(F.col("p").alias("u"), F.col("m").alias("p")).union(low.select("u", F.col("m").alias("p")))
        now = written(small.distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("p").alias("component")).union(now.select("p", "p")).distinct()
