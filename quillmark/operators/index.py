"""The embedding index: incremental builds keyed by fingerprint, verification and statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..schemas import INDEX_VERSION, LISTS, RECORD_SCHEMA
from .records import most_common, record_id

BATCH = 64


def input_text() -> Column:
    return text.embedding_text(F.col("repo_id"), F.col("name"), lambda k: F.col(f"github.{k}"), lambda k: F.col(f"llm_profile.{k}"))


def entry_metadata() -> Column:
    g, p = (lambda k: F.col(f"github.{k}")), (lambda k: F.col(f"llm_profile.{k}"))
    return F.struct(
        F.col("schema_version"), F.col("name"), F.col("url"), text.strip_list(p("aliases")).alias("aliases"), g("description").alias("description"), text.strip_list(g("topics")).alias("topics"),
        g("language").alias("language"), g("stars").cast("string").alias("stars"), g("forks").alias("forks"), g("archived").alias("archived"), g("disabled").alias("disabled"),
        g("pushed_at").alias("pushed_at"), p("summary").alias("summary"), *(text.strip_list(p(k)).alias(k) for k in ("use_cases", "capabilities")), p("project_type").alias("project_type"),
        *(text.strip_list(p(k)).alias(k) for k in ("ecosystem", "replaces", "related_projects")), p("search_text").alias("search_text"), text.strip_list(p("search_phrases")).alias("search_phrases"),
    )


def wanted(records: DataFrame) -> DataFrame:
    """repo_id, pos, input, fingerprint and metadata of each record with an id; fingerprint is null where nothing is to be embedded."""
    rows = records.where(record_id().isNotNull()).select(record_id().alias("repo_id"), "pos", input_text().alias("input"), entry_metadata().alias("metadata"))
    return rows.withColumn("fingerprint", text.fingerprint(F.col("input")))


def embedded(inputs: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimension: int | None = None, batch: int = BATCH) -> DataFrame:
    """inputs with a vector of each `input`, from batches of an injected model client."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors: list = []
            for i in range(0, len(texts), batch):
                part = texts.iloc[i : i + batch].tolist()
                got = embed(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                vectors += [np.asarray(v, np.float32) for v in got]
            if any(len(v) != (dimension or len(vectors[0])) for v in vectors):
                raise ValueError("the model's vectors differ in length")
            yield pd.Series(vectors, dtype=object)

    call = F.pandas_udf(run, "array<float>").asNondeterministic()  # a model is asked once for a row
    return inputs.withColumn("vector", call(F.col("input")))


def build_plan(records: DataFrame, existing: DataFrame, dimension: int | None = None) -> DataFrame:
    """wanted rows with action: reuse (the old vector fits and its fingerprint is equal), embed or skip."""
    old = existing.groupBy("repo_id").agg(F.max_by(F.struct("embedding_input_fingerprint", "vector"), "pos").alias("old"))
    rows = wanted(records).join(old, "repo_id", "left")
    fits = F.col("old.vector").isNotNull() & (F.lit(dimension is None) | (F.size("old.vector") == F.lit(dimension or 0)))
    same = F.coalesce((F.col("old.embedding_input_fingerprint") == F.col("fingerprint")) & fits, F.lit(False))
    return rows.withColumn("action", F.when(F.col("fingerprint").isNull(), "skip").when(same, "reuse").otherwise("embed"))


def build(records: DataFrame, existing: DataFrame, embed: Callable, dimension: int | None = None) -> DataFrame:
    """The new entries: reused vectors first, then those embedded now; metadata is that of the records."""
    plan = build_plan(records, existing, dimension)
    kept = plan.where("action = 'reuse'").select("repo_id", "fingerprint", F.col("old.vector").alias("vector"), "metadata", F.lit(0).alias("group"), "pos")
    new = embedded(plan.where("action = 'embed'").drop("old"), embed, dimension).select("repo_id", "fingerprint", "vector", "metadata", F.lit(1).alias("group"), "pos")
    return kept.unionByName(new).withColumnRenamed("fingerprint", "embedding_input_fingerprint")


def verify(records: DataFrame, entries: DataFrame, dimension: int | None, meta: dict) -> DataFrame:
    """(section, name, n): errors, warnings, and a status row (ok, stale or invalid)."""
    want = wanted(records).select("repo_id", "fingerprint", F.lit(None).cast("boolean").alias("entry"), F.lit(None).cast("string").alias("held"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("int").alias("size"))
    have = entries.select("repo_id", F.lit(None).cast("string"), F.lit(True), "embedding_input_fingerprint", "pos", F.size("vector"))
    # One pass over both tables: each id's entry, and its records as counts by fingerprint, meet in one group.
    latest = F.max_by("held", F.when(F.col("entry"), F.struct("pos", "held")))
    prints = want.union(have).groupBy("repo_id", F.when(F.col("entry").isNull(), F.struct("fingerprint")).alias("print")).agg(
        F.count("*").alias("n"), latest.alias("held"), F.max(F.when(F.col("entry"), F.struct("pos", "held"))).alias("last"),
        F.count_if(F.col("entry") & (F.coalesce("held", F.lit("")) == "")).alias("blank"), F.count_if(F.col("entry") & (F.coalesce("size", F.lit(-1)) < 0)).alias("invalid"),
        F.count_if(F.col("entry") & (F.col("size") >= 0) & F.lit(dimension is not None) & (F.col("size") != F.lit(dimension or 0))).alias("off"),
    )
    own = Window.partitionBy("repo_id")
    entry = F.col("print").isNull()
    each = prints.select(
        "*", F.max("last").over(own).alias("there"), F.max(F.when(~entry, 1)).over(own).alias("recorded"),
    )
    due, known = ~entry & F.col("print.fingerprint").isNotNull(), F.col("there").isNotNull()
    total = lambda c, n="n": F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)).cast("long")
    one = each.agg(
        total(due & ~known).alias("missing_vectors"), total(due & known & ~F.col("there.held").eqNullSafe(F.col("print.fingerprint"))).alias("stale_vectors"),
        total(~entry & F.col("print.fingerprint").isNull()).alias("skipped_expected"), total(entry, "blank").alias("missing_fingerprints"), total(entry, "invalid").alias("invalid_vectors"),
        total(entry, "off").alias("dimension_mismatch"), (total(entry) - F.count_if(entry)).alias("duplicate_vectors"), total(entry).alias("vector_count"),
        F.count_if(entry & F.col("recorded").isNull()).alias("extra_vectors"),
    )
    fixed = {"index_version": INDEX_VERSION, "record_schema_version": RECORD_SCHEMA, "embedding_input_version": text.EMBEDDING_INPUT_VERSION}
    off = [F.lit(int(meta.get(k) != v)).cast("long").alias(f"{k}_mismatch") for k, v in fixed.items()]
    one = one.select("*", *off)
    count_off = F.lit(meta.get("record_count")).cast("long")
    one = one.withColumn("record_count_mismatch", F.when(count_off != F.col("vector_count"), 1).otherwise(0).cast("long"))
    errors = ["missing_vectors", "stale_vectors", "missing_fingerprints", "invalid_vectors", "dimension_mismatch", "duplicate_vectors", *(f"{k}_mismatch" for k in fixed)]
    warnings = ["extra_vectors", "record_count_mismatch", "skipped_expected", "vector_count"]
    out = one.unpivot([], errors + warnings, "name", "n").select(F.when(F.col("name").isin(errors), "errors").when(F.col("name").isin(warnings[:2]), "warnings").otherwise("counts").alias("section"), "name", F.col("n").cast("long").alias("n"))
    total = sum((F.col(e) for e in errors), F.lit(0))
    stale = F.col("missing_vectors") + F.col("stale_vectors")
    status = F.when(total == 0, "ok").when(total == stale, "stale").otherwise("invalid")
    return out.unionByName(one.select(F.lit("status").alias("section"), status.alias("name"), F.lit(1).cast("long").alias("n")))


def stats(entries: DataFrame, dimension: int, limit: int = 10) -> DataFrame:
    """(section, name, value): counts, the float32 matrix in MB, and the most common languages and topics."""
    a = entries.agg(
        F.count("*").cast("double").alias("vector_count"),
        F.round(F.count("*") * F.lit(dimension) * 4 / 1048576, 1).alias("estimated_memory_mb"),
        F.count_if(F.col("metadata").isNull()).cast("double").alias("missing_metadata_count"),
        F.count_if(F.coalesce("embedding_input_fingerprint", F.lit("")) == "").cast("double").alias("missing_fingerprint_count"),
    )
    out = a.unpivot([], a.columns, "name", "value").select(F.lit("counts").alias("section"), "name", "value")
    topics = entries.select("pos", F.posexplode(text.nonblank(F.col("metadata.topics"))).alias("i", "name")).select("name", F.struct("pos", "i").alias("place"))
    languages = entries.where(text.stripped(F.col("metadata.language")).isNotNull()).select(F.col("metadata.language").alias("name"), F.col("pos").alias("place"))
    for section, values in (("languages", languages), ("topics", topics)):
        out = out.unionByName(most_common(values, "name", "place", limit).select(F.lit(section).alias("section"), "name", F.col("count").cast("double").alias("value")))
    return out


__all__ = ["LISTS", "build", "build_plan", "embedded", "entry_metadata", "input_text", "stats", "verify", "wanted"]
