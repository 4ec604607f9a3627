"""Sources and sinks: repository lists, JSON arrays, indexes, checkpoints, reports and datasets."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import METADATA, RECORD
from . import json_scan


class SourceError(ValueError):
    """A file isn't what its role asks for."""


def repo_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, raw, repo_id) of the lines that aren't blank or comments, in order; a bad line is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "line"))
    rows = lines.select(F.col("pos").cast("long"), text.stripped(F.col("line")).alias("raw")).where("raw is not null and not startswith(raw, '#')")
    parsed = text.repo_parse(F.col("raw"))
    why = F.concat_ws(" ", F.lit("not a repository:"), "raw", parsed["reason"])
    return rows.select("pos", "raw", F.when(parsed["reason"].isNotNull(), F.raise_error(why)).otherwise(parsed["repo_id"]).alias("repo_id"))


def _whole(spark: SparkSession, path: str, role: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True).withColumn("json", F.try_parse_json("value"))
    kind = F.schema_of_variant("json")
    df = df.withColumn("kind", F.when(F.col("json").isNull(), "invalid").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("scalar"))
    row = df.select("kind").first()
    if row is None or row["kind"] == "invalid":
        raise SourceError(f"{role} is no valid JSON: {path}")
    return df


def json_object(spark: SparkSession, path: str, role: str, schema: str) -> DataFrame:
    """One row: a JSON object read by a DDL schema; wrong-typed fields are null."""
    df = _whole(spark, path, role)
    if df.first()["kind"] != "object":
        raise SourceError(f"{role} must be a JSON object: {path}")
    return df.select(F.from_json("value", schema).alias("r")).select("r.*")


def _objects(spark: SparkSession, path: str, role: str, key: str | None = None) -> tuple[DataFrame, dict | list]:
    """((pos, raw) of an array's objects, the rest of the document), read by byte range."""
    try:
        rows, rest = json_scan.scan(spark, path, key)
    except json_scan.ScanError as e:
        why = {"items": "must hold objects only", "type": "must be a JSON " + ("array" if key is None else f"object with an array {key}")}.get(e.kind, "is no valid JSON")
        raise SourceError(f"{role} {why}: {path}") from e
    bad = F.raise_error(F.lit(f"{role} is no valid JSON: {path}")).cast("string")
    return rows.select("pos", F.when(F.try_parse_json("raw").isNull(), bad).otherwise(F.col("raw")).alias("raw")), rest


def json_array(spark: SparkSession, path: str, role: str, schema: str) -> DataFrame:
    """(pos, ...) of a JSON array of objects read by a DDL schema, in order; one file is read by many tasks."""
    rows, _ = _objects(spark, path, role)
    return rows.select("pos", F.from_json("raw", schema).alias("r")).select("pos", "r.*")


def records(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, "the records file", RECORD)


def decoded(values: DataFrame, column: str, dimension: int | None = None) -> DataFrame:
    """values with `vector` of a column of base64 little-endian float32 or of JSON number lists; null where neither fits."""

    def decode(value: str | None) -> np.ndarray | None:
        try:
            if value is None:
                return None
            if value.lstrip().startswith("["):
                out = np.array(pd.io.json.ujson_loads(value), np.float32)
            else:
                out = np.frombuffer(base64.b64decode(value, validate=True), "<f4").astype(np.float32)
        except (ValueError, TypeError, binascii.Error):
            return None
        return out if out.ndim == 1 and (dimension is None or len(out) == dimension) else None

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([decode(v) for v in values], dtype=object)

    return values.withColumn("vector", run(F.col(column)))


def encoded(vector: Column) -> Column:
    """A vector as base64 of little-endian float32, for export."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode() for v in values], dtype=object)

    return run(vector)


INDEX = (
    "index_version INT, record_schema_version INT, embedding_model STRING, embedding_base_url STRING, embedding_input_version INT, dimension INT, built_at STRING, record_count BIGINT, skipped ARRAY<STRING>"
)
INDEX_ENTRY = f"repo_id STRING, embedding_input_fingerprint STRING, vector STRING, metadata STRUCT<{METADATA}>"


def index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, one row of index_meta) of an index file, which is read by many tasks."""
    raw, rest = _objects(spark, path, "the index", "vectors")
    head = spark.createDataFrame([(json.dumps({k: v for k, v in rest.items() if k != "vectors"}),)], "j string")
    meta = head.select(F.from_json("j", INDEX).alias("r")).select("r.*")
    rows = raw.select("pos", F.from_json("raw", INDEX_ENTRY).alias("e")).select("pos", "e.repo_id", "e.embedding_input_fingerprint", "e.metadata", F.col("e.vector").alias("raw"))
    return decoded(rows, "raw").drop("raw"), meta


def checkpoint(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """The last record of each id in a JSON-lines file; a broken last line is left out, any other is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(text.stripped(F.col("line")).isNotNull())
    rows = lines.select(F.col("pos").cast("long"), "line", F.try_parse_json("line").isNull().alias("broken"))
    edge = rows.agg(F.max("pos").alias("last"), F.min(F.when(F.col("broken"), F.col("pos"))).alias("bad")).first()
    if edge["bad"] is not None and edge["bad"] != edge["last"]:
        raise SourceError(f"line {edge['bad'] + 1} of the checkpoint is no valid JSON: {path}")
    good = rows.where("not broken").select("pos", F.from_json("line", schema).alias("r")).where(F.coalesce(F.col("r.repo_id"), F.lit("")) != "")
    return good.groupBy("r.repo_id").agg(F.max_by("r", "pos").alias("r"), F.max("pos").alias("pos")).select("pos", "r.*")


def append_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def failed_ids(spark: SparkSession, path: str) -> DataFrame:
    doc = json_object(spark, path, "the failure report", "failed ARRAY<STRUCT<repo_id: STRING, reason: STRING, error: STRING, attempted_at: STRING>>")
    if doc.first()["failed"] is None:
        raise SourceError(f"the failure report must have a list of what failed: {path}")
    return doc.select(F.explode("failed").alias("f")).select("f.repo_id").where(text.stripped(F.col("repo_id")).isNotNull()).distinct()


REPORT = "dataset_name STRING, case_count BIGINT, metrics MAP<STRING, DOUBLE>, results ARRAY<STRUCT<id: STRING, query: STRING, expected_repo_id: STRING, top_repo_id: STRING, top_confidence: STRING, exact_rank: INT, acceptable_rank: INT, top1_status: STRING, tags: ARRAY<STRING>>>"


def eval_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, one row of dataset_name, case_count and metrics) of an evaluation report, a JSON object."""
    doc = json_object(spark, path, "the evaluation report", REPORT)
    rows = doc.select(F.explode("results").alias("r")).select("r.*")
    exact, fine = (F.col("top1_status").isin(*s) for s in (["exact"], ["exact", "acceptable"]))
    return rows.withColumns({"exact_match": exact, "acceptable_match": fine, "abstained": F.col("top_repo_id").isNull()}), doc.drop("results")


def write_index(entries: DataFrame, path: str, meta: dict) -> None:
    """An index file: its meta fields, and the entries in order of pos, vectors as base64; entries pass through a few at a time."""
    import os

    head = json.dumps(meta | {"record_count": entries.count()}, ensure_ascii=False)[:-1]
    raw = entries.withColumn("v", encoded(F.col("vector"))).orderBy("pos")
    row = F.struct("repo_id", "embedding_input_fingerprint", F.col("v").alias("vector"), "metadata")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(head + ', "vectors": [')
        for i, r in enumerate(raw.select(F.to_json(row).alias("j")).toLocalIterator()):
            f.write(",\n"[: 2 if i else 0] + r["j"])
        f.write("]}\n")
    os.replace(path + ".tmp", path)


CASE = "id: STRING, query: STRING, expected_repo_id: STRING, acceptable_repo_ids: ARRAY<STRING>, acceptable: ARRAY<STRING>, acceptable_families: ARRAY<STRING>, tags: ARRAY<STRING>, notes: STRING"


def dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, families) of an evaluation dataset."""
    from ..schemas import DATASET_SCHEMA

    doc = json_object(spark, path, "the dataset", f"schema_version INT, dataset_name STRING, families MAP<STRING, ARRAY<STRING>>, cases ARRAY<STRUCT<{CASE}>>")
    row = doc.select("schema_version", "dataset_name").first()
    if row["schema_version"] != DATASET_SCHEMA or not (row["dataset_name"] or "").strip():
        raise SourceError(f"the dataset must name itself and have schema_version {DATASET_SCHEMA}: {path}")
    families = doc.select(F.explode(F.coalesce("families", F.create_map().cast("map<string,array<string>>"))).alias("family", "repo_ids"))
    cases = doc.select(F.posexplode("cases").alias("pos", "c")).select(F.col("pos").cast("long"), "c.*")
    none = F.array().cast("array<string>")
    ids = F.array_distinct(F.concat(F.coalesce("acceptable_repo_ids", none), F.coalesce("acceptable", none)))
    return cases.withColumns({"acceptable_repo_ids": ids, "acceptable_families": F.coalesce("acceptable_families", none), "tags": F.coalesce("tags", none)}), families


def canonical_queries(spark: SparkSession, path: str, cases: DataFrame) -> DataFrame:
    """(id, canonical): a text for each case and no other."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "canonical"))
    odd = doc.join(cases, "id", "left_anti").select("id").union(cases.join(doc, "id", "left_anti").select("id")).union(doc.where(text.stripped(F.col("canonical")).isNull()).select("id"))
    bad = [r[0] for r in odd.limit(5).collect()]
    if bad:
        raise SourceError(f"canonical queries and cases don't match: {bad}")
    return doc


def write_json(rows: DataFrame | dict, path: str) -> None:
    """A report (rows, or one object), as one pretty-printed file on the driver's disk, put in place whole; rows pass through a few at a time."""
    import os

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        if isinstance(rows, dict):
            json.dump(rows, f, ensure_ascii=False, indent=2)
        else:
            gap = "\n"
            f.write("[")
            for row in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
                f.write(gap + json.dumps(json.loads(row["j"]), ensure_ascii=False, indent=2))
                gap = ",\n"
            f.write("\n]")
        f.write("\n")
    os.replace(path + ".tmp", path)
