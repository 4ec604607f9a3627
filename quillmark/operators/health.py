"""Preflight checks, smoke checks of committed tables, guards, and texts for terminals."""

from __future__ import annotations

import os
from collections.abc import Callable, MutableMapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECK = "name string, status string, message string"


class Refused(RuntimeError):
    """A run would overwrite an earlier one's progress."""


def guard(spark: SparkSession, path: str, resume: bool, force: bool = False) -> None:
    """Refuse to start over where a checkpoint is: resume it, or say that it may be overwritten."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) and not (resume or force):
        raise Refused(f"there is a checkpoint at {path}: resume it, or force a new run")


def doctor(spark: SparkSession, files: dict[str, str], env: MutableMapping[str, str] = os.environ, probe: Callable | None = None, strict: bool = False) -> DataFrame:
    """(name, status, message): ok, warn or error for each endpoint, its probe, and each named file."""
    from ..sources import endpoints

    rows = []
    for kind in endpoints.VARIABLES:
        try:
            config = endpoints.endpoint(kind, env)
            rows.append((kind, "ok", f"{config.model} at {config.base_url}"))
            if probe is not None:
                try:
                    rows.append((f"{kind}_probe", "ok", str(probe(kind, config))))
                except Exception as e:  # the probe's error is the check's outcome
                    rows.append((f"{kind}_probe", "error", str(e)))
        except endpoints.NotConfigured as e:
            rows.append((kind, "error" if kind == "embedding" or strict else "warn", str(e)))
    for name, path in files.items():
        there = os.path.exists(path)
        rows.append((name, "ok" if there else "error" if strict else "warn", path if there else f"no such file: {path}"))
    return spark.createDataFrame(rows, CHECK)


def coverage(cases: DataFrame, repos: DataFrame) -> DataFrame:
    """(id, role, repo_id) of the ids that cases expect or accept but the repository list lacks; cases has acceptable_set."""
    none = F.array().cast("array<string>")
    roles = F.concat(
        F.array(F.struct(F.lit("expected").alias("role"), F.col("expected_repo_id").alias("repo_id"))),
        F.transform(F.coalesce("acceptable_set", none), lambda r: F.struct(F.lit("acceptable").alias("role"), r.alias("repo_id"))),
    )
    return cases.select("id", F.explode(roles).alias("r")).select("id", "r.*").join(repos.select("repo_id").distinct(), "repo_id", "left_anti").select("id", "role", "repo_id")


def smoke(repos: DataFrame, records: DataFrame, entries: DataFrame, meta: DataFrame, results: DataFrame, cases: DataFrame) -> DataFrame:
    """(name, ok, n): repositories and records are there, the index has as many vectors as it says, no serious mismatch, and all cases are covered."""
    count = lambda df, c="true": df.agg(F.count_if(F.expr(c)).alias("n"))
    said = meta.select(F.col("record_count").alias("said"))  # one row
    rows = [
        count(repos).select(F.lit("repos").alias("name"), (F.col("n") > 0).alias("ok"), "n"),
        count(records).select(F.lit("records").alias("name"), (F.col("n") > 0).alias("ok"), "n"),
        count(entries).join(said).select(F.lit("index").alias("name"), ((F.col("n") > 0) & F.col("n").eqNullSafe(F.col("said"))).alias("ok"), "n"),
        count(results, "top1_status = 'serious_mismatch'").select(F.lit("eval_report").alias("name"), (F.col("n") == 0).alias("ok"), "n"),
        count(coverage(cases, repos)).select(F.lit("eval_dataset").alias("name"), (F.col("n") == 0).alias("ok"), "n"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def with_entries(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """hits with what a terminal shows of their entries; hits without an entry stay."""
    m = lambda k: F.col(f"metadata.{k}").alias(k)
    return hits.join(entries.select("repo_id", m("summary"), m("language"), m("stars"), m("project_type")), "repo_id", "left")


def cell(value) -> str:
    """A value for a terminal: lists with commas, numbers short, nothing as a dash."""
    if value is None or value == [] or value == "":
        return "-"
    if isinstance(value, list):
        return ", ".join(map(cell, value))
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:,}" if isinstance(value, int) else f"{value:.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)


def hit_lines(rows: list) -> list[str]:
    """Search hits, numbered, with score, confidence and reasons."""
    out = []
    for r in rows:
        r = r.asDict()
        out.append(f"{r['rk']}. {r['repo_id']}  {cell(r.get('score'))}  {cell(r.get('confidence'))}")
        out += [f"   {k}: {cell(r[k])}" for k in ("summary", "language", "stars", "why") if r.get(k)]
    return out or ["no results"]


def section_lines(rows: list, value: str = "n") -> list[str]:
    """(section, name, value) tables, such as statistics, validation, verification and plans, a heading for each section."""
    out, last = [], None
    for r in rows:
        r = r.asDict()
        if r.get("section") != last:
            last = r.get("section")
            out.append(f"{last}:")
        out.append(f"  {cell(r.get('name'))}: {cell(r.get(value))}")
    return out


def summary_lines(rows: list) -> list[str]:
    return [f"{r['name']}: {r['count']} ({r['rate']:.1%})" for r in rows]


def gate_lines(rows: list) -> list[str]:
    return [f"{'ok' if r['ok'] else 'FAIL'} {r['metric']} {cell(r['actual'])} {r['operator']} {cell(r['threshold'])}" for r in rows]
