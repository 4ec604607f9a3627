"""Ingest: snapshots to records, plans, outcomes and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import RECORD_SCHEMA

# The fields of a REST answer that a record takes, and the record's fields that they become.
METADATA = (
    "full_name STRING, name STRING, html_url STRING, description STRING, owner STRUCT<login: STRING>, topics ARRAY<STRING>, stargazers_count BIGINT, forks_count BIGINT, language STRING, "
    "license STRUCT<spdx_id: STRING>, archived BOOLEAN, disabled BOOLEAN, homepage STRING, default_branch STRING, created_at STRING, updated_at STRING, pushed_at STRING, open_issues_count BIGINT"
)
REST_GITHUB = {"stars": "stargazers_count", "forks": "forks_count", "license": "license.spdx_id", "open_issues": "open_issues_count"}
GITHUB_FIELDS = ["description", "topics", "stars", "forks", "language", "license", "archived", "disabled", "homepage", "default_branch", "created_at", "updated_at", "pushed_at", "open_issues"]


def rest_facts(metadata: Column) -> Column:
    """What a record says of a repository, from a REST answer's JSON: repo_id, owner, name, url and github."""
    m = F.from_json(metadata, METADATA)

    def at(field: str) -> Column:
        out = m
        for part in REST_GITHUB.get(field, field).split("."):
            out = out[part]
        return F.coalesce(out, F.array().cast("array<string>")) if field == "topics" else out

    return F.struct(
        m["full_name"].alias("repo_id"), m["owner"]["login"].alias("owner"), m["name"].alias("name"), m["html_url"].alias("url"), F.struct(*(at(k).alias(k) for k in GITHUB_FIELDS)).alias("github")
    )


def _when(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules)))


def structure_signals(paths: Column, readme: Column) -> Column:
    """What a repository's paths show, in a fixed order of signals."""
    paths = F.coalesce(paths, F.array().cast("array<string>"))
    exact = lambda *names: F.arrays_overlap(paths, text.words(list(names)))
    under = lambda *dirs: F.exists(paths, lambda p: p.rlike("^(" + "|".join(dirs) + ")/"))
    return _when(
        (readme | F.exists(paths, lambda p: F.lower(p).startswith("readme")), "has_readme"),
        (exact("package.json"), "has_package_json"),
        (exact("pyproject.toml", "setup.py", "requirements.txt"), "has_python_manifest"),
        (exact("go.mod"), "has_go_mod"),
        (exact("Cargo.toml"), "has_cargo_manifest"),
        (exact("yarn.lock", "package-lock.json", "pnpm-lock.yaml"), "has_js_lockfile"),
        (under("src"), "has_src_directory"),
        (under("packages"), "has_packages_directory"),
        (under("docs", "documentation", "website"), "has_docs_directory"),
        (under("examples", "fixtures"), "has_examples_or_fixtures"),
        (under("tests") | F.exists(paths, lambda p: F.contains(p, F.lit("__tests__")) | p.rlike(r"(\.test\.js|\.test\.ts|_test\.go)$")), "has_tests"),
        (under("scripts"), "has_scripts_directory"),
    )


def evidence_gaps(description: Column, topics: Column, excerpt: Column, paths: Column, truncated: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return _when(
        (empty(description), "missing_github_description"),
        (none(topics), "missing_github_topics"),
        (empty(excerpt), "missing_readme_excerpt"),
        (paths.isNull(), "missing_repository_tree"),
        (paths.isNotNull() & truncated, "truncated_repository_tree"),
        (none(paths), "missing_tree_paths"),
    )


def records_of(snapshots: DataFrame, taken_at: Column) -> DataFrame:
    """Records (without a profile) of the snapshots that didn't fail, whichever protocol gave them."""
    from ..sources.hosting import graph_facts

    rows = snapshots.where("error is null")
    facts = F.when(F.col("protocol") == "graph", graph_facts(F.col("metadata"))).otherwise(rest_facts(F.col("metadata")))
    rows = rows.withColumn("facts", facts).withColumn("excerpt", text.readme_excerpt(F.col("readme_text")))
    fact, host = (lambda k: F.col(f"facts.{k}")), (lambda k: F.col(f"facts.github.{k}"))
    description, topics, url, excerpt = host("description"), host("topics"), fact("url"), F.col("excerpt")
    has_readme = F.col("readme_path").isNotNull()
    rows = rows.withColumn("signals", structure_signals(F.col("paths"), has_readme))
    blob = lambda kind: F.when(has_readme & url.isNotNull(), F.concat(url, F.lit(f"/{kind}/HEAD/"), F.col("readme_path")))
    item = lambda kind, what, of: F.struct(F.lit(kind).alias("kind"), what.alias("text"), of.alias("source_url"))
    said = [
        (F.coalesce(description, F.lit("")) != "", item("github_description", description, url)),
        (F.size(topics) > 0, item("github_topics", F.array_join(topics, ", "), F.concat(url, F.lit("/topics")))),
        (excerpt.isNotNull() & has_readme, item("readme_excerpt", excerpt, blob("blob"))),
        (F.size("signals") > 0, item("structure_signals", F.array_join("signals", ", "), url)),
    ]
    return rows.select(
        F.lit(RECORD_SCHEMA).alias("schema_version"), "repo_id_requested", fact("repo_id").alias("repo_id"), F.lit("github").alias("platform"), *(fact(k).alias(k) for k in ("owner", "name", "url")),
        F.struct(*(host(k).alias(k) for k in GITHUB_FIELDS)).alias("github"),
        F.when(has_readme, F.struct(F.col("readme_path").alias("path"), blob("blob").alias("source_url"), blob("raw").alias("download_url"), excerpt.alias("excerpt"))).alias("readme"),
        F.struct(F.col("signals"), F.coalesce(F.size("paths"), F.lit(0)).alias("tree_file_count"), F.col("truncated").alias("tree_truncated")).alias("structure"),
        F.array_compact(F.array(*(F.when(c, x) for c, x in said))).alias("evidence"),
        evidence_gaps(description, topics, excerpt, F.col("paths"), F.coalesce("truncated", F.lit(False))).alias("evidence_gaps"),
        F.lit("candidate").alias("lifecycle_state"), F.lit("github_api").alias("snapshot_source"), taken_at.alias("snapshot_time"),
    )


def plan(requested: DataFrame, existing: DataFrame, checkpointed: DataFrame | None = None, failed: DataFrame | None = None, force: bool = False) -> DataFrame:
    """requested (repo_id, pos) with what to do: process, or skip with a reason.

    Requested ids are compared with the canonical ids of existing records as
    they are: a renamed repository is taken again. failed restricts the plan to
    the ids of a failure report.
    """
    rows = requested.join(existing.select("repo_id").distinct().withColumn("known", F.lit(True)), "repo_id", "left")
    done = checkpointed.select("repo_id").distinct().withColumn("done", F.lit(True)) if checkpointed is not None else None
    rows = rows.join(done, "repo_id", "left") if done is not None else rows.withColumn("done", F.lit(None).cast("boolean"))
    again = failed.select("repo_id").distinct().withColumn("again", F.lit(True)) if failed is not None else None
    rows = rows.join(again, "repo_id", "left") if again is not None else rows.withColumn("again", F.lit(None).cast("boolean"))
    skip = F.when(F.col("done"), "resumed").when(F.lit(failed is not None) & F.col("again").isNull(), "not_failed").when(F.lit(not force and failed is None) & F.col("known"), "existing")
    return rows.select("repo_id", "pos", F.coalesce(skip, F.lit("process")).alias("action"))


def report(outcomes: DataFrame) -> DataFrame:
    """One row of counts of outcomes (repo_id, outcome, has_readme, abstained, seconds)."""
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.agg(
        F.count("*").alias("total"), is_("generated").alias("generated"), is_("failed").alias("failed"), is_("skipped").alias("skipped"), is_("resumed").alias("resumed"),
        F.count_if("has_readme").alias("with_readme"), F.count_if("abstained").alias("abstained"), F.round(F.sum("seconds"), 4).alias("duration_seconds"),
    )


def failure(repo_id: Column, reason: Column, at: Column) -> Column:
    return F.struct(repo_id.alias("repo_id"), reason.alias("reason"), reason.alias("error"), at.alias("attempted_at"))


def resumed(refreshed: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Records with the profiles that an earlier run of the same refresh had made, and `resumed`; those rows need no call."""
    done = checkpoint.where("llm_profile is not null").groupBy("repo_id").agg(F.max_by("llm_profile", "pos").alias("done"))
    rows = refreshed.join(done, "repo_id", "left").withColumn("resumed", F.col("done").isNotNull())
    return rows.withColumn("llm_profile", F.coalesce("done", "llm_profile")).drop("done").select(*refreshed.columns, "resumed")


def refresh_report(rows: DataFrame, reason: Column) -> DataFrame:
    """One row of counts of a refresh's rows (with resumed, new_profile and refresh_error): what was due is refreshed, resumed or failed, the rest is skipped."""
    resumed, failed = F.coalesce("resumed", F.lit(False)), F.col("refresh_error").isNotNull()
    made = F.col("new_profile").isNotNull()
    return rows.agg(
        F.count("*").alias("input_count"), F.count_if(made & ~resumed).alias("refreshed_count"), F.count_if(resumed).alias("resumed_count"),
        F.count_if(~resumed & ~made & ~failed & reason.isNull()).alias("skipped_count"), F.count_if(failed).alias("failed_count"),
    )


def run(
    requested: DataFrame, existing: DataFrame, take: Callable[[DataFrame], DataFrame], checkpoint: str, taken_at: Column, resume: bool = False, force: bool = False,
    failed: DataFrame | None = None, profile: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records in order, outcomes): take what the plan says, append it to the checkpoint, merge it with what is there.

    take() makes snapshots of (repo_id), see quota.rounds(); profile() gives records
    new_profile and refresh_error, as models.refreshed does, and a record without a
    profile is a failure. A checkpoint of an earlier run is only used to resume it,
    and only what succeeded there is done: failures are tried again. failed (the ids of
    a failure report) restricts the run to them, and their old records go.
    """
    from ..operators.health import guard
    from .records import ordered_merge

    spark = requested.sparkSession
    guard(spark, checkpoint, resume, force)
    before = spark.read.parquet(checkpoint) if resume else spark.createDataFrame([], "repo_id string, asked string, pos long, error string, attempt int")
    attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1
    # A renamed repository is done by the id that was asked for, too.
    good = before.where("error is null")
    done = good.select("repo_id").union(good.select("asked")).where("repo_id is not null").distinct()
    todo = plan(requested, existing, done, failed, force)
    made = take(todo.where("action = 'process'").select("repo_id"))
    rows = records_of(made, taken_at).withColumn("asked", F.col("repo_id_requested")).withColumn("error", F.lit(None).cast("string"))
    if profile is not None:
        rows = profile(rows)
        profiles = [c for c in ("llm_profile",) if c in rows.columns]
        rows = rows.withColumn("error", F.coalesce("refresh_error", F.when(F.col("new_profile").isNull(), F.lit("no profile was made"))))
        rows = rows.drop(*profiles, "refresh_error").withColumnRenamed("new_profile", "llm_profile")
    lost = made.where("error is not null").select(F.col("repo_id_requested").alias("repo_id"), F.col("repo_id_requested").alias("asked"), "error")
    rows = rows.unionByName(lost, allowMissingColumns=True)
    rows = rows.withColumns({"pos": F.monotonically_increasing_id(), "attempt": F.lit(attempt)})
    rows.write.mode("append" if resume else "overwrite").parquet(checkpoint)
    log = spark.read.parquet(checkpoint)
    completed = log.where("error is null").withColumn("pos", F.struct("attempt", "pos")).drop("error", "asked", "attempt")
    if failed is not None:
        existing = existing.join(failed.select("repo_id").distinct(), "repo_id", "left_anti")
    order = lambda df: df.withColumn("pos", F.struct(F.lit(0).alias("attempt"), F.col("pos").cast("long").alias("pos")))
    merged = ordered_merge(order(existing), order(requested.select("repo_id", "pos")), completed)
    last = log.where(F.col("attempt") == attempt).groupBy(F.col("asked").alias("repo_id")).agg(F.max("error").alias("error"))
    is_ = lambda action: F.col("action") == action
    outcome = F.when(is_("process") & F.col("error").isNotNull(), "failed").when(is_("process"), "generated").when(is_("resumed"), "resumed").otherwise("skipped")
    return merged, todo.join(last, "repo_id", "left").select("repo_id", "pos", outcome.alias("outcome"), "error")


def succeeded(outcomes: DataFrame) -> bool:
    """Whether a run did anything: it fails only if all that was asked failed."""
    return outcomes.isEmpty() or not outcomes.where("outcome <> 'failed'").isEmpty()
