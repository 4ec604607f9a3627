"""Record quality: normal profiles, validation, statistics, inspection and refresh plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import score, text
from ..schemas import PROFILE_PROMPT, RECORD_SCHEMA

SHORT_TEXT = 24
LIST_FIELDS = ["use_cases", "capabilities", "not_for", "aliases", "ecosystem", "replaces", "related_projects", "search_phrases"]
TEXT_FIELDS = ["summary", "project_type", "search_text"]
KEPT_FIELDS = ["provider", "model", "generated_at", "prompt_version", "prompt_hash"]


def record_id() -> Column:
    """The id, or the requested one where that is null or ''; stripped, null if blank."""
    return text.stripped(F.coalesce(F.nullif("repo_id", F.lit("")), "repo_id_requested"))


def normal_profile(profile: str = "llm_profile") -> Column:
    """The profile struct with every field clean; confidence is low unless it is high, medium or low."""
    p = lambda k: F.col(f"{profile}.{k}")
    confidence = F.lower(p("confidence"))
    return F.struct(
        *(text.stripped(p(k)).alias(k) for k in TEXT_FIELDS),
        *(text.clean_list(p(k)).alias(k) for k in LIST_FIELDS),
        F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("low").alias("confidence"),
        F.coalesce(p("abstained"), F.lit(False)).alias("abstained"),
        *(p(k).alias(k) for k in KEPT_FIELDS),
    )


def flagged(records: DataFrame, expected_schema: int = RECORD_SCHEMA, expected_prompt: int | None = None) -> DataFrame:
    """pos, id, and for each record the arrays of its errors and warnings.

    A record without an id has that error only; one without a profile has no
    profile findings. Repeats of an id come from a window over each id.
    """
    p = lambda k: F.col(f"profile.{k}")
    rows = records.select("*", record_id().alias("id"), normal_profile().alias("profile"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    no_text = p("search_text").isNull()
    has_profile = F.col("llm_profile").isNotNull()
    errors = F.array(
        F.when(~F.col("schema_version").eqNullSafe(expected_schema), "schema_version_mismatch"),
        F.when(missing("url"), "missing_url"),
        F.when(missing("name"), "missing_name"),
        F.when(~has_profile, "missing_llm_profile"),
        F.when(has_profile & p("summary").isNull() & ~p("abstained"), "missing_summary"),
        F.when(has_profile & no_text & ~p("abstained"), "missing_search_text"),
    )
    warnings = F.array(
        F.when(p("summary").isNull() & p("abstained"), "abstained_missing_summary"),
        F.when(no_text & p("abstained"), "abstained_missing_search_text"),
        F.when(F.length(p("search_text")) < SHORT_TEXT, "search_text_too_short"),
        F.when(F.size(p("aliases")) == 0, "missing_aliases"),
        F.when(p("project_type").isNull(), "missing_project_type"),
        F.when(F.size(p("ecosystem")) == 0, "missing_ecosystem"),
        F.when(~p("prompt_version").eqNullSafe(expected_prompt), "profile_prompt_version_mismatch") if expected_prompt is not None else F.lit(None).cast("string"),
        F.when(p("confidence") == "low", "low_confidence_profile"),
        F.when(p("abstained"), "profile_abstained"),
    )
    known = F.col("id").isNotNull()
    return rows.select(
        "pos", "id", "schema_version", "profile", F.col("github.archived").eqNullSafe(True).alias("archived"), F.col("github.disabled").eqNullSafe(True).alias("disabled"),
        (F.coalesce("readme", F.lit("")) == "").alias("no_readme"), (known & (nth > 1)).alias("repeat"),
        F.when(known, F.array_compact(errors)).otherwise(F.array(F.lit("missing_repo_id"))).alias("errors"),
        F.when(known & has_profile, F.array_compact(warnings)).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def validation_counts(records: DataFrame, **options) -> DataFrame:
    """(section, name, n): errors, warnings, quality and versions, in one pass over the flags."""
    f = flagged(records, **options)
    kinds = f.select(F.explode(F.concat(F.transform("errors", lambda e: F.struct(F.lit("errors").alias("section"), e.alias("name"))), F.transform("warnings", lambda w: F.struct(F.lit("warnings").alias("section"), w.alias("name"))), F.when(F.col("repeat"), F.array(F.struct(F.lit("errors").alias("section"), F.lit("duplicate_repo_id").alias("name")))).otherwise(F.array().cast("array<struct<section:string,name:string>>")))).alias("k"))
    found = kinds.groupBy("k.section", "k.name").agg(F.count("*").alias("n"))
    has = lambda c, k: F.array_contains(c, k)
    quality = f.agg(
        F.greatest(F.count_if((F.size("errors") == 0)) - F.count_if("repeat"), F.lit(0)).alias("ok"),
        F.count_if(has("errors", "missing_search_text")).alias("missing_search_text"), F.count_if(has("warnings", "missing_aliases")).alias("missing_aliases"),
        F.count_if(has("warnings", "search_text_too_short")).alias("search_text_too_short"), F.count_if(has("warnings", "profile_abstained")).alias("profile_abstained"),
        F.count_if(has("warnings", "low_confidence_profile")).alias("low_confidence"), F.count_if("archived").alias("archived"), F.count_if("disabled").alias("disabled"),
        F.count_if("no_readme").alias("missing_readme"), F.count_if("repeat").alias("duplicates"), F.count("*").alias("record_count"),
    )
    quality = quality.unpivot([], quality.columns, "name", "n").select(F.lit("quality").alias("section"), "name", "n")
    versions = f.groupBy(F.coalesce(F.col("schema_version").cast("string"), F.lit("None")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("schema_versions").alias("section"), "name", "n")
    prompts = f.groupBy(F.coalesce(F.col("profile.prompt_version").cast("string"), F.lit("None")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("prompt_versions").alias("section"), "name", "n")
    return found.unionByName(quality).unionByName(versions).unionByName(prompts)


def most_common(values: DataFrame, value: str, pos: str, n: int) -> DataFrame:
    """(value, count) of the n most frequent values; ties go to the one that comes first."""
    counted = values.groupBy(value).agg(F.count("*").alias("count"), F.min(pos).alias("first"))
    return counted.orderBy(F.desc("count"), "first").limit(n).select(value, "count")


def stats(records: DataFrame, limit: int = 10) -> DataFrame:
    """(section, name, value): ratios, confidence and the most common languages, topics, types and ecosystems."""
    f = flagged(records, expected_prompt=PROFILE_PROMPT)
    share = lambda c: score.ratio(F.count_if(c), F.count("*"))
    ratios = f.agg(
        share(F.array_contains("warnings", "profile_abstained")).alias("abstained"), share(F.array_contains("warnings", "low_confidence_profile")).alias("low_confidence"),
        share(F.col("archived")).alias("archived"), share(F.col("disabled")).alias("disabled"), share(F.col("no_readme")).alias("missing_readme"),
    )
    out = ratios.unpivot([], ratios.columns, "name", "value").select(F.lit("ratios").alias("section"), "name", "value")
    row = lambda df, section, value: df.select(F.lit(section).alias("section"), F.col(value).alias("name"), F.col("count").cast("double").alias("value"))
    out = out.unionByName(row(f.groupBy(F.col("profile.confidence").alias("name")).agg(F.count("*").alias("count")), "confidence", "name"))
    place = F.struct("pos", "i").alias("place")
    for section, values in (
        ("languages", records.where(text.stripped(F.col("github.language")).isNotNull()).select(F.col("github.language").alias("name"), F.col("pos").alias("place"))),
        ("topics", records.select("pos", F.posexplode(text.nonblank(F.col("github.topics"))).alias("i", "name")).select("name", place)),
        ("project_types", f.where("profile.project_type is not null").select(F.col("profile.project_type").alias("name"), F.col("pos").alias("place"))),
        ("ecosystems", f.select("pos", F.posexplode("profile.ecosystem").alias("i", "name")).select("name", place)),
    ):
        out = out.unionByName(row(most_common(values, "name", "place", limit), section, "name"))
    return out


def inspect(records: DataFrame, contains: str, limit: int) -> DataFrame:
    """The first records whose id holds a text, whatever its case, with a preview of their search text."""
    found = records.where(F.contains(F.lower(F.coalesce(record_id(), F.lit(""))), F.lit(contains.lower())))
    return found.orderBy("pos").limit(max(0, limit)).select(
        "pos", record_id().alias("repo_id"), "name", F.col("github.language").alias("language"), F.col("github.stars").alias("stars"), F.col("llm_profile.confidence").alias("confidence"),
        F.left(F.col("llm_profile.search_text"), F.lit(160)).alias("preview"),
    )


def refresh_reason(only_missing_text: bool = False, expected_prompt: int | None = None) -> Column:
    """Why a record's profile is due for a refresh, the first reason that holds; null if it isn't."""
    p = normal_profile()
    if only_missing_text:
        return F.when(p["search_text"].isNull(), "missing_search_text")
    prompt = F.when(~p["prompt_version"].eqNullSafe(expected_prompt), "profile_prompt_version_mismatch") if expected_prompt is not None else F.lit(None).cast("string")
    return F.coalesce(
        F.when(~F.col("schema_version").eqNullSafe(RECORD_SCHEMA), "schema_version_mismatch"), prompt, F.when(p["search_text"].isNull(), "missing_search_text"),
        F.when(F.size(p["aliases"]) == 0, "missing_aliases"), F.when(p["project_type"].isNull(), "missing_project_type"), F.when(F.size(p["ecosystem"]) == 0, "missing_ecosystem"),
    )


def refresh_plan(records: DataFrame, force: bool = False, **options) -> DataFrame:
    """(reason, n): how many records a refresh takes, by reason, and how many it skips."""
    reason = F.coalesce(refresh_reason(**options), F.lit("forced") if force else F.lit("skip"))
    return records.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def by_id(records: DataFrame) -> DataFrame:
    """The last record of each non-empty id."""
    some = records.where(F.coalesce("repo_id", F.lit("")) != "")
    return some.groupBy("repo_id").agg(F.max_by(F.struct(*(c for c in records.columns if c != "repo_id")), "pos").alias("r")).select("repo_id", "r.*")


def ordered_merge(existing: DataFrame, requested: DataFrame, completed: DataFrame, id_col: str = "repo_id") -> DataFrame:
    """Ids in the order that existing, requested and completed first name them; the last row of each counts, and ids that are only requested have none."""
    parts = [df.withColumn("src", F.lit(i)) for i, df in enumerate((existing, requested, completed))]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (id_col, "src", "pos")]
    place = F.struct("src", "pos")
    held = F.when(F.col("src") != 1, place)
    out = every.groupBy(id_col).agg(F.min(place).alias("first"), F.max_by(F.struct(*rest), held).alias("r"), F.max(held).alias("last"))
    return out.where("last is not null").select(id_col, "first", "r.*")
