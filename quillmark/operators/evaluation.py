"""Retrieval evaluation: datasets, case results, metrics, summaries, misses and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score, text

# The gate's default thresholds.
GATE = {"exact_top1_rate": (">=", 0.88), "effective_top1_rate": (">=", 1.0), "serious_top1_error_rate": ("<=", 0.0)}


class DatasetError(ValueError):
    pass


def members(families: DataFrame) -> DataFrame:
    """(family, repo_id): a row of each member, from a dataset's (family, repo_ids)."""
    return families.select("family", F.explode("repo_ids").alias("repo_id")).distinct()


def acceptable(cases: DataFrame, members: DataFrame) -> DataFrame:
    """cases with acceptable_set: the expected id, the acceptable ones and their families' members, sorted.

    For display: a set is as long as its families. Results need no sets.
    """
    more = cases.select("id", F.explode("acceptable_families").alias("family")).join(members, "family").groupBy("id").agg(F.collect_set("repo_id").alias("more"))
    own = F.concat(F.array("expected_repo_id"), F.coalesce("acceptable_repo_ids", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))
    return cases.join(more, "id", "left").withColumn("acceptable_set", F.array_sort(F.array_distinct(own))).drop("more")


def violations(cases: DataFrame, families: DataFrame) -> DataFrame:
    """(id, problem) of a dataset's cases: blank fields, repeated ids, unknown families."""
    blank = lambda c: text.stripped(F.col(c)).isNull()
    own = cases.select("id", F.explode(F.array_compact(F.array(*(F.when(blank(c), F.lit(f"blank {c}")) for c in ("id", "query", "expected_repo_id"))))).alias("problem"))
    twice = cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    named = cases.select("id", F.explode("acceptable_families").alias("family")).join(families, "family", "left_anti")
    return own.unionByName(twice).unionByName(named.select("id", F.concat(F.lit("unknown family "), "family").alias("problem")))


def check_dataset(cases: DataFrame, families: DataFrame) -> None:
    bad = violations(cases, families).limit(5).collect()
    if bad or cases.isEmpty():
        raise DatasetError("; ".join(f"{r['id']}: {r['problem']}" for r in bad) or "no cases")


def case_results(cases: DataFrame, hits: DataFrame, members: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row of each case: its top hit, ranks of expected and acceptable ids, and status.

    hits is (qid = case id, rk, repo_id, confidence); members (family, repo_id) are
    looked up for the hits alone, by both, so that neither a large family nor one that
    many cases name is a task's or a row's. verdicts (id, verdict) are a judge's on
    top hits outside the acceptable ones. A case without a hit is a serious mismatch,
    abstained or not.
    """
    asked = cases.select(F.col("id").alias("qid"), "expected_repo_id", "acceptable_repo_ids", "acceptable_families")
    expected = F.col("repo_id") == F.col("expected_repo_id")
    own = F.coalesce(expected | F.coalesce(F.array_contains("acceptable_repo_ids", F.col("repo_id")), F.lit(False)), F.lit(False))
    h = hits.select("qid", "rk", "repo_id", "confidence").join(asked, "qid").withColumn("own", own).withColumn("family", F.explode_outer(F.when(~F.col("own"), F.col("acceptable_families"))))
    h = h.join(members.select("family", "repo_id", F.lit(True).alias("member")), ["family", "repo_id"], "left")
    taken, first = F.col("own") | F.coalesce("member", F.lit(False)), F.col("rk") == 1
    # A hit has a row for each family of its case, and these aggregates are the same for repeated rows.
    found = h.groupBy(F.col("qid").alias("id")).agg(
        F.max(F.when(first, F.col("repo_id"))).alias("top_repo_id"), F.max(F.when(first, F.col("confidence"))).alias("top_confidence"),
        F.min(F.when(expected, F.col("rk"))).alias("exact_rank"), F.min(F.when(taken, F.col("rk"))).alias("acceptable_rank"),
    )
    out = cases.join(found, "id", "left")
    out = out.join(verdicts, "id", "left") if verdicts is not None else out.withColumn("verdict", F.lit(None).cast("string"))
    exact = F.coalesce(F.col("top_repo_id") == F.col("expected_repo_id"), F.lit(False))
    fine = F.coalesce(F.col("acceptable_rank") == 1, F.lit(False))
    status = (
        F.when(exact, "exact").when(fine | F.coalesce(F.col("verdict") == "acceptable_substitute", F.lit(False)), "acceptable")
        .when(F.coalesce(F.col("verdict") == "insufficient_evidence", F.lit(False)), "insufficient_evidence").otherwise("serious_mismatch")
    )
    return out.withColumns({"exact_match": exact, "acceptable_match": fine, "abstained": F.col("top_repo_id").isNull(), "top1_status": status})


def metrics(results: DataFrame) -> DataFrame:
    """One row of rates over all cases, to 6 places, and counts of confidence."""
    n = F.count("*")
    share = lambda c: score.ratio(F.count_if(c), n)
    exact, fine = F.col("exact_match"), F.col("acceptable_match")
    mrr = lambda c: F.sum(F.coalesce(1.0 / F.col(c), F.lit(0.0)))
    high = F.coalesce(F.col("top_confidence") == "high_confidence", F.lit(False))
    maybe = F.coalesce(F.col("top_confidence") == "exploratory", F.lit(False))
    status = F.col("top1_status")
    ranked = lambda c: F.col(c).isNotNull()
    return results.agg(
        n.alias("case_count"), share(exact).alias("exact_hit_at_1"), share(ranked("exact_rank")).alias("exact_hit_at_k"), score.ratio(mrr("exact_rank"), n).alias("mrr_exact"),
        share(fine).alias("acceptable_hit_at_1"), share(ranked("acceptable_rank")).alias("acceptable_hit_at_k"), share(fine).alias("recall_at_1"),
        share(F.col("acceptable_rank") <= 5).alias("recall_at_5"), score.ratio(mrr("acceptable_rank"), n).alias("mrr_acceptable"), share(F.col("abstained")).alias("abstain_rate"),
        score.ratio(F.count_if(fine) - F.count_if(exact), n).alias("acceptable_minus_exact_hit_at_1"),
        score.ratio(F.count_if(ranked("acceptable_rank")) - F.count_if(ranked("exact_rank")), n).alias("acceptable_minus_exact_hit_at_k"),
        score.ratio(mrr("acceptable_rank") - mrr("exact_rank"), n).alias("mrr_acceptable_minus_exact"), share(exact).alias("exact_top1_rate"),
        share(status == "acceptable").alias("acceptable_top1_rate"), share(status == "serious_mismatch").alias("serious_top1_error_rate"),
        share(status == "insufficient_evidence").alias("insufficient_evidence_top1_rate"), share(status.isin("exact", "acceptable")).alias("effective_top1_rate"),
        F.count_if(high).alias("top_1_high_confidence_count"), F.count_if(maybe).alias("top_1_exploratory_count"), F.count_if(~high & ~maybe).alias("top_1_missing_count"),
        F.count_if(high & ~fine).alias("wrong_high_confidence_top_1_count"),
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("top1_status").agg(F.count("*").alias("n"))


def judge_counts(verdicts: DataFrame) -> DataFrame:
    """(kind, name, n) of a judge's verdicts and sizes of difference."""
    kinds = verdicts.select(F.explode(F.array(F.struct(F.lit("verdict").alias("kind"), F.col("verdict").alias("name")), F.struct(F.lit("difference_size").alias("kind"), F.col("difference_size").alias("name")))).alias("k"))
    return kinds.groupBy("k.kind", "k.name").agg(F.count("*").alias("n"))


def summary(results: DataFrame) -> DataFrame:
    """(name, count, rate) of the ten figures of a report's summary."""
    m = results.agg(
        F.count("*").alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in {
            "exact_top_1": F.col("top1_status") == "exact", "recall_at_1": F.col("acceptable_rank") == 1, "recall_at_5": F.col("acceptable_rank") <= 5,
            "acceptable_top_1": F.col("top1_status").isin("exact", "acceptable"), "acceptable_substitute_top_1": F.col("top1_status") == "acceptable",
            "effective_top_1": F.col("top1_status").isin("exact", "acceptable"), "serious_mismatch": F.col("top1_status") == "serious_mismatch",
            "insufficient_evidence": F.col("top1_status") == "insufficient_evidence", "abstain": F.col("abstained"),
            "wrong_high_confidence": (F.col("top_confidence") == "high_confidence") & ~F.col("acceptable_match"),
        }.items())
    )
    return m.unpivot("n", [c for c in m.columns if c != "n"], "name", "count").select("name", "count", score.ratio(F.col("count"), F.col("n")).alias("rate"))


def top_misses(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Cases that aren't exact, the most telling first, as place."""
    order = [
        F.coalesce(F.array_position(F.array(*map(F.lit, ["serious_mismatch", "insufficient_evidence", "acceptable"])), F.col("top1_status")), F.lit(99)),
        F.coalesce(F.col("top_confidence") != "high_confidence", F.lit(True)), F.col("acceptable_rank").isNull(), F.coalesce("acceptable_rank", F.lit(9999)), F.col("id"),
    ]
    rows = results.where("top1_status <> 'exact'").orderBy(*order)
    return rows if limit is None else rows.limit(max(0, limit))


def inspected(results: DataFrame, status: str | None = None, tag: str | None = None, intent: str | None = None, include_exact: bool = False) -> DataFrame:
    rows = results if include_exact else results.where("top1_status <> 'exact'")
    rows = rows.where(F.col("top1_status") == status) if status else rows
    rows = rows.where(F.array_contains("tags", tag)) if tag else rows
    return rows.where(text.intent_type(F.col("query")) == intent) if intent else rows


def selected_cases(cases: DataFrame, tag: str | None = None, intent: str | None = None, limit: int | None = None) -> DataFrame:
    """Cases with their query_intent, of a tag and an intent, the first ones in the dataset's order."""
    rows = cases.withColumn("query_intent", text.intent_type(F.col("query")))
    rows = rows.where(F.array_contains("tags", tag)) if tag else rows
    rows = rows.where(F.col("query_intent") == intent) if intent else rows
    return rows if limit is None else rows.orderBy("pos").limit(max(0, limit))


def case_histogram(cases: DataFrame, limit: int = 20) -> DataFrame:
    """(section, name, n): the most common tags, and all intents."""
    from .records import most_common

    tags = most_common(cases.select(F.posexplode("tags").alias("i", "tag"), "pos").select("tag", F.struct("pos", "i").alias("place")), "tag", "place", limit)
    intents = cases.groupBy(text.intent_type(F.col("query")).alias("name")).agg(F.count("*").alias("n"))
    return tags.select(F.lit("tag").alias("section"), F.col("tag").alias("name"), F.col("count").alias("n")).unionByName(intents.select(F.lit("intent").alias("section"), "name", "n"))


def gate(metrics_row: DataFrame, limits: dict = GATE) -> DataFrame:
    """(metric, actual, operator, threshold, ok) of each check; older reports' names stand in where one is missing."""
    older = {"exact_top1_rate": "exact_hit_at_1", "effective_top1_rate": "acceptable_hit_at_1"}
    names = {m: (m if m in metrics_row.columns else older.get(m, m)) for m in limits}
    missing = [m for m, n in names.items() if n not in metrics_row.columns]
    if missing:
        raise ValueError(f"the report lacks {', '.join(missing)}")
    checks = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("actual"), F.lit(limits[m][0]).alias("operator"), F.lit(float(limits[m][1])).alias("threshold")) for m, n in names.items()))
    out = metrics_row.select(F.explode(checks).alias("c")).select("c.*")
    return out.withColumn("ok", F.when(F.col("operator") == ">=", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold")))
