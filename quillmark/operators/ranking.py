"""Ranking: semantic, metadata-aware and reranked search with abstention and explained scores.

Entries have repo_id, pos, vector and a metadata struct; queries have qid,
query and vector (several rows of a qid are variants of one query).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import score, text
from ..schemas import RECORD_SCHEMA
from ..session import settled
from . import index, metadata_search, models, similarity

FUSION = 60
STRATEGIES = ("metadata", "semantic", "rerank")


class IndexMismatch(RuntimeError):
    """The index can't be searched with this model or input version."""


def check_index(meta: DataFrame, model: str, input_version: int, record_schema: int) -> None:
    """Raise unless the one row of meta fits."""
    row = meta.first()
    for name, want in (("embedding_model", model), ("embedding_input_version", input_version), ("record_schema_version", record_schema)):
        if row is None or row[name] is None:
            raise IndexMismatch(f"the index doesn't say its {name}")
        if row[name] != want:
            raise IndexMismatch(f"the index has {name} {row[name]!r}, the search {want!r}")


def check_vectors(entries: DataFrame) -> None:
    bad = entries.where(F.col("vector").isNull()).select("repo_id").limit(5).collect()
    if bad:
        raise ValueError(f"entries without a valid vector: {[r[0] for r in bad]}")


def prepared(entries: DataFrame, *kept: str) -> DataFrame:
    """Entries with what scoring needs of them, made once rather than for each pair; without vectors."""
    m = lambda k: F.col("metadata." + k)
    listed = lambda *ks: F.concat(*(text.strip_list(m(k)) for k in ks))
    some = lambda values: text.expanded_all(F.flatten(F.transform(values, text.tokens)))
    return entries.select(
        "repo_id", "pos", *kept, m("url").alias("url"), m("name").alias("name"), text.strip_list(m("aliases")).alias("aliases"), m("language").alias("language"),
        text.metadata_language(F.coalesce(m("language"), F.lit(""))).alias("language_alias"),
        text.expanded_all(text.tokens(text.metadata_text(m))).alias("text_tokens"), some(listed("topics")).alias("topic_tokens"),
        some(listed("use_cases", "capabilities", "search_phrases")).alias("profile_tokens"),
        F.coalesce(score.popularity(score.number(m("stars"))), F.lit(0.0)).alias("popularity"),
        m("archived").eqNullSafe(True).alias("archived"), m("disabled").eqNullSafe(True).alias("disabled"),
    )


def analysed(queries: DataFrame) -> DataFrame:
    """One row of each qid: query, its keywords with their expansions, and its language."""
    q = queries.groupBy("qid").agg(F.first("query").alias("query"))
    words = F.transform(text.keywords(F.col("query")), lambda k: F.struct(k.alias("word"), text.expanded(k).alias("forms")))
    return q.select("qid", "query", words.alias("words"), text.query_language(text.tokens(F.col("query"))).alias("query_language"))


def identity_pairs(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, repo_id, pos, identity): the entries that queries name.

    Equi-joins of spellings find the candidates; a query's substrings (up to the
    longest id or name) find ids and names inside it.
    """
    e = entries.select("repo_id", "pos", F.col("metadata.name").alias("name"), text.strip_list(F.col("metadata.aliases")).alias("aliases"))
    q = queries.groupBy("qid").agg(F.first("query").alias("query"))
    values = text.identity_values(F.col("repo_id"), F.col("name"), F.col("aliases"))
    keys = e.select("repo_id", "pos", F.explode(text.identity_variants(values)).alias("key"))
    names = F.array_union(F.array(text.lowered(F.col("repo_id"))), F.transform(F.concat(F.array(F.coalesce("name", F.lit(""))), "aliases"), text.lowered))
    inside = e.select("repo_id", "pos", F.explode(F.filter(names, lambda v: v != "")).alias("key"))
    raw = text.lowered(F.col("query"))
    # Only a query with a slash, or one in Chinese or Japanese, can hold an id or name that its spellings don't.
    cjk = text.has_cjk(F.col("query"))
    asked = q.where(cjk | F.contains(raw, F.lit("/"))).join(F.broadcast(inside.agg(F.max(F.length("key")).alias("longest"))))  # one row
    spots = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(raw)))
    ends = lambda i: F.sequence(F.lit(1), F.least("longest", F.greatest(F.lit(1), F.length(raw) - i + 1)))
    subs = F.flatten(F.transform(spots, lambda i: F.transform(ends(i), lambda n: F.substring(raw, i, n))))
    subs = F.filter(subs, lambda s: cjk | F.contains(s, F.lit("/")))
    found = q.select("qid", F.explode(text.query_variants(F.col("query"))).alias("key")).join(keys.hint("merge"), "key").select("qid", "repo_id", "pos")
    within = asked.select("qid", F.explode(F.array_distinct(subs)).alias("key")).join(inside.hint("merge"), "key").select("qid", "repo_id", "pos")
    pairs = found.unionByName(within).distinct().join(q.hint("merge"), "qid").join(e.hint("merge"), ["repo_id", "pos"])
    kind = text.identity_kind(F.col("query"), F.col("repo_id"), F.col("name"), F.col("aliases"))
    return pairs.select("qid", "repo_id", "pos", kind.alias("identity")).where("identity <> 'none'")


def adjusted(pairs: DataFrame, entries: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """pairs (qid, repo_id, pos, semantic, and identity, or pinned where its kind is yet to be told) with score, confidence, matches, diagnostics and reasons."""
    # An entry is prepared once for all queries that it is a candidate of, and not at all without one. Joins are merges: the driver would build broadcasts.
    known = "identity" if "identity" in pairs.columns else "pinned"
    asks = pairs.groupBy("repo_id", "pos").agg(F.collect_list(F.struct("qid", "semantic", known)).alias("asks"))
    wanted = prepared(entries.select("repo_id", "pos", "metadata").join(asks.hint("merge"), ["repo_id", "pos"]), "asks")
    p = wanted.withColumn("ask", F.explode("asks")).select("*", "ask.*").drop("asks", "ask").join(analysed(queries).hint("merge"), "qid")
    if known == "pinned":
        p = p.withColumn("identity", F.when(F.col("pinned"), text.identity_kind(F.col("query"), F.col("repo_id"), F.col("name"), F.col("aliases"))).otherwise("none"))
    hits = lambda column: F.transform(F.filter("words", lambda w: F.arrays_overlap(w["forms"], F.col(column))), lambda w: w["word"])
    p = p.withColumns({"matched_terms": hits("text_tokens"), "topic_matches": hits("topic_tokens"), "profile_matches": hits("profile_tokens")})
    named = F.col("identity") != "none"
    same = F.coalesce(F.col("language_alias") == F.col("query_language"), F.lit(False))
    differs = F.coalesce(F.col("language_alias") != F.col("query_language"), F.lit(False))
    capped = lambda most, column, each: F.least(F.lit(most), F.size(column) * each)
    penalty = score.state_penalty(F.col("archived"), F.col("disabled"))
    adjustment = (
        F.when(named, F.greatest(F.lit(0.25), F.lit(score.HIGH + 0.05) - F.col("semantic"))).otherwise(0.0)
        + F.when(same, 0.03).when(differs, -0.04).otherwise(0.0)
        + capped(0.08, "matched_terms", 0.02) + capped(0.035, "topic_matches", 0.015) + capped(0.045, "profile_matches", 0.015)
        + F.col("popularity") - penalty
    )
    listed = lambda label, column: F.when(F.size(column) > 0, F.concat(F.lit(label), F.array_join(F.slice(column, 1, 5), ", ")))
    state = F.array_compact(F.array(F.when(F.col("archived"), F.lit("archived")), F.when(F.col("disabled"), F.lit("disabled"))))
    why = F.array_compact(
        F.array(
            F.when(named, "matched exact repository identity"),
            F.when(same, F.concat(F.lit("matched language: "), F.col("language"))).when(differs, F.concat(F.lit("language differs: "), F.col("language"))),
            listed("matched metadata terms: ", F.col("matched_terms")), listed("matched topics: ", F.col("topic_matches")), listed("matched profile terms: ", F.col("profile_matches")),
            F.when(F.col("popularity") > 0, "popular repository"), listed("repository state penalty: ", state),
        )
    )
    p = p.withColumn("metadata_score", adjustment).withColumn("score", F.col("semantic") + F.col("metadata_score"))
    confidence = F.when(named, "high_confidence").when(F.col("semantic") < threshold, "abstain").otherwise(score.confidence(F.col("score"), threshold))
    return p.select(
        "qid", "repo_id", "pos", "url", "score", F.col("semantic").alias("semantic_score"), "metadata_score", confidence.alias("confidence"), "matched_terms",
        F.struct(
            F.when(named, "exact").alias("identity_match"), F.col("identity").alias("identity_kind"), F.when(same, F.col("language")).alias("language_match"),
            F.when(differs, F.col("language")).alias("language_mismatch"), "topic_matches", "profile_matches", state.alias("repository_state"), F.round("popularity", 6).alias("popularity_bonus"),
        ).alias("diagnostics"),
        F.when(F.size(why) == 0, F.array(F.lit("ranked by semantic similarity"))).otherwise(why).alias("why"), named.alias("pinned"),
    )


def presented(rows: DataFrame, top_k: int, *order: Column) -> DataFrame:
    """Rows that don't abstain, the top_k of each query, as rk."""
    if top_k <= 0:
        return rows.where("false").withColumn("rk", F.lit(0))
    window = Window.partitionBy("qid").orderBy(*order)
    return rows.where("confidence <> 'abstain'").withColumn("rk", F.row_number().over(window)).where(F.col("rk") <= top_k)


BEST = (F.desc, "pinned"), (F.desc, "score"), (F.desc, "semantic_score"), (F.desc, "repo_id"), (F.asc, "pos")


def best_order() -> list[Column]:
    """Pinned first, then by score, semantic score and id, all descending; then in the order of the index."""
    return [f(c) for f, c in BEST]


def search_metadata(entries: DataFrame, queries: DataFrame, top_k: int = 10, threshold: float = score.EXPLORATORY) -> DataFrame:
    asked = settled(analysed(queries), "asked")
    questions = asked.join(metadata_search.query_marks(entries, asked.select("qid", "query")).hint("merge"), "qid")
    m = lambda k: F.col("metadata." + k)
    marks = F.concat(*metadata_search.entry_marks(F.col("repo_id"), m("name"), text.strip_list(m("aliases"))))
    scored = prepared(entries.withColumn("marks", marks), "vector", "marks").select(
        "repo_id", "pos", "vector", "marks", "language_alias", "text_tokens", "topic_tokens", "profile_tokens", "popularity", score.state_penalty(F.col("archived"), F.col("disabled")).alias("penalty"),
    )
    rows = metadata_search.best_by_metadata(scored, questions, queries, max(1, top_k), threshold)
    rows = adjusted(rows, entries, asked, threshold)
    return presented(rows, top_k, *best_order()).drop("pinned")


def search_semantic(entries: DataFrame, queries: DataFrame, top_k: int = 10, threshold: float = score.EXPLORATORY) -> DataFrame:
    """(qid, rk, repo_id, score, confidence): by descending score and id."""
    near = similarity.scored_pairs(entries, queries, max(1, top_k), threshold)
    rows = near.select("qid", "repo_id", "pos", F.col("semantic").alias("score"), score.confidence(F.col("semantic"), threshold).alias("confidence"))
    return presented(rows, top_k, F.desc("score"), F.desc("repo_id"), F.asc("pos"))


def rerank_candidates(entries: DataFrame, queries: DataFrame, limit: int = 50, named: DataFrame | None = None) -> DataFrame:
    """(qid, repo_id, pos, semantic, semantic_rank): the entries that a reranker is asked about, those that a query names left out."""
    named = identity_pairs(entries, queries) if named is None else named
    near = similarity.scored_pairs(entries, queries, limit, without=named.select("qid", "repo_id"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("semantic"), "pos"))
    return near.withColumn("semantic_rank", rank).where(F.col("semantic_rank") <= limit)


def fused(
    entries: DataFrame, queries: DataFrame, rerank_scores: DataFrame, candidate_limit: int = 50, threshold: float = score.EXPLORATORY,
    named: DataFrame | None = None, candidates: DataFrame | None = None,
) -> DataFrame:
    """Candidates by semantic score, fused with rerank_scores (qid, repo_id, rerank_score) by reciprocal ranks; identities pinned."""
    if candidate_limit < 1:
        raise ValueError("the candidate limit is 1 at least")
    named = settled(identity_pairs(entries, queries), "named") if named is None else named
    near = rerank_candidates(entries, queries, candidate_limit, named) if candidates is None else candidates
    by = Window.partitionBy("qid")
    near = near.join(rerank_scores.hint("merge"), ["qid", "repo_id"]).withColumn("rerank_rank", F.row_number().over(by.orderBy(F.desc("rerank_score"), "semantic_rank")))
    rows = near.select(
        "qid", "repo_id", "pos", (1.0 / (FUSION + F.col("semantic_rank")) + 1.0 / (FUSION + F.col("rerank_rank"))).alias("score"), F.col("semantic").alias("semantic_score"),
        score.confidence(F.col("semantic"), threshold).alias("confidence"), F.lit("none").alias("identity"), "rerank_score", "semantic_rank", "rerank_rank", F.lit(False).alias("pinned"),
    )
    pinned = similarity.semantic_of(named.select("qid", "repo_id", "pos"), entries, queries).join(named.hint("merge"), ["qid", "repo_id", "pos"])
    pinned = adjusted(pinned, entries, queries, threshold).select("qid", "repo_id", "pos", "score", "semantic_score", "confidence", F.col("diagnostics.identity_kind").alias("identity"), "pinned")
    return rows.unionByName(pinned, allowMissingColumns=True)


def calibrated(hits: DataFrame, mode: str = "off") -> DataFrame:
    """Reranked hits with their evidence; mode evidence-v1 lowers high confidence that the evidence doesn't bear out."""
    if mode not in ("off", "evidence-v1"):
        raise ValueError(f"unknown confidence calibration: {mode}")
    by = Window.partitionBy("qid").orderBy("rk")
    margin = F.when(F.col("rk") == 1, F.col("score") - F.lead("score").over(by))
    none = F.col("identity") == "none"
    available = F.col("rerank_score").isNotNull() & F.col("semantic_rank").isNotNull() & F.col("rerank_rank").isNotNull()
    agree = F.col("semantic_rank") == F.col("rerank_rank")
    down = F.array_compact(
        F.array(
            F.when(F.col("identity") == "contextual_name_mention", "identity_is_contextual"),
            F.when(margin <= 0, "top_candidate_not_separated"),
            F.when(none & ~available, "reranker_evidence_unavailable").when(none & ~agree, "semantic_and_rerank_disagree").when(none & (F.col("semantic_rank") != 1), "top_result_is_not_leading_in_both_rankers"),
        )
    )
    up = F.array_compact(
        F.array(F.when(F.col("identity").isin("repo_id", "exact_value", "name_mention"), "direct_identity"), F.when(none & available & agree & (F.col("semantic_rank") == 1), "semantic_and_rerank_agree"))
    )
    lower = F.lit(mode == "evidence-v1") & (F.col("confidence") == "high_confidence") & (F.size(down) > 0)
    return hits.select(
        "*", F.col("confidence").alias("initial_confidence"), F.round(margin, 8).alias("top_score_margin"), up.alias("supporting_signals"), down.alias("downgrade_reasons")
    ).withColumn("confidence", F.when(lower, "exploratory").otherwise(F.col("confidence")))


def search_rerank(
    entries: DataFrame, queries: DataFrame, rerank_scores: DataFrame, top_k: int = 10, threshold: float = score.EXPLORATORY, candidate_limit: int = 50,
    abstain_threshold: float | None = None, calibration: str = "off", named: DataFrame | None = None, candidates: DataFrame | None = None,
) -> DataFrame:
    """named and candidates are identity_pairs() and rerank_candidates(), where they are made already."""
    rows = fused(entries, queries, rerank_scores, candidate_limit, threshold, named, candidates)
    if abstain_threshold is not None:
        by = Window.partitionBy("qid")
        first = F.first("rerank_score").over(by.orderBy(*best_order()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        quiet = ~F.max("pinned").over(by) & F.coalesce(first <= abstain_threshold, F.lit(False))
        rows = rows.withColumn("quiet", quiet).where("not quiet").drop("quiet")
    return calibrated(presented(rows, top_k, *best_order()), calibration)


def search(
    entries: DataFrame, queries: DataFrame, strategy: str = "metadata", top_k: int = 10, threshold: float = score.EXPLORATORY, rerank_scores: DataFrame | None = None, **options,
) -> DataFrame:
    """The hits of queries; see answers() for queries that got none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown ranking strategy: {strategy}")
    score.confidence(F.lit(0.0), threshold)
    if strategy == "rerank":
        if rerank_scores is None:
            raise ValueError("the rerank strategy needs rerank scores")
        return search_rerank(entries, queries, rerank_scores, top_k, threshold, **options)
    return (search_metadata if strategy == "metadata" else search_semantic)(entries, queries, top_k, threshold)


def search_text(
    entries: DataFrame, meta: DataFrame, queries: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, strategy: str = "metadata", top_k: int = 10,
    threshold: float = score.EXPLORATORY, rerank: Callable[[str, list[str]], list[float]] | None = None, candidate_limit: int = 50, **options,
) -> DataFrame:
    """The answers to queries (qid, query[, variants][, rerank_query]), from texts to hits in one call; see answers().

    variants are the texts whose best score counts, as models.canonicalised makes
    them (the query itself by default); rerank_query is what the reranker reads. The
    index must fit the model, and its vectors its dimension. Each distinct text is
    embedded once, into a written table.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown ranking strategy: {strategy}")
    if strategy == "rerank" and rerank is None:
        raise ValueError("the rerank strategy needs a reranker")
    check_index(meta, model, text.EMBEDDING_INPUT_VERSION, RECORD_SCHEMA)
    dimension = meta.first()["dimension"]
    check_vectors(entries if dimension is None else entries.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector"))))
    own = F.array("query")
    rows = queries.select("qid", "query", (F.coalesce("variants", own) if "variants" in queries.columns else own).alias("variants"), (F.coalesce("rerank_query", "query") if "rerank_query" in queries.columns else F.col("query")).alias("rerank_query"))
    texts = settled(rows.select("qid", "query", F.explode(F.array_distinct("variants")).alias("input")), "variants")
    blank = texts.where(text.stripped(F.col("input")).isNull()).select("qid").union(rows.where(F.size("variants") <= 0).select("qid")).first()
    if blank is not None:
        raise ValueError(f"query {blank[0]} has an empty text")
    vectors = settled(index.embedded(texts.select("input").distinct(), embed, dimension), "query-vectors")
    asked = texts.join(vectors, "input").select("qid", "query", "vector")
    if not vectors.where(~F.exists("vector", lambda x: x != 0)).isEmpty():
        raise ValueError("the model gave a query a zero vector")
    scores = None
    if strategy == "rerank":
        document = text.rerank_text(F.col("repo_id"), lambda k: F.col(f"metadata.{k}")).alias("document")
        pairs = rerank_candidates(entries, asked, candidate_limit).join(entries.select("repo_id", "pos", document), ["repo_id", "pos"])
        pairs = pairs.join(rows.select("qid", F.col("rerank_query").alias("query")), "qid").select("qid", "query", "repo_id", "semantic_rank", "document")
        scores = settled(models.reranked(pairs, rerank), "rerank-scores")
        options = options | {"candidate_limit": candidate_limit}
    hits = search(entries, asked, strategy, top_k, threshold, scores, **options)
    return answers(rows, hits).withColumn("considered", F.lit(entries.count()))


def answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row of each query: its hits in order, and whether it abstained."""
    q = queries.groupBy("qid").agg(F.first("query").alias("query"))
    columns = [c for c in hits.columns if c != "qid"]
    got = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", *(c for c in columns if c != "rk")))).alias("hits"))
    return q.join(got, "qid", "left").select("qid", "query", text.intent(F.col("query")).alias("intent"), "hits", F.col("hits").isNull().alias("abstained"))
