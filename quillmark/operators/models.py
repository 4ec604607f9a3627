"""External models as table operators: clients are injected and made in each worker; errors become columns."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import JUDGE_PROMPT, PROFILE_PROMPT
from ..session import settled
from .records import KEPT_FIELDS, LIST_FIELDS, TEXT_FIELDS

VERDICT = "struct<verdict:string,difference_size:string,query_specificity:string,language_ecosystem_material:boolean,reason_short:string,expected_advantages:array<string>,top1_advantages:array<string>,confidence:string>"
# What a judge may answer, the stand-in for anything else first.
ANSWERS = {
    "verdict": ["insufficient_evidence", "acceptable_substitute", "serious_mismatch"],
    "difference_size": ["moderate", "small", "large"],
    "query_specificity": ["underspecified", "specific", "ambiguous"],
    "confidence": ["low", "medium", "high"],
}


class ModelError(RuntimeError):
    pass


def vectors_of(answer, count: int) -> list[list[float]]:
    """The vectors of an embedding answer in the order of the inputs, of either protocol."""
    if isinstance(answer, dict) and isinstance(answer.get("data"), list):
        by = {x.get("index"): x.get("embedding") for x in answer["data"] if isinstance(x, dict)}
        out = [by.get(i) for i in range(count)] if len(answer["data"]) == count else []
    else:
        out = answer if isinstance(answer, list) and len(answer) == count else []
    if len(out) != count or not all(isinstance(v, list) for v in out):
        raise ModelError(f"no {count} vectors in the answer")
    return out


def scores_of(answer, count: int) -> list[float]:
    """The scores of a reranker's answer in the order of the documents; indexes must be a permutation."""
    items, field = (answer.get("rankings"), "logit") if isinstance(answer, dict) else (answer, "score")
    if not isinstance(items, list) or len(items) != count:
        raise ModelError(f"no {count} scores in the answer")
    out: dict[int, float] = {}
    for x in items:
        i, v = (x.get("index"), x.get(field)) if isinstance(x, dict) else (None, None)
        if isinstance(i, bool) or not isinstance(i, int) or not 0 <= i < count or i in out or isinstance(v, bool) or not isinstance(v, (int, float)):
            raise ModelError(f"a score of the answer doesn't fit: {x!r}")
        out[i] = float(v)
    return [out[i] for i in range(count)]


def queries_of(answer: str, count: int) -> list[str]:
    """The rewritten queries of a chat answer: one JSON object, text before it allowed, none after."""
    at = answer.find("{")
    try:
        data, end = json.JSONDecoder().raw_decode(answer, max(at, 0))
    except json.JSONDecodeError as e:
        raise ModelError(f"no JSON object in the answer: {e}") from e
    found = data.get("queries") if isinstance(data, dict) else None
    if answer[end:].strip() or not isinstance(found, list) or len(found) != count or not all(isinstance(q, str) and q.strip() for q in found):
        raise ModelError(f"not one object with {count} queries")
    return [q.strip() for q in found]


def reranked(pairs: DataFrame, rerank: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """(qid, repo_id, rerank_score) of pairs (qid, query, repo_id, document); a call for each query's bounded candidates."""
    kind = pairs.schema["qid"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scores = rerank(pdf["query"].iloc[0], pdf["document"].tolist())
        if len(scores) != len(pdf):
            raise ModelError(f"{len(scores)} scores for {len(pdf)} documents")
        return pdf[["qid", "repo_id"]].assign(rerank_score=np.asarray(scores, float))

    return pairs.groupBy("qid").applyInPandas(run, f"qid {kind}, repo_id string, rerank_score double")


def halved(items: list, call: Callable[[list], list]) -> list[tuple]:
    """(answer, error) of each item: a call that fails, or answers another number, is made for its halves, down to single items."""
    if not items:
        return []
    try:
        got = call(items)
        if len(got) != len(items):
            raise ModelError(f"{len(got)} answers for {len(items)}")
        return [(a, None) for a in got]
    except Exception as e:  # the client's error is the row's outcome
        if len(items) == 1:
            return [(None, str(e) or type(e).__name__)]
    half = len(items) // 2
    return halved(items[:half], call) + halved(items[half:], call)


def _replies(prompts: Iterator[pd.Series], call: Callable[[list[str]], list[str]], batch: int) -> Iterator[pd.DataFrame]:
    for part in prompts:
        due = part.dropna()
        answers = [a for i in range(0, len(due), batch) for a in halved(due.iloc[i : i + batch].tolist(), call)]
        yield pd.DataFrame(answers, columns=["answer", "error"], index=due.index, dtype=object).reindex(part.index).replace({np.nan: None})


def asked(rows: DataFrame, prompt: str, chat: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """rows with `answer` and `error` of a chat client, called with batches of the prompts that aren't null; an error is one row's alone."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _replies(batches, chat, batch)

    call = F.pandas_udf(run, "answer string, error string").asNondeterministic()  # a model is asked once for a row
    return rows.withColumn("reply", call(F.col(prompt))).select("*", "reply.answer", "reply.error").drop("reply")


MODES = ("off", "canonical", "merge")


def canonicalised(queries: DataFrame, chat: Callable[[list[str]], list[str]], mode: str = "merge", batch: int = 16) -> DataFrame:
    """queries (qid, query, ...) with canonical, canonical_error and variants, the texts that a search embeds.

    Each distinct query is rewritten once, in batches of one prompt; an answer with
    another number of queries, or none, is asked for again by halves. variants are
    the query (off), the rewritten one (canonical) or both (merge), each once; a query
    without a rewritten one stands for itself.
    """
    if mode not in MODES:
        raise ValueError(f"unknown query transform mode: {mode}")
    if mode == "off":
        none = F.lit(None).cast("string")
        return queries.withColumns({"canonical": none, "canonical_error": none, "variants": F.array("query")})

    def rewritten(texts: list[str]) -> list[str]:
        return queries_of(chat([json.dumps({"queries": texts}, ensure_ascii=False)])[0], len(texts))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _replies(batches, rewritten, batch)

    call = F.pandas_udf(run, "answer string, error string").asNondeterministic()
    found = queries.where("query is not null").select("query").distinct().withColumn("reply", call(F.col("query")))
    made = settled(found.select("query", F.col("reply.answer").alias("canonical"), F.col("reply.error").alias("canonical_error")), "canonical")
    both = F.array("query", "canonical") if mode == "merge" else F.array("canonical")
    own = F.col("canonical").isNull() | (F.col("canonical") == F.col("query"))
    return queries.join(made, "query", "left").withColumn("variants", F.when(own, F.array("query")).otherwise(both)).select(*queries.columns, "canonical", "canonical_error", "variants")


def profile_input() -> Column:
    """The evidence of a record that a model may use, as JSON."""
    none = F.array().cast("array<string>")
    return F.to_json(
        F.struct(
            "repo_id", "url", F.col("github.description").alias("github_description"), F.coalesce("github.topics", none).alias("github_topics"), F.col("github.language").alias("primary_language"),
            text.stripped(F.col("readme").cast("string")).alias("readme_excerpt"), F.coalesce("structure.signals", none).alias("structure_signals"), F.coalesce("evidence_gaps", none).alias("evidence_gaps"),
        ),
        {"ignoreNullFields": "false"},
    )


def evidence_kinds(evidence: Column) -> Column:
    return F.filter(F.transform(evidence, lambda e: e["kind"]), lambda k: F.coalesce(k, F.lit("")) != "")


def parsed_profile(content: Column) -> Column:
    """A clean profile struct of a model's answer, null where it is no JSON object."""
    raw = text.fenced_json(content)
    schema = ", ".join([f"{k} STRING" for k in (*TEXT_FIELDS, "confidence")] + [f"{k} ARRAY<STRING>" for k in LIST_FIELDS] + ["abstained BOOLEAN"] + [f"{k} STRING" for k in KEPT_FIELDS])
    data = F.from_json(raw, schema)
    confidence = F.lower(data["confidence"])
    out = F.struct(
        *(text.stripped(data[k]).alias(k) for k in TEXT_FIELDS), *(text.clean_list(data[k]).alias(k) for k in LIST_FIELDS),
        F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("low").alias("confidence"), F.coalesce(data["abstained"], F.lit(False)).alias("abstained"),
    )
    return F.when(raw.startswith("{") & F.try_parse_json(raw).isNotNull(), out)


def parsed_verdict(content: Column) -> Column:
    """A judge's verdict with every answer one that it may give; null where it is no JSON object."""
    raw = text.fenced_json(content)
    data = F.from_json(raw, VERDICT)
    clamp = lambda k: F.when(F.lower(F.trim(data[k])).isin(ANSWERS[k]), F.lower(F.trim(data[k]))).otherwise(ANSWERS[k][0]).alias(k)
    out = F.struct(
        clamp("verdict"), clamp("difference_size"), clamp("query_specificity"), F.coalesce(data["language_ecosystem_material"], F.lit(False)).alias("language_ecosystem_material"),
        text.stripped(data["reason_short"]).alias("reason_short"), text.strip_list(data["expected_advantages"]).alias("expected_advantages"), text.strip_list(data["top1_advantages"]).alias("top1_advantages"), clamp("confidence"),
    )
    return F.when(raw.startswith("{") & F.try_parse_json(raw).isNotNull(), out)


def refreshed(records: DataFrame, chat: Callable[[list[str]], list[str]], model: str, now: Column, reason: Column, system: str = "") -> DataFrame:
    """All records, those whose refresh reason isn't null with new profiles; a failure keeps the old one and says why in `refresh_error`."""
    due = records.where(reason.isNotNull()).withColumn("prompt", profile_input())
    rows = asked(due, "prompt", chat, 16).unionByName(records.where(reason.isNull()), allowMissingColumns=True)
    new = parsed_profile(F.col("answer"))
    made = F.struct(*(new[k].alias(k) for k in (*TEXT_FIELDS, *LIST_FIELDS, "confidence", "abstained")), F.lit("openai_compatible").alias("provider"), F.lit(model).alias("model"), now.alias("generated_at"), F.lit(PROFILE_PROMPT).alias("prompt_version"), F.lit(text.prompt_hash(PROFILE_PROMPT, system)).alias("prompt_hash"))
    failed = F.col("prompt").isNotNull() & new.isNull()
    return rows.withColumns({"new_profile": F.when(F.col("prompt").isNotNull() & new.isNotNull(), made), "refresh_error": F.when(failed, F.coalesce("error", F.lit("the answer was no JSON object")))}).drop("prompt", "answer", "error")


def judge_inputs(results: DataFrame, records: DataFrame) -> DataFrame:
    """(id, prompt) of the cases whose top hit is neither expected nor acceptable: both records as evidence.

    A case whose expected or top record isn't among the records is an error
    when its prompt is used.
    """
    evidence = records.groupBy("repo_id").agg(F.max_by(profile_input(), "pos").alias("evidence"))
    side = lambda c: evidence.select(F.col("repo_id").alias(c), F.col("evidence").alias(c + "_evidence"))
    due = results.where("not exact_match and not acceptable_match and top_repo_id is not null").select("id", "query", "expected_repo_id", "top_repo_id")
    rows = due.join(side("expected_repo_id"), "expected_repo_id", "left").join(side("top_repo_id"), "top_repo_id", "left")
    known = lambda c: F.when(F.col(c + "_evidence").isNull(), F.raise_error(F.concat(F.lit("no record of "), c)).cast("string")).otherwise(F.col(c + "_evidence"))
    prompt = F.concat(F.lit('{"query": '), text.json_string(F.col("query")), F.lit(', "expected_repo": '), known("expected_repo_id"), F.lit(', "top1_repo": '), known("top_repo_id"), F.lit("}"))
    return rows.select("id", prompt.alias("prompt"))


def judged(results: DataFrame, records: DataFrame, chat: Callable[[list[str]], list[str]], system: str = "") -> DataFrame:
    """(id, verdict, difference_size, ..., judge_error, prompt_version, prompt_hash) of the misses: a judge's verdicts for case_results."""
    rows = asked(judge_inputs(results, records), "prompt", chat)
    verdict = parsed_verdict(F.col("answer"))
    failed = F.when(verdict.isNull(), F.coalesce("error", F.lit("the answer was no JSON object")))
    return rows.select("id", verdict.alias("v"), failed.alias("judge_error")).select("id", "v.*", "judge_error", F.lit(JUDGE_PROMPT).alias("prompt_version"), F.lit(text.prompt_hash(JUDGE_PROMPT, system)).alias("prompt_hash"))


def hash_embedding(texts: list[str], dimension: int = 64) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: hashed tokens, unit length."""
    out = []
    for t in texts:
        v = np.zeros(dimension)
        for token in re.findall(text.TOKEN, t.lower()):
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            v[h % dimension] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(float(v @ v))
        out.append((v / n if n else v).tolist())
    return out


def overlap_rerank(query: str, documents: list[str]) -> list[float]:
    """A deterministic stand-in for a reranker: the share of the query's tokens in each document."""
    want = set(re.findall(text.TOKEN, query.lower()))
    return [len(want & set(re.findall(text.TOKEN, d.lower()))) / max(1, len(want)) for d in documents]
