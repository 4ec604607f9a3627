"""The test tables as catalogue tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# Project types and languages that the adapters deal out.
TYPES = ["library", "tool", "framework", "service", "runtime"]
LANGUAGES = ["Python", "Rust", "JavaScript", "Go", "C++"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(values: list[str], by) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as records, with the faults that validation is to find."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    i, every = F.col("doc_id"), lambda n, r: F.col("doc_id") % n == r
    none = F.array().cast("array<string>")
    repo = F.when(every(97, 13), None).when(every(101, 7), "src0/doc-0").otherwise(F.concat("source", F.lit("/doc-"), i.cast("string")))
    name = F.concat(F.lit("doc-"), i.cast("string"))
    profile = F.struct(
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("about "), "lang", F.lit(" "), name)).alias("summary"), F.array(F.concat(F.lit("reading "), "lang")).alias("use_cases"), none.alias("capabilities"), none.alias("not_for"),
        F.when(every(7, 0), none).otherwise(F.array(name)).alias("aliases"), F.when(~every(11, 0), _one_of(TYPES, i)).alias("project_type"), F.when(every(13, 1), none).otherwise(F.array("lang", "lang")).alias("ecosystem"),
        none.alias("replaces"), none.alias("related_projects"), F.when(~every(17, 2), F.col("text")).alias("search_text"), none.alias("search_phrases"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("Medium").alias("confidence"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("abstained"),
        F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("generated_at"), F.when(every(10, 1), 1).otherwise(2).alias("prompt_version"), F.lit(None).cast("string").alias("prompt_hash"),
    )
    return d.select(
        i.alias("pos"), F.when(every(50, 0), 1).otherwise(2).alias("schema_version"), F.lit(None).cast("string").alias("repo_id_requested"), repo.alias("repo_id"), name.alias("name"),
        F.when(~every(89, 3), F.concat(F.lit("https://example.org/"), "source", F.lit("/"), i.cast("string"))).alias("url"),
        F.struct(F.concat(F.lit("a text in "), "lang").alias("description"), F.array("source", "lang").alias("topics"), F.col("n_chars").alias("stars"), F.lit(0).cast("long").alias("forks"), F.col("lang").alias("language"), (F.col("toxic") == 1).alias("archived"), F.lit(False).alias("disabled"), F.lit(None).cast("string").alias("pushed_at")).alias("github"),
        F.when(F.col("n_chars") > 200, F.col("text")).otherwise("").alias("readme"), F.when(~every(83, 5), profile).alias("llm_profile"),
    )


RECORDS_SQL = """
lb AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
rec AS (
  SELECT doc_id AS pos, CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 2 END AS schema_version,
    CASE WHEN doc_id % 97 = 13 THEN NULL WHEN doc_id % 101 = 7 THEN 'src0/doc-0' ELSE source || '/doc-' || doc_id END AS repo_id,
    'doc-' || doc_id AS name, CASE WHEN doc_id % 89 <> 3 THEN 'https://example.org/' || source || '/' || doc_id END AS url,
    'a text in ' || lang AS description, [source, lang] AS topics, n_chars AS stars, lang AS language, coalesce(toxic = 1, false) AS archived,
    n_chars <= 200 AS no_readme, doc_id % 83 <> 5 AS has_profile,
    CASE WHEN quality IS NOT NULL THEN 'about ' || lang || ' doc-' || doc_id END AS summary, ['reading ' || lang] AS use_cases,
    CASE WHEN doc_id % 7 = 0 THEN []::VARCHAR[] ELSE ['doc-' || doc_id] END AS aliases,
    CASE WHEN doc_id % 11 <> 0 THEN (['library', 'tool', 'framework', 'service', 'runtime'])[(doc_id % 5 + 1)::INT] END AS project_type,
    CASE WHEN doc_id % 13 = 1 THEN []::VARCHAR[] ELSE [lang] END AS ecosystem,
    CASE WHEN doc_id % 17 <> 2 THEN nullif(trim(text, E' \\n\\t\\r'), '') END AS search_text,
    CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' ELSE 'medium' END AS confidence, coalesce(quality = 0, false) AS abstained,
    CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 2 END AS prompt_version
  FROM documents LEFT JOIN lb USING (doc_id)
)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part rows that have an embedding, as index entries."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), F.col("embedding").alias("vector"), "label")
    p = table(spark, sf_dir, "part").hint("merge").join(v, "p_partkey")  # millions of parts are a small file, but no small broadcast
    none, k = F.array().cast("array<string>"), F.col("p_partkey")
    made = {
        "schema_version": F.lit(2), "name": F.col("p_name"), "url": F.lit(None).cast("string"), "aliases": none, "description": F.concat("p_name", F.lit(" parts")), "topics": F.array("p_brand"),
        "language": _one_of(LANGUAGES, k), "stars": F.col("p_retailprice").cast("string"), "forks": F.lit(0).cast("long"), "archived": F.col("p_size") % 10 == 0, "disabled": F.col("p_size") == 7,
        "pushed_at": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "use_cases": F.array(F.lower("p_type")), "capabilities": none, "project_type": F.lower("p_type"),
        "ecosystem": none, "replaces": none, "related_projects": none, "search_text": F.lit(None).cast("string"), "search_phrases": none,
    }
    assert set(made) >= {*schemas.SCALARS, *schemas.LISTS}
    return p.select(
        F.concat(F.lit("part/"), k.cast("string")).alias("repo_id"), F.md5("p_name").alias("embedding_input_fingerprint"), "vector", F.struct(*(c.alias(n) for n, c in made.items())).alias("metadata"), k.alias("pos"), "label", "p_name",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 20 as queries, each asking by the name of another part or a sentence around it."""
    parts = table(spark, sf_dir, "part")
    v = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "label")
    v = v.join(F.broadcast(parts.agg(F.count("*").alias("n"))))  # one row
    q = v.withColumn("p_partkey", (F.col("qid") + 40) % F.col("n")).drop("n").join(parts.select("p_partkey", "p_name", "p_brand", "p_type").hint("merge"), "p_partkey")
    n = F.floor(F.col("qid") / 20) % 4
    text = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat(F.lit("a tool for "), F.lower("p_type"), F.lit(" of "), "p_brand")).when(n == 2, F.concat(F.lit("python alternative to "), "p_name")).otherwise(F.concat(F.lit("open source "), F.lower("p_type"), F.lit(" with "), "p_name"))
    return q.select("qid", text.alias("query"), "vector", "label")


ENTRIES_SQL = """
en AS (
  SELECT 'part/' || p_partkey AS repo_id, p_partkey AS pos, p_name AS name, p_brand, lower(p_type) AS kind, list_transform(embedding, lambda x: x::DOUBLE) AS v, label,
    (['Python', 'Rust', 'JavaScript', 'Go', 'C++'])[(p_partkey % 5 + 1)::INT] AS language,
    (['python', 'rust', 'javascript', 'go', 'c++'])[(p_partkey % 5 + 1)::INT] AS alias,
    p_retailprice AS stars, p_size % 10 = 0 AS archived, p_size = 7 AS disabled
  FROM part JOIN embeddings ON vec_id = p_partkey
),
qu AS (
  SELECT vec_id AS qid, list_transform(embedding, lambda x: x::DOUBLE) AS qv, label AS qlabel,
    CASE vec_id // 20 % 4 WHEN 0 THEN p_name WHEN 1 THEN 'a tool for ' || lower(p_type) || ' of ' || p_brand WHEN 2 THEN 'python alternative to ' || p_name
      ELSE 'open source ' || lower(p_type) || ' with ' || p_name END AS query
  FROM embeddings JOIN part ON p_partkey = (vec_id + 40) % (SELECT count(*) FROM part) WHERE vec_id % 20 = 0
),
pairs AS (SELECT qid, query, qlabel, en.*, list_cosine_similarity(qv, v) AS sem FROM qu, en)"""
