"""The training-data operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, common, lm_scoring, mixing, near_dedup, packing, prefix_trie, quality, quotes, topk, tournament, toxicity, vector_join, warc


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.col("cluster").alias("cluster_id"), "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), toxicity.score("text", model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.scaled(F.col("embedding")).alias("v"))
    return topk.search(vectors, vectors.where("id % 50 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, common.table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.drawn(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col(mixing.SOURCE).alias("source"), F.col(mixing.EPOCH).alias("epoch"), F.col(mixing.BLOCK).alias("block"), F.col(mixing.TOKENS).alias("n_tokens"),
        F.col(mixing.WEIGHT).alias("weight"), F.col(mixing.BUDGET).alias("budget"), F.col(mixing.RUNNING).alias("running_tokens"),
    )


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS n, CASE WHEN doc_id IS NULL THEN text END AS text FROM documents
), s AS (
  SELECT source, sum(n)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY source
), t AS (
  SELECT sum(tokens)::DOUBLE AS total, list(tokens::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM s) ORDER BY source) AS ps, count(*)::DOUBLE AS k, min(tokens)::DOUBLE AS least FROM s WHERE tokens > 0
), bis AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS mid
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END,
         CASE WHEN ok THEN (lo + mid) / 2 ELSE (mid + hi) / 2 END
  FROM (
    SELECT step, lo, hi, mid,
           ln(list_sum(list_transform(ps, lambda x: pow(x, mid))))
             - mid * list_sum(list_transform(ps, lambda x: pow(x, mid) * ln(x))) / list_sum(list_transform(ps, lambda x: pow(x, mid)))
             <= 0.98 * ln(k) + 1e-12
           AND pow(least / total, mid) / list_sum(list_transform(ps, lambda x: pow(x, mid))) * total / least <= 4.0 AS ok
    FROM bis, t WHERE step < 37
  )
), a AS (
  SELECT hi AS a FROM bis WHERE step = 37
), w AS (
  SELECT source, tokens, docs, CASE WHEN tokens > 0 THEN round(pow(tokens, a) / (SELECT sum(pow(tokens, a)) FROM s, a WHERE tokens > 0), 9) END AS weight FROM s, a
), b AS (
  SELECT *, floor(weight * (SELECT total FROM t))::BIGINT AS budget, ceil(sqrt(docs))::BIGINT AS blocks FROM w
), e AS (
  SELECT *, CASE WHEN tokens > 0 THEN floor(budget::DOUBLE / tokens)::BIGINT ELSE 1 END AS epochs FROM b
), o AS (
  SELECT d.doc_id, d.n, e.*, md5(concat_ws(':', '0', source, coalesce(doc_id::VARCHAR, md5(text), ''))) AS h FROM d JOIN e USING (source)
), p AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % blocks AS block FROM o
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY block, h, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running FROM p
), c AS (
  SELECT *, epochs + CASE WHEN running <= budget - epochs * tokens AND budget - epochs * tokens > 0 THEN 1 ELSE 0 END AS copies FROM r
)
SELECT doc_id, source, unnest(range(copies)) AS epoch, block, n::BIGINT AS n_tokens, weight, budget, running AS running_tokens FROM c WHERE copies > 0
"""


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_join.near_duplicates(common.table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS low FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.conversations(quotes.quoting_stream(common.table(spark, sf_dir, "conversations")))
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", F.col("quotes").cast("long").alias("n_quotes"), F.col("links").cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "position",
    )


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.capture_stream(common.table(spark, sf_dir, "pages")))
    header = lambda name: F.try_element_at("headers", F.lit(name)).alias(name.replace("-", "_"))
    return out.select("record_id", "ts", "url_key", "full_id", "full_ts", "verdict", "digest", header("etag"), header("content-length"), header("date"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages
), k AS (
  SELECT *, list_aggregate(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
             lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid|sessionid)='))), 'string_agg', '&') AS q FROM p
), c AS (
  SELECT *, CASE WHEN trim(url) <> '' THEN
      regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(www|m)[.]', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/(index[.]html?)?$', '')
      || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url_key FROM k
), f AS (
  SELECT 2 * page_id AS full_id, 2 * page_id AS full_ts, url_key AS full_key, md5(html) AS digest, length(html) AS n, page_id % 7 AS d FROM c WHERE url_key IS NOT NULL
), r AS (
  SELECT 2 * page_id + 1 AS record_id, 2 * (page_id + 1000) + 1 AS ts, url_key, md5(html) AS tag, page_id % 7 AS d FROM c
), j AS (
  SELECT * FROM r ASOF LEFT JOIN f ON url_key = full_key AND ts > full_ts
)
SELECT record_id, ts, url_key, full_id, full_ts,
       CASE WHEN full_id IS NULL THEN 'orphan' WHEN tag = digest THEN 'resolved' ELSE 'changed' END AS verdict, digest,
       CASE WHEN tag = digest THEN 'W/"' || tag || '"' END AS etag,
       CASE WHEN tag = digest THEN n::VARCHAR END AS content_length,
       CASE WHEN tag = digest THEN 'later day ' || r_d END AS date
FROM (SELECT j.* EXCLUDE (d, d_1), j.d AS r_d FROM j)
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm_scoring.Model(docs.where(common.remainder("doc_id", 7) != 2))
    out = lm_scoring.scored(docs, model)
    return out.select(
        F.col("id").alias("doc_id"), (common.remainder("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(common.table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_heads(lists)).drop("label")


OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t
), c AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list({'l': label, 'w': words} ORDER BY turn NULLS FIRST, label, words) AS ts FROM c GROUP BY conv_id
), h AS (
  SELECT conv_id, ts, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
         lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::INTEGER])), 4294967295) % 4 AS h FROM o, crc
), s AS (
  SELECT h.conv_id, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20
), p AS (
  SELECT conv_id, d, list_transform(ts[1:d], lambda x: x.l) AS p, coalesce(ts[d].w, 0) AS words, len(ts) = d AS ends
  FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS d FROM s)
), n AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends
  FROM p GROUP BY p, d
), k AS (
  SELECT p[1:d - 1] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL
), m AS (
  SELECT n.*, coalesce(k.n, 0) AS children FROM n LEFT JOIN k ON n.p = k.p
), u AS (
  SELECT a AS p, sum((children = 0)::INTEGER) AS leaves, sum((n - 1) * words) AS saved
  FROM (SELECT p[1:a] AS a, children, n, words FROM (SELECT *, unnest(range(d + 1)) AS a FROM m)) GROUP BY a
)
SELECT m.conv_id, m.d AS depth, f.conv_id AS parent_conv_id, m.n AS n_convs, m.children AS n_children, u.leaves::BIGINT AS n_leaves,
       u.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN u ON m.p = u.p LEFT JOIN n f ON m.d > 0 AND f.p = m.p[1:m.d - 1]
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(common.table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, ws, count(*) AS c FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p) WHERE len(ws) > 0 GROUP BY ALL
), t AS (
  SELECT lang, sum(c * len(ws)) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m, sum(c)::BIGINT AS f
  FROM (SELECT lang, ws, c, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT lang, ws, c, unnest(range(1, 6)) AS m FROM w) WHERE len(ws) >= m)
  GROUP BY ALL HAVING sum(c) >= 100
), d AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE m > 1
), i AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, array_to_string(ws[i:i + s - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM d WHERE m > 2))
  ) GROUP BY ALL
), k AS (
  SELECT d.* FROM d LEFT JOIN i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f < 100 * d.f
), s AS (
  SELECT k.lang, k.phrase, k.f AS a, k.k, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * k.f * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM k) k JOIN t USING (lang)
  JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k.k], ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k.k + 1:], ' ')
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS lowest FROM s
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE lowest = 1
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM o WHERE rank <= 2000
"""


def op13_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament.pack_documents(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_exact_topk": op3_exact_topk,
    "op4_quality_resampling": op4_quality_resampling,
    "op5_source_mixing": op5_source_mixing,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_quotation_linking": op7_quotation_linking,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_tournament_packing": op13_tournament_packing,
}

ORACLE_SQL = {
    "op3_exact_topk": OP3_SQL,
    "op5_source_mixing": OP5_SQL,
    "op6_embedding_near_dedup": OP6_SQL,
    "op8_warc_revisits": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
