"""Index building and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.lexicon import PAPER_STOP
from folioframe.operators import impact_index as P
from folioframe.operators import index as I
from folioframe.operators import requests as R
from folioframe.operators import search as S
from folioframe.operators import vector_lists as V
from folioframe.plans import base as B
from folioframe.plans.registry import cte, query
from folioframe.session import checkpoint_dir, cut_lineage

# -- index ------------------------------------------------------------------------------


@query("build_inverted_index", """
SELECT term, df, round(raw_idf, 6) AS raw_idf, round(idf, 6) AS idf, total_tf, max_tf FROM term_stats
JOIN (SELECT term, sum(tf)::BIGINT AS total_tf, max(tf) AS max_tf FROM postings GROUP BY term) USING (term)""", "term_stats")
def _(c):
    return I.build_inverted_index(c.chunks).select(
        "term", "df", F.round("raw_idf", 6).alias("raw_idf"), F.round("idf", 6).alias("idf"), "total_tf", "max_tf")


@query("embed_chunks", """
SELECT chunk_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)), 6) AS value FROM doc_weights""", "doc_weights")
def _(c):
    v = I.embed_chunks(c.chunks, 64)
    return v.select("chunk_id", F.posexplode("embedding").alias("bucket", "value")).filter("value <> 0").withColumn(
        "value", F.round("value", 6))


cte("dirty_vectors", """SELECT vec_id, CASE vec_id % 5 WHEN 1 THEN list_append(embedding, 0.5::FLOAT)
  WHEN 2 THEN list_concat(embedding[1:63], ['nan'::FLOAT]) WHEN 3 THEN NULL ELSE embedding END AS embedding FROM embeddings""")


@query("validate_vectors", """
SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'wrong dimension'
  WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 THEN 'not finite' END AS reason,
  embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS valid
FROM dirty_vectors""", "dirty_vectors")
def _(c):
    e, m = F.col("embedding"), F.col("vec_id") % 5
    dirty = c.table("embeddings").select("vec_id", F.when(m == 1, F.array_append(e, F.lit(0.5).cast("float")))
        .when(m == 2, F.concat(F.slice(e, 1, 63), F.array(F.lit("NaN").cast("float"))))
        .when(m == 3, None).otherwise(e).alias("embedding"))
    return I.validate_vectors(dirty, 64).select("vec_id", "reason", "valid")


@query("index_metadata", """
SELECT d.doc_id AS chunk_id, d.doc_id AS document_id, d.lang, d.source, l.quality::VARCHAR AS quality, l.toxic::VARCHAR AS toxic,
  3 + (l.quality IS NOT NULL)::INT + (l.toxic IS NOT NULL)::INT AS n_keys
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(c):
    chunks = c.documents.select(F.col("document_id").alias("chunk_id"), "document_id")
    m = I.index_metadata(chunks, c.documents.select("document_id", "lang", "source"), c.labels)
    k = F.col("metadata")
    return m.select("chunk_id", "document_id", *[k[n].alias(n) for n in ("lang", "source", "quality", "toxic")],
                    F.size("metadata").alias("n_keys"))


@query("index_valid_chunks", r"""
SELECT CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id END AS chunk_id, length(text) AS chars FROM documents
WHERE doc_id % 11 <> 0 AND NOT (doc_id % 7 = 0)""")
def _(c):
    d = c.documents.select(
        F.when(F.col("document_id") % 11 != 0, F.col("document_id")).alias("chunk_id"),
        F.when(F.col("document_id") % 7 == 0, F.lit(" \n\t ")).otherwise(F.col("text")).alias("text"))
    return I.index_valid_chunks(d).select("chunk_id", F.length("text").alias("chars"))


@query("new_chunks", """
SELECT doc_id AS chunk_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(c):
    return I.new_chunks(c.chunks.select("chunk_id", "lang"), c.labels.select(F.col("document_id").alias("chunk_id")))


@query("replace_document", """
SELECT doc_id AS document_id, 'old' AS version, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT d.doc_id, 'new', d.n_chars + l.quality FROM documents d JOIN labels l USING (doc_id)""")
def _(c):
    old = c.documents.select("document_id", F.lit("old").alias("version"), "n_chars")
    fresh = c.documents.join(c.labels, "document_id").select(
        "document_id", F.lit("new").alias("version"), (F.col("n_chars") + F.col("quality")).alias("n_chars"))
    return I.replace_document(old, fresh)


@query("upsert_items", """
SELECT user_id AS chunk_id, event_id AS batch, event_type, value FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def _(c):
    items = c.events.select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("batch"), "event_type", "value")
    return I.latest_items(items)


@query("index_stats", """
SELECT count(s.id) AS sparse_items, count(d.id) AS dense_items, count(*) FILTER (d.id IS NULL) AS only_sparse,
  count(*) FILTER (s.id IS NULL) AS only_dense, count(*) FILTER (s.id IS NULL OR d.id IS NULL) = 0 AS in_step
FROM (SELECT doc_id AS id FROM documents) s FULL JOIN (SELECT vec_id AS id FROM embeddings) d ON s.id = d.id""")
def _(c):
    return I.index_stats(c.chunks, c.vectors)


@query("orphaned_chunks", """
SELECT vec_id AS chunk_id, vec_id * 3 AS document_id, label FROM embeddings WHERE vec_id * 3 NOT IN (SELECT doc_id FROM documents)""")
def _(c):
    chunks = c.vectors.select("chunk_id", (F.col("chunk_id") * 3).alias("document_id"), "label")
    return I.orphaned_chunks(chunks, c.documents)


@query("expired_rows", """
SELECT event_id, user_id FROM events WHERE ts < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 DAY""")
def _(c):
    return I.expired_rows(c.events, "ts", F.to_timestamp(F.lit("2024-02-01 00:00:00")), 20).select("event_id", "user_id")


@query("metadata_filter", """
SELECT doc_id AS chunk_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src7')""")
def _(c):
    return I.metadata_filter(c.chunks, {"lang": "en", "source": ["src1", "src2", "src7"]}).select("chunk_id")


@query("metadata_filter_batch", """
SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN documents
  ON source IN ('src' || (item_id % 20), 'src' || (item_id % 7)) AND (item_id % 3 = 0 OR lang = CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END)""")
def _(c):
    q = F.col("query_id")

    def row(key, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    wanted = c.queries.select("query_id", F.inline(F.filter(F.array(
        row("source", F.concat(F.lit("src"), (q % 20).cast("string"))), row("source", F.concat(F.lit("src"), (q % 7).cast("string"))),
        F.when(q % 3 != 0, row("lang", F.when(q % 2 == 0, "en").otherwise("de")))), lambda s: s.isNotNull())))
    return I.filters_as_data(c.chunks, wanted)


@query("filter_by_source", "SELECT doc_id AS chunk_id, n_chars FROM documents WHERE source = 'src3'")
def _(c):
    return c.documents.filter("source = 'src3'").select(F.col("document_id").alias("chunk_id"), "n_chars")


@query("restrict_to_documents", """
SELECT query_id, chunk_id, rank FROM runs WHERE chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1)""", "runs")
def _(c):
    allowed = c.labels.filter("quality = 1").select(F.col("document_id").alias("chunk_id"))
    return B.runs(c).join(allowed, "chunk_id", "left_semi").select("query_id", "chunk_id", "rank")


# -- search -----------------------------------------------------------------------------


@query("bm25_search", "SELECT * FROM runs", "runs")
def _(c):
    return S.bm25_search(c.queries, c.chunks, 10)


@query("bm25_search_filtered", """
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM bm25 JOIN documents ON chunk_id = doc_id WHERE lang IN ('en', 'de')
QUALIFY rank <= 10""", "bm25")
def _(c):
    return S.bm25_search(c.queries, c.chunks, 10, {"lang": ["en", "de"]})


@query("dense_search", "SELECT * FROM dense_runs", "dense_runs")
def _(c):
    return S.dense_search(c.centroids, c.vectors, 10, 64)


def _new_place(c, name):
    return f"{checkpoint_dir(c.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("vector_list_search", "SELECT * FROM dense_runs", "dense_runs")
def _(c):
    return V.search_lists(c.centroids, V.build_lists(c.vectors, _new_place(c, "lists"), 64), 10).run


@query("vector_list_added", "SELECT * FROM dense_runs", "dense_runs")
def _(c):
    index = V.build_lists(c.vectors.filter("chunk_id % 3 > 0"), _new_place(c, "lists"), 64)
    V.add_vectors(index, c.vectors.filter("chunk_id % 3 = 0"))
    return V.search_lists(c.centroids, V.open_lists(c.spark, index.path), 10).run


@query("dense_search_lsh")
def _(c):
    return S.dense_search_lsh(c.centroids, c.vectors, 10, 64)


cte("legs", """SELECT 'sparse' AS leg, query_id, chunk_id, score, rank FROM bm25_ranked WHERE rank <= 20 UNION ALL
  SELECT 'dense', query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r
  FROM hash_dense QUALIFY r <= 20""", "bm25_ranked", "hash_dense")
cte("rrf", """SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS runs FROM legs GROUP BY 1, 2""", "legs")


def _hash_vectors(c):
    q = I.embed_chunks(c.queries.withColumnRenamed("query_id", "chunk_id"), 64)
    return (q.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")),
            I.embed_chunks(c.chunks, 64).withColumnRenamed("embedding", "vector"))


def _legs(c, k=20):
    q, d = _hash_vectors(c)
    return S.bm25_search(c.queries, c.chunks, k), S.dense_search(q, d, k, 64)


@query("rrf_fuse", """
SELECT query_id, chunk_id, score, runs, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rrf""", "rrf")
def _(c):
    return S.rrf_fuse(list(_legs(c)))


@query("overfetch_hybrid", """
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rrf QUALIFY rank <= 10""", "rrf")
def _(c):
    return S.rrf_fuse(list(_legs(c, 2 * 10))).filter("rank <= 10").drop("runs")


cte("unit_legs", """SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE
  (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS unit FROM legs WINDOW w AS (PARTITION BY leg, query_id)""", "legs")


cte("fused", """SELECT query_id, chunk_id, coalesce(max(unit) FILTER (leg = 'dense'), 0.0) AS dense_score,
  coalesce(max(unit) FILTER (leg = 'sparse'), 0.0) AS sparse_score FROM unit_legs GROUP BY 1, 2""", "unit_legs")


@query("weighted_fuse", """
SELECT query_id, chunk_id, round(dense_score, 6) AS dense_score, round(sparse_score, 6) AS sparse_score, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT *, round(dense_score * 0.25 + sparse_score * 0.75, 6) AS score FROM fused)""", "fused")
def _(c):
    sparse, dense = _legs(c)
    return S.weighted_fuse(dense, sparse, 1, 3)


@query("normalize_minmax", "SELECT query_id, chunk_id, round(relevance, 6) AS normalized FROM evidence", "evidence")
def _(c):
    return S.normalize_scores(B.runs(c)).select("query_id", "chunk_id", "normalized")


@query("normalize_zscore", """
SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0
  ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6) AS normalized FROM runs WINDOW w AS (PARTITION BY query_id)""", "runs")
def _(c):
    return S.normalize_scores(B.runs(c), "zscore").select("query_id", "chunk_id", "normalized")


@query("normalize_percent", """
SELECT query_id, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 100.0
  ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) * 100.0 END, 6) AS normalized FROM runs WINDOW w AS (PARTITION BY query_id)""", "runs")
def _(c):
    return S.normalize_scores(B.runs(c), "percent").select("query_id", "chunk_id", "normalized")


@query("attach_scores", """
SELECT r.query_id, r.chunk_id, r.score, r.runs, row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, r.chunk_id) AS rank,
  d.score AS dense_score, d.rank AS dense_rank, s.score AS sparse_score, s.rank AS sparse_rank
FROM rrf r LEFT JOIN legs d ON d.leg = 'dense' AND r.query_id = d.query_id AND r.chunk_id = d.chunk_id
LEFT JOIN legs s ON s.leg = 'sparse' AND r.query_id = s.query_id AND r.chunk_id = s.chunk_id""", "rrf")
def _(c):
    sparse, dense = _legs(c)
    return S.attach_scores(S.rrf_fuse([sparse, dense]), dense, sparse)


STOP_SQL = ", ".join(f"'{w}'" for w in S.QUERY_STOP)
RERANK = r"[\p{L}\p{N}_]+(?:[./-]+[\p{L}\p{N}_]+)*"


def rerank_ctes(prefix: str, source: str, needs: tuple[str, ...]) -> None:
    """CTE ``<prefix>_reranked`` over a subquery of (query_id, chunk_id, query_text, text, meta_text, score)."""
    squeeze = r"trim(regexp_replace(lower(@), '[ \n\t\r]+', ' ', 'g'))"
    terms = f"list_filter(regexp_extract_all(@, '{RERANK}'), lambda t: regexp_matches(t, '^[a-z0-9][a-z0-9_./-]*$') AND t NOT IN ({STOP_SQL}))"
    p = prefix
    cte(f"{p}_base", f"SELECT query_id, chunk_id, score, {squeeze.replace('@', 'query_text')} AS q, {squeeze.replace('@', 'text')} AS d, {squeeze.replace('@', 'meta_text')} AS m FROM ({source})", *needs)
    cte(f"{p}_q", f"SELECT query_id, chunk_id, term, count(*) AS qf FROM (SELECT query_id, chunk_id, unnest({terms.replace('@', 'q')}) AS term FROM {p}_base) GROUP BY ALL", f"{p}_base")
    cte(f"{p}_d", f"SELECT query_id, chunk_id, term, count(*) AS df FROM (SELECT query_id, chunk_id, unnest({terms.replace('@', 'd')}) AS term FROM {p}_base) GROUP BY ALL", f"{p}_base")
    cte(f"{p}_lex", f"""SELECT query_id, chunk_id, least(1.0, 0.65 * matched / qt + 0.35 * CASE WHEN dn > 0 THEN dot / (qn * dn) ELSE 0 END) AS lexical FROM
      (SELECT query_id, chunk_id, sum(qf) AS qt, sum(CASE WHEN qf IS NOT NULL AND df IS NOT NULL THEN least(1.0, qf * least(1.0, ln(1 + df) / ln(2))) ELSE 0.0 END) AS matched,
        sum(coalesce(qf * df, 0)) AS dot, sqrt(sum(coalesce(qf * qf, 0))) AS qn, sqrt(sum(coalesce(df * df, 0))) AS dn
       FROM {p}_q FULL JOIN {p}_d USING (query_id, chunk_id, term) GROUP BY 1, 2) WHERE qt > 0""", f"{p}_q", f"{p}_d")
    cte(f"{p}_parts", f"""SELECT query_id, chunk_id, score, CASE WHEN q = '' OR d = '' THEN 0.0 WHEN contains(d, q) THEN 1.0 WHEN len(ws) < 2 THEN 0.0
        ELSE len(list_filter(range(1, len(ws)), lambda i: contains(d, ws[i] || ' ' || ws[i + 1]))) / (len(ws) - 1) END AS phrase,
      CASE WHEN len(qt) = 0 OR m = '' THEN 0.0 ELSE len(list_filter(qt, lambda t: list_contains(mt, t))) / len(qt) END AS meta
      FROM (SELECT *, string_split(q, ' ') AS ws, {terms.replace('@', 'q')} AS qt, regexp_extract_all(m, '{RERANK}') AS mt FROM {p}_base)""", f"{p}_base")
    cte(f"{p}_reranked", f"""SELECT query_id, chunk_id, round(coalesce(lexical, 0), 6) AS lexical, round(phrase, 6) AS phrase, round(meta, 6) AS meta,
      round(0.55 * coalesce(lexical, 0) + 0.15 * phrase + 0.10 * meta + 0.20 * least(1.0, greatest(0.0, score)), 6) AS rerank_score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(0.55 * coalesce(lexical, 0) + 0.15 * phrase + 0.10 * meta + 0.20 * least(1.0, greatest(0.0, score)), 6) DESC, chunk_id) AS rank
      FROM {p}_parts LEFT JOIN {p}_lex USING (query_id, chunk_id)""", f"{p}_parts", f"{p}_lex")


rerank_ctes("ev", """SELECT query_id, chunk_id, b.text AS query_text, e.text, e.lang || ' ' || e.source || ' of the ' || b.text AS meta_text, relevance AS score
  FROM evidence e JOIN benchmark b ON b.item_id = e.query_id""", ("evidence",))
rerank_ctes("hy", """SELECT query_id, chunk_id, b.text AS query_text, d.text, '' AS meta_text, score
  FROM rrf JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id""", ("rrf",))


@query("lexical_rerank", "SELECT * FROM ev_reranked", "ev_reranked")
def _(c):
    meta = F.concat("lang", F.lit(" "), "source", F.lit(" of the "), "query_text")
    e = B.evidence(c).drop("score", "rank").withColumnRenamed("relevance", "score").join(
        c.queries.select("query_id", F.col("text").alias("query_text")), "query_id").withColumn("meta_text", meta)
    return S.lexical_rerank(e)


def overlap_model():
    """A stand-in for a user's model: shared characters of both texts."""
    def score(left, right):
        return [len(set(a) & set(b)) / max(1, len(set(a) | set(b))) for a, b in zip(left, right)]

    return score


@query("model_rerank", """
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM (
    SELECT query_id, chunk_id, list_distinct(string_split(q.text, '')) AS a, list_distinct(string_split(e.text, '')) AS b
    FROM evidence e JOIN benchmark q ON q.item_id = e.query_id)) QUALIFY rank <= 5""", "evidence")
def _(c):
    e = B.evidence(c).join(c.queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    return S.model_rerank(e, overlap_model, 5)


@query("hybrid_search", """
SELECT h.query_id, h.chunk_id, h.rank, h.rerank_score, r.score AS rrf_score, d.score AS dense_score, s.score AS sparse_score
FROM hy_reranked h JOIN rrf r USING (query_id, chunk_id)
LEFT JOIN legs d ON d.leg = 'dense' AND h.query_id = d.query_id AND h.chunk_id = d.chunk_id
LEFT JOIN legs s ON s.leg = 'sparse' AND h.query_id = s.query_id AND h.chunk_id = s.chunk_id WHERE h.rank <= 10""", "hy_reranked")
def _(c):
    return S.hybrid_search(c.queries, c.chunks, 10)


@query("search_index", "SELECT * FROM runs", "runs")
def _(c):
    return P.search_impacts(c.queries, P.build_impacts(c.chunks, _new_place(c, "search-index")), 10).run


# Requests: every passage with settings of its own, filters as rows.
cte("request", """SELECT item_id AS query_id, text, CASE item_id % 5 WHEN 0 THEN 'dense' WHEN 1 THEN 'sparse' ELSE 'hybrid' END AS mode,
  3 + item_id % 8 AS top_k, (item_id % 3) / 2.0::DOUBLE AS vector_weight, (1 + item_id % 2) / 2.0::DOUBLE AS keyword_weight, item_id % 4 = 2 AS rerank FROM benchmark""")
cte("request_filter", """SELECT item_id AS query_id, key, value FROM (SELECT item_id, unnest([
  {'key': 'lang', 'value': CASE WHEN item_id % 6 < 4 THEN 'en' END}, {'key': 'lang', 'value': CASE WHEN item_id % 6 = 3 THEN 'de' END},
  {'key': 'source', 'value': CASE WHEN item_id % 7 = 0 THEN 'src' || item_id % 5 END},
  {'key': 'source', 'value': CASE WHEN item_id % 11 = 4 THEN 'nowhere' END}], recursive := true) FROM benchmark) WHERE value IS NOT NULL""")
cte("request_allowed", """SELECT query_id, doc_id AS chunk_id FROM request r, documents d
  WHERE NOT EXISTS (SELECT 1 FROM request_filter f WHERE f.query_id = r.query_id AND f.key = 'lang'
      GROUP BY f.query_id HAVING count(*) FILTER (f.value = d.lang) = 0)
    AND NOT EXISTS (SELECT 1 FROM request_filter f WHERE f.query_id = r.query_id AND f.key = 'source'
      GROUP BY f.query_id HAVING count(*) FILTER (f.value = d.source) = 0)""", "request", "request_filter")
cte("request_legs", """SELECT leg, query_id, chunk_id, score, row_number() OVER (PARTITION BY leg, query_id ORDER BY score DESC, chunk_id) AS rank, top_k
  FROM (SELECT 'sparse' AS leg, * FROM bm25 UNION ALL SELECT 'dense', * FROM hash_dense) JOIN request_allowed USING (query_id, chunk_id)
  JOIN request USING (query_id) WHERE mode = 'hybrid' OR mode = leg QUALIFY rank <= 2 * top_k""", "bm25", "hash_dense", "request_allowed")
cte("request_fused", """SELECT query_id, chunk_id, d AS dense_score, s AS sparse_score, rerank, top_k, round(CASE WHEN mode <> 'hybrid' THEN coalesce(du, su)
    ELSE (coalesce(du, 0) * vector_weight + coalesce(su, 0) * keyword_weight) / (vector_weight + keyword_weight) END, 6) AS score
  FROM (SELECT query_id, chunk_id, max(unit) FILTER (leg = 'dense') AS du, max(unit) FILTER (leg = 'sparse') AS su,
      max(score) FILTER (leg = 'dense') AS d, max(score) FILTER (leg = 'sparse') AS s
    FROM (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE
      (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS unit FROM request_legs WINDOW w AS (PARTITION BY leg, query_id))
    GROUP BY 1, 2) JOIN request USING (query_id)""", "request_legs", "request")
rerank_ctes("rq", """SELECT query_id, chunk_id, r.text AS query_text, d.text, '' AS meta_text, score
  FROM request_fused f JOIN request r USING (query_id) JOIN documents d ON d.doc_id = chunk_id WHERE f.rerank""", ("request_fused", "request"))
cte("request_results", """SELECT query_id, chunk_id, rank, score, dense_score, sparse_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, dense_score, sparse_score, top_k, coalesce(rerank_score, f.score) AS score
    FROM request_fused f LEFT JOIN (SELECT query_id, chunk_id, rerank_score FROM rq_reranked) USING (query_id, chunk_id))) WHERE rank <= top_k""", "request_fused", "rq_reranked")


def _answers(c):
    q = F.col("query_id")
    requests = c.queries.select(
        "query_id", "text", F.when(q % 5 == 0, "dense").when(q % 5 == 1, "sparse").otherwise("hybrid").alias("mode"), (3 + q % 8).alias("top_k"),
        ((q % 3) / 2.0).alias("vector_weight"), ((1 + q % 2) / 2.0).alias("keyword_weight"), (q % 4 == 2).alias("rerank"))

    def row(key, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    filters = c.queries.select("query_id", F.inline(F.filter(F.array(
        row("lang", F.when(q % 6 < 4, "en")), row("lang", F.when(q % 6 == 3, "de")),
        row("source", F.when(q % 7 == 0, F.concat(F.lit("src"), (q % 5).cast("string")))), row("source", F.when(q % 11 == 4, "nowhere"))),
        lambda s: s["value"].isNotNull())))
    return R.search_requests(requests, c.chunks, filters)


@query("request_search", "SELECT * FROM request_results", "request_results")
def _(c):
    return _answers(c).results


@query("request_stages", """
SELECT query_id, mode, rerank, coalesce(eligible, 0) AS eligible, coalesce(dense_candidates, 0) AS dense_candidates, coalesce(sparse_candidates, 0) AS sparse_candidates,
  coalesce(fused_candidates, 0) AS fused_candidates, coalesce(reranked_candidates, 0) AS reranked_candidates, coalesce(final_results, 0) AS final_results
FROM request LEFT JOIN (SELECT query_id, count(*) AS eligible FROM request_allowed GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT query_id, count(*) FILTER (leg = 'dense') AS dense_candidates, count(*) FILTER (leg = 'sparse') AS sparse_candidates FROM request_legs GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS fused_candidates, count(*) FILTER (rerank) AS reranked_candidates FROM request_fused GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS final_results FROM request_results GROUP BY 1) USING (query_id)""", "request_results", "request_allowed")
def _(c):
    return _answers(c).stages


@query("federated_search", """
SELECT query_id, chunk_id, score, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, chunk_id) AS rank
FROM bm25 JOIN documents ON chunk_id = doc_id QUALIFY rank <= 3""", "bm25")
def _(c):
    return S.federated_by_column(c.queries, c.chunks, "lang", 3).select("query_id", "chunk_id", "score", "lang", "rank")


@query("merge_results", """
SELECT query_id, chunk_id, list, row_number() OVER (PARTITION BY query_id ORDER BY list, r, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, min(list) AS list, arg_min(rank, list) AS r FROM (
    SELECT query_id, chunk_id, CASE leg WHEN 'dense' THEN 0 ELSE 1 END AS list, rank FROM legs) GROUP BY 1, 2)""", "legs")
def _(c):
    sparse, dense = _legs(c)
    return S.merge_results([dense, sparse])


cte("doc_edges", """SELECT doc_id AS src, doc_id // 2 AS dst FROM documents UNION SELECT doc_id // 2, doc_id FROM documents""")


@query("graph_augmented_merge", """
SELECT query_id, chunk_id, list, row_number() OVER (PARTITION BY query_id ORDER BY list, r, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, min(list) AS list, arg_min(rank, list) AS r FROM (
    SELECT query_id, chunk_id, 0 AS list, rank FROM runs UNION ALL
    SELECT query_id, dst, 1, min(rank) FROM runs JOIN doc_edges ON src = chunk_id GROUP BY 1, 2) GROUP BY 1, 2)""", "runs", "doc_edges")
def _(c):
    d = c.documents.select(F.col("document_id").alias("a"), F.floor(F.col("document_id") / 2).alias("b"))
    edges = d.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(d.select("b", "a")).distinct()
    return S.graph_augmented_merge(B.runs(c), edges)


def _part_papers(c):
    null = F.lit(None).cast("string")
    papers = c.table("part").select(
        F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.concat("p_type", F.lit(" "), "p_brand").alias("abstract"),
        F.col("p_size").alias("citation_count"), (F.col("p_size") + 1990).alias("year"),
        null.alias("arxiv_id"), null.alias("doi"), null.alias("pmid"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("provider_paper_id"))
    # one question per distinct name; the name itself is the key, so no global numbering is needed
    names = c.table("part").select(F.col("p_name").alias("query_id")).distinct().withColumn("text", F.concat("query_id", F.lit(" of the economy ")))
    return names, papers


PAPER_STOP_SQL = ", ".join(f"'{w}'" for w in PAPER_STOP)


@query("keyword_paper_search", f"""
WITH q AS (SELECT DISTINCT p_name AS query_id, p_name || ' of the economy' AS q FROM part),
t AS (SELECT query_id, q, list_distinct(list_filter(list_transform(regexp_extract_all(lower(q), '[a-zA-Z0-9][a-zA-Z0-9._:/-]*'),
  lambda x: trim(x, '._:/-')), lambda x: length(x) >= 2 AND x NOT IN ({PAPER_STOP_SQL}) AND (NOT regexp_full_match(x, '[0-9]+') OR length(x) = 4))) AS terms FROM q),
p AS (SELECT p_partkey AS paper_id, p_name AS title, lower(p_type || ' ' || p_brand) AS abstract, p_size AS cites, 1990 + p_size AS year,
  'part-' || p_partkey AS ids FROM part),
h AS (SELECT query_id, paper_id, cites, year, len(terms) AS n, q = title AS same, contains(title, q) AS inside,
  len(list_filter(terms, lambda x: len(list_filter(regexp_extract_all(title, '[a-zA-Z0-9][a-zA-Z0-9._:/-]*'), lambda y: x = y OR (length(x) >= 4 AND (contains(y, x) OR contains(x, y))))) > 0)) AS th,
  len(list_filter(terms, lambda x: len(list_filter(regexp_extract_all(abstract, '[a-zA-Z0-9][a-zA-Z0-9._:/-]*'), lambda y: x = y OR (length(x) >= 4 AND (contains(y, x) OR contains(x, y))))) > 0)) AS ah,
  len(list_filter(terms, lambda x: contains(ids, x))) AS ih FROM t CROSS JOIN p)
SELECT query_id, paper_id, round(CASE WHEN same THEN 1.0 WHEN inside THEN 0.95 WHEN n = 1 AND th = 1 THEN greatest(0.9, 0.6 * th / n + 0.35 * ah / n + 0.05 * ih / n)
  ELSE 0.6 * th / n + 0.35 * ah / n + 0.05 * ih / n END, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cites DESC, year DESC, paper_id DESC) AS rank
FROM h WHERE th + ah + ih > 0 OR inside QUALIFY rank <= 10""")
def _(c):
    names, papers = _part_papers(c)
    return S.keyword_paper_search(names, papers, PAPER_STOP, 10)


for n in (1, 2, 3):
    text = "text" + " || ' additional evidence'" * (n - 1)
    cte(f"qterms_{n}", rf"""SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id,
      unnest(list_filter(string_split_regex(lower({text}), '[ \n\t\r]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY 1, 2""")
    cte(f"scores_{n}", f"""SELECT query_id, chunk_id, round(sum(qtf * idf * (tf * 2.5 /
      (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM doc_stats))))), 6) AS score
      FROM qterms_{n} JOIN term_stats USING (term) JOIN postings USING (term) GROUP BY query_id, chunk_id
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""", f"qterms_{n}", "term_stats")
    cte(f"round_{n}", f"""SELECT query_id, round(least(1.0, 0.5 * avg(s) + 0.25 * CASE WHEN count(*) = 1 THEN 1.0
      ELSE greatest(0.0, least(1.0, 1.0 - stddev_pop(s))) END + 0.25 * least(1.0, count(*) / 3.0)), 6) AS confidence
      FROM (SELECT query_id, CASE WHEN score BETWEEN 0 AND 1 THEN score WHEN score >= -1 AND score < 0 THEN (score + 1) / 2
      ELSE 1 - 1 / (1 + score) END AS s FROM scores_{n}) GROUP BY 1""", f"scores_{n}")


@query("iterative_search", """
SELECT r.query_id, CASE WHEN r.confidence >= 0.98 THEN 1 WHEN s.confidence >= 0.98 THEN 2 ELSE 3 END AS iterations,
  CASE WHEN r.confidence >= 0.98 THEN r.confidence WHEN s.confidence >= 0.98 THEN greatest(r.confidence, s.confidence)
    ELSE greatest(r.confidence, s.confidence, t.confidence) END AS best_confidence,
  (SELECT count(DISTINCT chunk_id) FROM (SELECT 1 AS n, * FROM scores_1 UNION ALL SELECT 2, * FROM scores_2 UNION ALL SELECT 3, * FROM scores_3) x
   WHERE x.query_id = r.query_id AND (n = 1 OR (n = 2 AND r.confidence < 0.98) OR (n = 3 AND r.confidence < 0.98 AND s.confidence < 0.98))) AS results
FROM round_1 r JOIN round_2 s USING (query_id) JOIN round_3 t USING (query_id)""", "round_1", "round_2", "round_3")
def _(c):
    stored = cut_lineage(S.word_statistics(c.chunks))
    return S.iterative_search(c.queries, lambda q: S.bm25_search(q, c.chunks, 10, statistics=stored), threshold=0.98, rounds=3)
