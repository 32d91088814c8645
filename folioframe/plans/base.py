"""Shared inputs of the registered queries, on both sides: DataFrames here, CTEs below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import search as S
from folioframe.plans.registry import cte
from folioframe.session import cut_lineage
from folioframe.sources.tables import Corpus


def runs(c: Corpus) -> DataFrame:
    """BM25 top 10 of every benchmark passage; k rows per query, written once for the session."""
    if not hasattr(c, "_runs"):
        c._runs = cut_lineage(S.bm25_search(c.queries, c.chunks, 10))
    return c._runs


def evidence(c: Corpus) -> DataFrame:
    """The run with texts: at most ten rows per query, written once for the session."""
    if not hasattr(c, "_evidence"):
        judged = runs(c).withColumn("relevance", S.scaled(F.col("score"), "minmax", ["query_id"]))
        c._evidence = cut_lineage(S.with_texts(judged, c.chunks.select("chunk_id", "text", "lang", "source")))
    return c._evidence


def qa(c: Corpus) -> DataFrame:
    """Question, answer and an answer with evidence markers for every passage."""
    first = F.regexp_extract("text", r"^[^.!?]*[.!?]", 0)
    q = F.col("query_id")
    return c.queries.select(
        "query_id",
        F.when(first == "", F.col("text")).otherwise(first).alias("question"),
        F.col("text").alias("answer"),
        F.concat(
            "text", F.lit(" [E1, E"), (q % 12 + 1).cast("string"), F.lit("] and "), F.lit("[e0"), (q % 5 + 1).cast("string"),
            F.when(q % 3 == 0, ", E99").otherwise(""), F.lit("]"),
        ).alias("cited"),
    )


def relevant(c: Corpus) -> DataFrame:
    """``query_id, chunk_id``: documents that hold the passage word for word.

    A passage and a document meet on the passage's rarest word; then the whole passage is
    looked for. No other pair is formed.
    """
    from pyspark.sql import Window

    from folioframe.functions import text as X
    from folioframe.operators import index as I

    def padded(text):
        return F.concat(F.lit(" "), F.array_join(X.tokens(text), " "), F.lit(" "))

    terms = c.queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    rarest = (
        terms.join(I.document_frequency(c.chunks), "term", "left")
        .groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("m"))
        .select("query_id", F.col("m.term").alias("term"))
    )
    near = I.token_rows(c.chunks).join(rarest, "term").select("query_id", "chunk_id").distinct()
    return (
        near.join(c.queries.select("query_id", padded(F.col("text")).alias("passage")), "query_id")
        .join(c.chunks.select("chunk_id", padded(F.col("text")).alias("body")), "chunk_id")
        .filter(F.contains("body", "passage")).select("query_id", "chunk_id")
    )


cte("tok", r"""SELECT doc_id AS chunk_id, list_filter(string_split_regex(lower(text), '[ \n\t\r]+'), lambda x: x <> '') AS words
  FROM documents""")
cte("doc_stats", "SELECT chunk_id, len(words) AS dl FROM tok", "tok")
cte("postings", """SELECT term, chunk_id, count(*) AS tf, first(dl) AS dl
  FROM (SELECT chunk_id, len(words) AS dl, unnest(words) AS term FROM tok) GROUP BY term, chunk_id""", "tok")
cte("term_raw", """SELECT term, count(*) AS df,
  ln((SELECT count(*) FROM doc_stats) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf FROM postings GROUP BY term""",
    "postings", "doc_stats")
cte("term_stats", """SELECT term, df, raw_idf,
  CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM term_raw) ELSE raw_idf END AS idf FROM term_raw""", "term_raw")
cte("qterms", r"""SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id,
  unnest(list_filter(string_split_regex(lower(text), '[ \n\t\r]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY 1, 2""")
cte("bm25", """SELECT query_id, chunk_id, round(sum(qtf * idf * (tf * 2.5 /
  (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM doc_stats))))), 6) AS score
  FROM qterms JOIN term_stats USING (term) JOIN postings USING (term) GROUP BY query_id, chunk_id""", "qterms", "term_stats")
cte("bm25_ranked", """SELECT query_id, chunk_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25""", "bm25")
cte("runs", "SELECT * FROM bm25_ranked WHERE rank <= 10", "bm25_ranked")
cte("evidence", """SELECT query_id, chunk_id, score, rank, text, lang, source,
  CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
    ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS relevance
  FROM runs JOIN documents ON chunk_id = doc_id WINDOW w AS (PARTITION BY query_id)""", "runs")
cte("qa", r"""SELECT item_id AS query_id,
  CASE WHEN regexp_extract(text, '^[^.!?]*[.!?]') = '' THEN text ELSE regexp_extract(text, '^[^.!?]*[.!?]') END AS question,
  text AS answer,
  text || ' [E1, E' || (item_id % 12 + 1) || '] and [e0' || (item_id % 5 + 1) ||
    CASE WHEN item_id % 3 = 0 THEN ', E99' ELSE '' END || ']' AS cited FROM benchmark""")
cte("body", "SELECT chunk_id, ' ' || array_to_string(words, ' ') || ' ' AS body FROM tok", "tok")
cte("relevant", r"""SELECT q.query_id, b.chunk_id FROM (SELECT item_id AS query_id, ' ' || array_to_string(list_filter(
  string_split_regex(lower(text), '[ \n\t\r]+'), lambda x: x <> ''), ' ') || ' ' AS passage FROM benchmark) q
  JOIN body b ON contains(b.body, q.passage)""", "body")
cte("hash_terms", """SELECT term, ('0x' || substr(md5(term), 1, 6))::BIGINT % 64 AS bucket,
  CASE WHEN ('0x' || substr(md5(term), 7, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sgn
  FROM (SELECT term FROM postings UNION SELECT term FROM qterms)""", "postings", "qterms")
cte("doc_weights", """SELECT chunk_id, bucket, sum(tf * sgn) AS w FROM postings JOIN hash_terms USING (term)
  GROUP BY 1, 2 HAVING sum(tf * sgn) <> 0""", "hash_terms")
cte("query_weights", """SELECT query_id, bucket, sum(qtf * sgn) AS w FROM qterms JOIN hash_terms USING (term)
  GROUP BY 1, 2 HAVING sum(qtf * sgn) <> 0""", "hash_terms")
cte("hash_dense", """SELECT query_id, chunk_id, round(coalesce(dot, 0) / (qn * dn), 6) AS score FROM
  (SELECT query_id, sqrt(sum(w * w)) AS qn FROM query_weights GROUP BY 1) q CROSS JOIN
  (SELECT chunk_id, sqrt(sum(w * w)) AS dn FROM doc_weights GROUP BY 1) d LEFT JOIN
  (SELECT query_id, chunk_id, sum(q.w * d.w) AS dot FROM query_weights q JOIN doc_weights d USING (bucket) GROUP BY 1, 2)
  USING (query_id, chunk_id)""", "doc_weights", "query_weights")
cte("centroids", """SELECT label AS query_id, list(x ORDER BY pos) AS vector FROM (SELECT label, pos, avg(x::DOUBLE) AS x FROM
  (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")
cte("dense_ranked", """SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, vec_id AS chunk_id, label, round(list_dot_product(vector, embedding::DOUBLE[]), 6) AS score
  FROM centroids CROSS JOIN embeddings)""", "centroids")
cte("dense_runs", "SELECT * FROM dense_ranked WHERE rank <= 10", "dense_ranked")
