"""Quality metrics, graph, trends, listings, events and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioframe.functions import ids
from folioframe.functions.lexicon import ANSWER_STOP, CLAIM_STOP, GAP_STOP
from folioframe.operators import evaluate as M
from folioframe.operators import events as T
from folioframe.operators import graph as G
from folioframe.operators import listing as L
from folioframe.operators import search as S
from folioframe.operators import trend as R
from folioframe.operators.resolve import with_identity
from folioframe.plans import base as B
from folioframe.plans.evidencing import APOS, SENT, WORDS, quoted
from folioframe.plans.ingest import sq
from folioframe.plans.registry import cte, query
from folioframe.plans.retrieval import _hash_vectors
from folioframe.session import checkpoint_dir
from folioframe.streaming import streams as ST

# -- ranking metrics --------------------------------------------------------------------

cte("two_runs", """SELECT 'sparse' AS run, query_id, chunk_id, rank FROM bm25_ranked WHERE rank <= 10 UNION ALL
  SELECT 'dense', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM hash_dense QUALIFY r <= 10""", "bm25_ranked", "hash_dense")
cte("metrics", """SELECT run, query_id, round(coalesce(hits / n, 0), 6) AS precision, round(CASE WHEN rel > 0 THEN coalesce(hits, 0) / rel ELSE 0 END, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr,
  round(CASE WHEN coalesce(rel, 0) = 0 THEN 0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, least(rel, 10) + 1), lambda i: 1.0 / log2(i + 1))) END, 6) AS ndcg FROM
  (SELECT item_id AS query_id, run FROM benchmark CROSS JOIN (SELECT unnest(['sparse', 'dense']) AS run)) LEFT JOIN
  (SELECT run, r.query_id, count(*) AS n, count(q.chunk_id) AS hits, min(rank) FILTER (q.chunk_id IS NOT NULL) AS first, sum(CASE WHEN q.chunk_id IS NULL THEN 0 ELSE 1.0 / log2(rank + 1) END) AS dcg
   FROM two_runs r LEFT JOIN relevant q ON r.query_id = q.query_id AND r.chunk_id = q.chunk_id GROUP BY 1, 2) USING (run, query_id) LEFT JOIN (SELECT query_id, count(*) AS rel FROM relevant GROUP BY 1) USING (query_id)""", "two_runs", "relevant")


def _metrics(c):
    q, d = _hash_vectors(c)
    dense = S.dense_search(q, d, 10, 64).select(F.lit("dense").alias("run"), "query_id", "chunk_id", "rank")
    both = B.runs(c).select(F.lit("sparse").alias("run"), "query_id", "chunk_id", "rank").unionByName(dense)
    return M.query_metrics(both, c.queries, B.relevant(c), ["sparse", "dense"], 10)


for _name in ("recall", "precision", "mrr", "ndcg"):
    @query(_name if _name in ("mrr", "ndcg") else f"{_name}_at_k", f"SELECT run, query_id, {_name} FROM metrics", "metrics")
    def _(c, name=_name):
        return _metrics(c).select("run", "query_id", name)


@query("evaluate_run", """
SELECT run, lang, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
FROM (SELECT *, 'part' || (query_id % 3) AS lang FROM metrics) GROUP BY ROLLUP (run, lang)""", "metrics")
def _(c):
    return M.evaluate_run(_metrics(c).withColumn("lang", F.concat(F.lit("part"), (F.col("query_id") % 3).cast("string"))), "lang")


@query("relevant_documents", "SELECT * FROM relevant", "relevant")
def _(c):
    return B.relevant(c)


@query("context_precision_recall", "SELECT query_id, precision AS context_precision, recall AS context_recall FROM metrics WHERE run = 'sparse'", "metrics")
def _(c):
    one = B.runs(c).select(F.lit("contexts").alias("run"), "query_id", "chunk_id", "rank")
    return M.query_metrics(one, c.queries, B.relevant(c), ["contexts"], 10).select("query_id", F.col("precision").alias("context_precision"), F.col("recall").alias("context_recall"))


for _name in ("precision", "recall"):
    @query(f"context_{_name}", f"SELECT query_id, {_name} AS context_{_name} FROM metrics WHERE run = 'sparse'", "metrics")
    def _(c, name=_name):
        one = B.runs(c).select(F.lit("contexts").alias("run"), "query_id", "chunk_id", "rank")
        made = M.query_metrics(one, c.queries, B.relevant(c), ["contexts"], 10)
        return made.select("query_id", F.col(name).alias(f"context_{name}"))


# -- answers ----------------------------------------------------------------------------

cte("contexts", "SELECT query_id, string_agg(lower(text), ' ' ORDER BY rank) AS ctx FROM evidence GROUP BY 1", "evidence")


@query("faithfulness_words", f"""
SELECT query_id, round(len(list_filter(ws, lambda w: contains(ctx, w))) / len(ws), 6) AS faithfulness FROM (SELECT query_id, {WORDS.format('lower(answer)')} AS ws, ctx FROM qa JOIN contexts USING (query_id))""", "qa", "contexts")
def _(c):
    return M.faithfulness_words(B.qa(c), B.evidence(c))


@query("faithfulness_claims", rf"""
SELECT query_id, len(ps)::INT AS claims, good::INT AS supported, round(good / greatest(len(ps), 1), 3) AS faithfulness FROM (
  SELECT query_id, ps, len(list_filter(ps, lambda p: len(list_filter({WORDS.format('p')}, lambda w: contains(ctx, w))) / len({WORDS.format('p')}) >= 0.3)) AS good FROM (
    SELECT query_id, ctx, list_filter(list_transform(string_split(lower(answer), '.'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ps FROM qa JOIN contexts USING (query_id)))""", "qa", "contexts")
def _(c):
    return M.faithfulness_claims(B.qa(c), B.evidence(c))


@query("answer_relevance", f"""
SELECT query_id, round(s, 6) AS relevance, round(s, 3) AS relevance_rounded, CASE WHEN s >= 0.7 THEN 'most' WHEN s >= 0.3 THEN 'partial' ELSE 'low' END AS grade FROM (
  SELECT conv_id * 1000 + turn AS query_id, CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, a)) / len(q) END AS s FROM (
    SELECT u.conv_id, u.turn, list_distinct({WORDS.format('lower(u.text)')}) AS q, list_distinct({WORDS.format('lower(a.text)')}) AS a
    FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'))""")
def _(c):
    pairs = T.qa_pairs(c.turns).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "question", "answer")
    return M.answer_relevance(pairs)


@query("contextual_precision_lexical", f"""
SELECT query_id, round(least(1.0, avg(s)), 3) AS precision, count(*) FILTER (s >= 0.3) AS relevant, count(*) FILTER (s < 0.3) AS irrelevant FROM (
  SELECT query_id, len(list_intersect(q, t)) / len(q) AS s FROM (SELECT query_id, list_distinct({WORDS.format('lower(question)')}) AS q, {WORDS.format('lower(text)')} AS t FROM qa JOIN evidence USING (query_id))) GROUP BY 1""", "qa", "evidence")
def _(c):
    return M.contextual_precision(B.qa(c), B.evidence(c))


@query("contextual_recall_lexical", f"""
SELECT query_id, len(ws)::INT AS total, round(len(list_filter(ws, lambda w: contains(ctx, w))) / greatest(len(ws), 1), 3) AS recall FROM (
  SELECT query_id, ctx, list_filter(list_transform({WORDS.format('lower(answer)')}, lambda w: trim(w, '.,!?;:')), lambda w: length(w) >= 3) AS ws FROM qa JOIN contexts USING (query_id))""", "qa", "contexts")
def _(c):
    return M.contextual_recall(B.qa(c), B.evidence(c))


def term_sql(text: str, stop, n: int = 3) -> str:
    return (rf"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+(?:-+[\p{{L}}\p{{N}}_]+)*'), "
            rf"lambda t: regexp_matches(t, '^[a-z0-9][a-z0-9_-]{{{n - 1},}}$') AND t NOT IN ({quoted(stop)})))")


cte("hall_claims", rf"""SELECT query_id, i, {term_sql('c', CLAIM_STOP)} AS ts FROM (SELECT query_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (
  SELECT query_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(answer, '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), ';[ \n\t\r]+', chr(1), 'g'), chr(1)),
    lambda x: len({WORDS.format('x')}) >= 5) AS l FROM qa))""", "qa")
cte("hall", f"""SELECT query_id, count(*) AS claims, count(*) FILTER (best < 0.12) AS unsupported, max(1.0 - best) FILTER (best < 0.12) AS worst FROM (
  SELECT query_id, i, max(CASE WHEN len(ts) = 0 THEN 0 ELSE len(list_intersect(ts, et)) / len(ts) END) AS best FROM hall_claims JOIN (SELECT query_id, {term_sql('text', CLAIM_STOP)} AS et FROM evidence) USING (query_id) GROUP BY 1, 2) GROUP BY 1""", "hall_claims", "evidence")
cte("halls", """SELECT query_id, coalesce(claims, 0) AS claims, coalesce(unsupported, 0) AS unsupported, round(coalesce(worst, 0.0), 6) AS hallucination,
  round((coalesce(claims, 0) - coalesce(unsupported, 0)) / greatest(coalesce(claims, 0), 1), 6) AS supported_ratio, coalesce(worst >= 0.8, false) AS has_hallucinations FROM qa LEFT JOIN hall USING (query_id)""", "hall", "qa")


def _shifted(c):
    """Answers of other questions, so that some claims lack support."""
    a = B.qa(c)
    return a.select("query_id", "question", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("Completely unrelated words stand here now. "), "answer")).otherwise(F.col("answer")).alias("answer"))


@query("hallucination", "SELECT * FROM halls", "halls")
def _(c):
    return M.hallucination(B.qa(c), B.evidence(c))


cte("qa_odd", """SELECT query_id, question, CASE WHEN query_id % 2 = 0 THEN 'Completely unrelated words stand here now. ' || answer ELSE answer END AS answer FROM qa""", "qa")


@query("hallucination_unsupported", f"""
SELECT query_id, count(*) AS claims, count(*) FILTER (best < 0.12) AS unsupported, round(coalesce(max(1.0 - best) FILTER (best < 0.12), 0.0), 6) AS hallucination, round(count(*) FILTER (best >= 0.12) / count(*), 6) AS supported_ratio,
  coalesce(max(1.0 - best) FILTER (best < 0.12) >= 0.8, false) AS has_hallucinations FROM (
  SELECT query_id, i, max(CASE WHEN len(ts) = 0 THEN 0 ELSE len(list_intersect(ts, et)) / len(ts) END) AS best FROM (
    SELECT * FROM hall_claims UNION ALL SELECT query_id, 0, {term_sql("'Completely unrelated words stand here now.'", CLAIM_STOP)} FROM qa WHERE query_id % 2 = 0)
  JOIN (SELECT query_id, {term_sql('text', CLAIM_STOP)} AS et FROM evidence) USING (query_id) GROUP BY 1, 2) GROUP BY 1""", "hall_claims", "qa", "evidence")
def _(c):
    return M.hallucination(_shifted(c), B.evidence(c))


cte("ans", f"""SELECT query_id, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, a)) / len(q) END AS r, CASE WHEN len(e) = 0 OR len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, e)) / len(a) END AS c,
  array_to_string(list_sort(list_filter(q, lambda t: NOT list_contains(a, t))), ' ') AS missing FROM (SELECT query_id, {term_sql('question', ANSWER_STOP)} AS q, {term_sql('answer', ANSWER_STOP)} AS a FROM qa) JOIN
  (SELECT query_id, list_distinct(flatten(list({term_sql('text', ANSWER_STOP)}))) AS e FROM evidence GROUP BY 1) USING (query_id)""", "qa", "evidence")


@query("answer_check", """
SELECT query_id, round(r, 6) AS relevance, round(c, 6) AS completeness, c >= 0.45 AS grounded, missing, r >= 0.45 AND c >= 0.45 AS acceptable FROM ans""", "ans")
def _(c):
    return M.answer_check(B.qa(c), B.evidence(c)).withColumn("missing", F.array_join("missing", " "))


cte("rcheck", """SELECT query_id, count(*) AS items, count(*) FILTER (relevance >= 0.45) AS usable, round(avg(relevance), 6) AS relevance, avg(relevance) AS m,
  CASE WHEN count(*) <= 1 THEN 1.0 ELSE round(count(DISTINCT o) / count(*), 6) END AS diversity FROM (SELECT query_id, relevance, array_to_string(words[1:50], ' ') AS o FROM evidence JOIN tok USING (chunk_id)) GROUP BY 1""", "evidence", "tok")


@query("retrieval_check", """
SELECT query_id, items, usable, relevance, diversity, concat_ws('|', CASE WHEN m < 0.45 THEN 'low relevance' END, CASE WHEN diversity < 0.2 THEN 'low diversity' END) AS reasons,
  m >= 0.45 AND diversity >= 0.2 AND usable > 0 AS sufficient FROM rcheck""", "rcheck")
def _(c):
    return M.retrieval_check(c.queries, B.evidence(c))


cte("gaps", f"""SELECT query_id, CASE WHEN len(ts) = 0 THEN least(1.0, usable / 3.0) ELSE len(list_filter(ts, lambda t: contains(ctx, t))) / len(ts) END AS cov, array_to_string(list_sort(list_filter(ts, lambda t: NOT contains(ctx, t))), ' ') AS missing FROM
  (SELECT item_id AS query_id, {term_sql('text', GAP_STOP)} AS ts FROM benchmark) JOIN (SELECT query_id, count(*) AS usable, string_agg({sq('lower(text)')}, ' ') AS ctx FROM evidence WHERE relevance >= 0.3 GROUP BY 1) USING (query_id)""", "evidence")
cte("gap_levels", """SELECT *, CASE WHEN cov >= 0.55 THEN NULL WHEN cov < 0.2 THEN 'critical' WHEN cov < 0.35 THEN 'high' ELSE 'medium' END AS severity FROM gaps""", "gaps")


@query("coverage_gaps", "SELECT query_id, round(cov, 6) AS coverage, missing, severity, severity IS NOT NULL AS has_gaps FROM gap_levels", "gap_levels")
def _(c):
    return M.coverage_gaps(c.queries, B.evidence(c)).withColumn("missing", F.array_join("missing", " "))


cte("critic", """SELECT query_id, round(0.4 * (1 - hallucination) + 0.2 * (0.6 * round(m, 6) + 0.4 * diversity) + 0.25 * (0.55 * round(r, 6) + 0.45 * round(c, 6)) + 0.15 * round(cov, 6), 6) AS score,
  has_hallucinations AS h, r >= 0.45 AND c >= 0.45 AS ok, coalesce(severity = 'critical', false) AS crit, NOT (m >= 0.45 AND diversity >= 0.2 AND usable > 0) OR severity IS NOT NULL AS again
  FROM halls JOIN rcheck USING (query_id) JOIN ans USING (query_id) JOIN gap_levels USING (query_id)""", "halls", "rcheck", "ans", "gap_levels")


@query("critic_score", """
SELECT query_id, score, a AS accepted, CASE WHEN a THEN 'pass' WHEN crit THEN 'critical' WHEN h OR score < 0.45 THEN 'high' WHEN score < 0.6 THEN 'medium' ELSE 'low' END AS severity, again AS needs_retrieval, h OR NOT ok AS needs_regeneration,
  CASE WHEN a THEN 'accept' WHEN again THEN 'retrieve' WHEN h OR NOT ok THEN 'regenerate' ELSE 'stop' END AS action FROM (SELECT *, score >= 0.72 AND NOT h AND ok AND NOT crit AS a FROM critic)""", "critic")
def _(c):
    return M.critic_score(c.queries, B.qa(c), B.evidence(c))


# -- retrieval quality ------------------------------------------------------------------

CONF = """SELECT query_id, round(avg(s), 6) AS score_strength, round(CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - stddev_pop(s))) END, 6) AS score_consistency, round(least(1.0, count(*) / 3.0), 6) AS evidence_density,
  round(least(1.0, 0.5 * avg(s) + 0.25 * CASE WHEN count(*) = 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - stddev_pop(s))) END + 0.25 * least(1.0, count(*) / 3.0)), 6) AS confidence FROM ({0}) GROUP BY 1"""


@query("retrieval_confidence", CONF.format("SELECT query_id, CASE WHEN score BETWEEN 0 AND 1 THEN score WHEN score >= -1 AND score < 0 THEN (score + 1) / 2 ELSE 1 - 1 / (1 + score) END AS s FROM runs"), "runs")
def _(c):
    return S.run_confidence(B.runs(c))


cte("lexrel", f"""SELECT query_id, chunk_id, len(q)::INT AS query_terms, len(list_intersect(q, t))::INT AS matched_terms, round(len(list_intersect(q, t)) / len(q), 6) AS lexical_relevance FROM (
  SELECT query_id, chunk_id, w.ts AS q, regexp_extract_all(lower(e.text), '{APOS}') AS t FROM evidence e JOIN wq w USING (query_id))""", "evidence", "wq")


@query("lexical_relevance", "SELECT * FROM lexrel", "lexrel")
def _(c):
    return M.lexical_relevance(c.queries, B.evidence(c))


cte("evconf", CONF.format("SELECT query_id, relevance AS s FROM evidence"), "evidence")
cte("evdiv", """SELECT query_id, round(1.0 - coalesce(dup / (n * (n - 1) / 2), 0), 6) AS diversity, n FROM (SELECT query_id, count(*) AS n FROM ev_words GROUP BY 1) LEFT JOIN (SELECT a.query_id, count(*) AS dup FROM ev_words a JOIN ev_words b
  ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id WHERE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) >= 0.9 - 1e-9 GROUP BY 1) USING (query_id)""", "ev_words")
cte("quality", """SELECT query_id, n AS results, rel, confidence, round(covered_terms / total_terms, 6) AS coverage, diversity, round(0.4 * rel + 0.25 * confidence + 0.25 * round(covered_terms / total_terms, 6) + 0.1 * diversity, 6) AS quality
  FROM (SELECT query_id, avg(lexical_relevance) AS rel FROM lexrel GROUP BY 1) JOIN evconf USING (query_id) JOIN wcov USING (query_id) JOIN evdiv USING (query_id)""", "lexrel", "evconf", "wcov", "evdiv")


@query("retrieval_quality", """
SELECT query_id, results, round(rel, 6) AS relevance, confidence, coverage, diversity, quality, ok AS sufficient, CASE WHEN ok THEN 'evidence_sufficient' WHEN coverage < 0.55 THEN 'insufficient_query_coverage' WHEN confidence < 0.6 THEN 'low_retrieval_confidence' ELSE 'low_evidence_quality' END AS reason,
  round(0.45 * quality + 0.35 * coverage + 0.2 * confidence, 6) AS sufficiency, NOT ok AND quality >= 0.6 AS rerank, NOT ok AS retrieve_again, quality < 0.35 OR coverage < 0.275 AS replan
FROM (SELECT *, quality >= 0.65 AND coverage >= 0.55 AND confidence >= 0.6 AS ok FROM quality)""", "quality")
def _(c):
    return M.retrieval_quality(c.queries, B.evidence(c))


@query("score_spread", """
SELECT query_id, n, round(best, 6) AS best, round(mean, 6) AS mean, round(spread, 6) AS spread, round(least(1.0, 0.6 * best + 0.4 * mean + least(0.1, n / 100.0)), 6) AS confidence, ok AS sufficient, rr AS needs_rerank, NOT ok AND NOT rr AS needs_replan FROM (
  SELECT *, CASE WHEN best < 0.3 THEN false WHEN n < 2 THEN best >= 0.7 ELSE mean >= 0.3 END AS ok, n >= 3 AND best < 0.7 AND mean >= 0.3 AND best > mean AS rr FROM (
    SELECT query_id, count(*) AS n, max(s) AS best, avg(s) AS mean, max(s) - min(s) AS spread FROM (SELECT query_id, least(1.0, score / 60) AS s FROM runs) GROUP BY 1))""", "runs")
def _(c):
    return M.score_spread(B.runs(c).withColumn("relevance", F.col("score") / 60))


@query("confidence_policy", """
SELECT event_id, confidence, confidence >= 0.8 AS confident FROM (SELECT event_id, round(0.2 * least(1.0, value / 100) + 0.25 * (user_id % 10) / 9.0 + 0.2 * (event_id % 7) / 6.0 + 0.15 * (CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END) + 0.2 * 0.9, 4) AS confidence FROM events)""")
def _(c):
    s = c.events.select("event_id", (F.col("value") / 100).alias("retrieval"), ((F.col("user_id") % 10) / 9.0).alias("relevance"), ((F.col("event_id") % 7) / 6.0).alias("coverage"),
                        F.when(F.col("failed"), float("nan")).otherwise(1.0).alias("consistency"), F.lit(0.9).alias("groundedness"))
    return M.confidence_policy(s).select("event_id", "confidence", "confident")


def _spans(c):
    return c.events.withColumnRenamed("value", "duration_ms").withColumnRenamed("user_id", "trace_id").withColumnRenamed("event_type", "stage")


@query("latency_summary", """
SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms, quantile_disc(value, 0.5) AS median_ms, quantile_disc(value, 0.95) AS p95_ms FROM events GROUP BY 1""")
def _(c):
    return M.latency_summary(_spans(c)).withColumn("median_ms", F.get("q", F.lit(0))).withColumn("p95_ms", F.get("q", F.lit(1))).drop("q")


@query("latency_by_stage", """
SELECT user_id AS trace_id, """ + ", ".join(f"round(sum(value) FILTER (event_type = '{s}'), 4) AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + """, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def _(c):
    return M.latency_by_stage(_spans(c), "trace_id", ["click", "error", "purchase", "signup", "view"])


# -- graph ------------------------------------------------------------------------------

cte("cites", "SELECT DISTINCT o_orderkey AS src, dst FROM (SELECT o_orderkey, unnest([o_orderkey // 2, o_orderkey - 1 - o_orderkey % 13]) AS dst FROM orders) WHERE dst >= 0 AND dst <> o_orderkey AND dst IN (SELECT o_orderkey FROM orders)")
cte("p_authors", "SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS author_id FROM lineitem")
cte("p_topics", "SELECT DISTINCT l_orderkey AS paper_id, p_type AS topic FROM lineitem JOIN part ON p_partkey = l_partkey")
cte("p_methods", "SELECT DISTINCT l_orderkey AS paper_id, p_brand AS method FROM lineitem JOIN part ON p_partkey = l_partkey")
cte("g_edges", """SELECT 'paper:' || paper_id AS src, 'author:' || author_id AS dst, 'authored_by' AS type FROM p_authors UNION ALL SELECT 'paper:' || paper_id, 'topic:' || topic, 'about' FROM p_topics
  UNION ALL SELECT 'paper:' || paper_id, 'method:' || method, 'uses' FROM p_methods UNION ALL SELECT 'paper:' || src, 'paper:' || dst, 'cites' FROM cites""", "p_authors", "p_topics", "p_methods", "cites")
cte("g_nodes", """SELECT 'paper:' || o_orderkey AS id, 'paper' AS type FROM orders UNION ALL SELECT 'author:' || s_suppkey, 'author' FROM supplier UNION ALL SELECT DISTINCT 'topic:' || topic, 'topic' FROM p_topics UNION ALL SELECT DISTINCT 'method:' || method, 'method' FROM p_methods""", "p_topics", "p_methods")


def _graph(c):
    return G.build_graph(c.papers, c.authors, c.paper_authors, c.paper_topics, c.paper_methods, c.citations)


@query("build_graph", """
SELECT 'node' AS part, type, id, NULL::VARCHAR AS other FROM g_nodes UNION ALL SELECT 'edge', type, src, dst FROM g_edges""", "g_nodes", "g_edges")
def _(c):
    nodes, edges = _graph(c)
    return nodes.select(F.lit("node").alias("part"), "type", "id", F.lit(None).cast("string").alias("other")).unionByName(
        edges.select(F.lit("edge").alias("part"), "type", F.col("src").alias("id"), F.col("dst").alias("other")))


@query("traverse", """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT o_orderkey AS src, dst FROM (SELECT o_orderkey, unnest([o_orderkey // 2, o_orderkey - 1 - o_orderkey % 13]) AS dst FROM orders) WHERE dst >= 0 AND dst <> o_orderkey AND dst IN (SELECT o_orderkey FROM orders)),
b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT DISTINCT src AS id, 0 AS depth FROM e WHERE src NOT IN (SELECT dst FROM e) AND src % 2 = 1 UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON b.src = r.id WHERE r.depth < 3)
SELECT id, min(depth) AS depth FROM r GROUP BY 1""")
def _(c):
    edges = c.citations.withColumn("type", F.lit("cites"))
    seeds = edges.join(edges.select(F.col("dst").alias("src")), "src", "left_anti").filter("src % 2 = 1").select(F.col("src").alias("id"))
    return G.traverse(edges, seeds, 3, ["cites"])


@query("node_detail", """
SELECT id, type, coalesce(o, 0)::BIGINT AS out_degree, coalesce(i, 0)::BIGINT AS in_degree, coalesce(nb, 0) AS neighbours, (coalesce(o, 0) + coalesce(i, 0))::BIGINT AS degree FROM g_nodes LEFT JOIN (
  SELECT id, sum(o) AS o, sum(i) AS i, count(DISTINCT other) AS nb FROM (SELECT src AS id, dst AS other, 1 AS o, 0 AS i FROM g_edges UNION ALL SELECT dst, src, 0, 1 FROM g_edges) GROUP BY 1) USING (id)""", "g_nodes", "g_edges")
def _(c):
    return G.node_detail(*_graph(c)).drop("label")


@query("citation_counts", """
SELECT o_orderkey AS paper_id, coalesce(m, 0) AS made, coalesce(r, 0) AS received FROM orders LEFT JOIN (SELECT src, count(*) AS m FROM cites GROUP BY 1) ON src = o_orderkey LEFT JOIN (SELECT dst, count(*) AS r FROM cites GROUP BY 1) ON dst = o_orderkey""", "cites")
def _(c):
    return G.citation_counts(c.papers, c.citations)


@query("coauthors", """
SELECT a.author_id AS src, b.author_id AS dst, 'co_authored_with' AS type, count(*) AS weight FROM p_authors a JOIN p_authors b USING (paper_id) WHERE a.author_id < b.author_id GROUP BY 1, 2""", "p_authors")
def _(c):
    return G.coauthors(c.paper_authors)


@query("cooccurring_topics", """
SELECT a.topic AS a, b.topic AS b, count(*) AS count FROM p_topics a JOIN p_topics b USING (paper_id) WHERE a.topic < b.topic GROUP BY 1, 2""", "p_topics")
def _(c):
    return G.cooccurring_topics(c.paper_topics)


cte("profiles", "SELECT paper_id, list_sort(list(topic)) AS fs FROM p_topics GROUP BY 1", "p_topics")
cte("prof_sim", """SELECT a.fs AS x, b.fs AS y, round(len(list_intersect(a.fs, b.fs)) / (len(a.fs) + len(b.fs) - len(list_intersect(a.fs, b.fs))), 6) AS similarity FROM (SELECT DISTINCT fs FROM profiles) a, (SELECT DISTINCT fs FROM profiles) b""", "profiles")


@query("related_papers", """
WITH h AS (SELECT fs, paper_id FROM profiles QUALIFY row_number() OVER (PARTITION BY fs ORDER BY paper_id) <= 6),
k AS (SELECT x, similarity, paper_id AS related_id FROM prof_sim JOIN h ON h.fs = y WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY x ORDER BY similarity DESC, paper_id) <= 6)
SELECT p.paper_id, related_id, similarity, row_number() OVER (PARTITION BY p.paper_id ORDER BY similarity DESC, related_id) AS rank FROM profiles p JOIN k ON k.x = p.fs WHERE related_id <> p.paper_id QUALIFY rank <= 5""".replace("WITH h", ", h"), "prof_sim")
def _(c):
    return G.related_papers(c.paper_topics.withColumnRenamed("topic", "feature"), 5)


# -- trends -----------------------------------------------------------------------------

cte("years", "SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year FROM orders")
cte("topic_years", "SELECT topic, year, count(*) AS papers FROM p_topics JOIN years USING (paper_id) GROUP BY 1, 2", "p_topics", "years")
DIRECTION = "CASE WHEN growth IS NULL THEN 'emerging' WHEN growth > 0.1 THEN 'rising' WHEN growth < -0.1 THEN 'declining' ELSE 'stable' END AS direction"
cte("topic_growths", f"""SELECT *, {DIRECTION} FROM (SELECT *, round(papers / lag(papers) OVER (PARTITION BY topic ORDER BY year) - 1.0, 6) AS growth FROM topic_years)""", "topic_years")
cte("pair_growths", f"""SELECT *, {DIRECTION} FROM (SELECT *, round(count / lag(count) OVER (PARTITION BY a, b ORDER BY year) - 1.0, 6) AS growth FROM (
  SELECT year, a.topic AS a, b.topic AS b, count(*) AS count FROM p_topics a JOIN p_topics b USING (paper_id) JOIN years USING (paper_id) WHERE a.topic < b.topic GROUP BY ALL))""", "p_topics", "years")


@query("publication_series", """
SELECT strftime(p, '%Y-%m-%d') AS period, coalesce(n, 0) AS papers FROM (SELECT unnest(generate_series((SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 35 MONTH FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS p)
LEFT JOIN (SELECT date_trunc('month', o_orderdate) AS p, count(*) AS n FROM orders GROUP BY 1) USING (p)""")
def _(c):
    return R.publication_series(c.papers, "month", "3Y").withColumn("period", F.date_format("period", "yyyy-MM-dd"))


def _topic_growth(c):
    return R.growth(R.per_period(c.paper_topics, c.papers, "topic"), ["topic"])


@query("topic_growth", "SELECT topic, year, papers, growth, direction FROM topic_growths", "topic_growths")
def _(c):
    return _topic_growth(c)


@query("momentum", "SELECT topic, year, round(avg(growth) OVER (PARTITION BY topic ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS momentum FROM topic_growths", "topic_growths")
def _(c):
    return R.momentum(_topic_growth(c), ["topic"]).select("topic", "year", "momentum")


@query("citation_velocity", """
SELECT paper_id, age, received, so_far::BIGINT AS so_far, round(so_far / (age + 1), 6) AS velocity FROM (SELECT *, sum(received) OVER (PARTITION BY paper_id ORDER BY age) AS so_far FROM (
  SELECT dst AS paper_id, greatest(0, s.year - d.year) AS age, count(*) AS received FROM cites JOIN years s ON s.paper_id = src JOIN years d ON d.paper_id = dst GROUP BY 1, 2))""", "cites", "years")
def _(c):
    return R.citation_velocity(c.citations, c.papers)


@query("term_growth", """
SELECT term, count(*) FILTER (chunk_id % 10 < 5) AS early_df, count(*) FILTER (chunk_id % 10 >= 5) AS late_df, round((count(*) FILTER (chunk_id % 10 >= 5) + 1) / (count(*) FILTER (chunk_id % 10 < 5) + 1) - 1.0, 6) AS growth FROM postings GROUP BY 1""", "postings")
def _(c):
    return R.term_growth(c.documents.select((F.col("document_id") % 10).alias("period"), "text"), 5)


@query("topic_convergence", "SELECT year, a, b, count, growth, direction FROM pair_growths", "pair_growths")
def _(c):
    return R.topic_convergence(c.paper_topics, c.papers)


@query("method_adoption", "SELECT method, count(*) AS papers, round(count(*) / (SELECT count(*) FROM orders), 6) AS adoption FROM p_methods GROUP BY 1", "p_methods")
def _(c):
    return R.method_adoption(c.paper_methods, c.papers)


@query("novelty", """
WITH x AS (SELECT vec_id, vec_id % 12 AS period, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
s AS (SELECT label, period, pos, sum(x) AS x FROM x GROUP BY ALL), g AS (SELECT DISTINCT period AS asof_p FROM x),
m AS (SELECT label, asof_p, pos, sum(x) AS x FROM s JOIN g ON period < asof_p GROUP BY ALL), n AS (SELECT label, asof_p, sqrt(sum(x * x)) AS norm FROM m GROUP BY ALL),
d AS (SELECT vec_id, max(dot / norm) AS near FROM (SELECT x.vec_id, m.label, m.asof_p, sum(x.x * m.x) AS dot FROM x JOIN m ON m.asof_p = x.period AND m.pos = x.pos GROUP BY ALL) JOIN n USING (label, asof_p) GROUP BY 1),
f AS (SELECT vec_id AS item_id, vec_id % 12 AS period, round(1.0 - least(1.0, greatest(0.0, coalesce(near, 0.0))), 6) AS novelty FROM embeddings LEFT JOIN d USING (vec_id))
SELECT *, CASE WHEN novelty >= 0.8 THEN 'very_high' WHEN novelty >= 0.6 THEN 'high' WHEN novelty >= 0.4 THEN 'moderate' ELSE 'low' END AS level FROM f""")
def _(c):
    items = c.vectors.select(F.col("chunk_id").alias("item_id"), (F.col("chunk_id") % 12).cast("int").alias("period"), F.col("label").alias("topic"), F.col("vector").cast("array<double>").alias("vector"))
    return R.novelty(items, 12)


@query("novelty_of_items", """
WITH p AS (SELECT i.vec_id AS item_id, j.vec_id AS earlier_id, round(list_dot_product(i.embedding::DOUBLE[], j.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings i JOIN embeddings j ON j.vec_id % 12 < i.vec_id % 12),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, earlier_id) = 1),
f AS (SELECT vec_id AS item_id, vec_id % 12 AS period, earlier_id, round(1.0 - least(1.0, greatest(0.0, coalesce(similarity, 0.0))), 6) AS novelty
  FROM embeddings LEFT JOIN b ON item_id = vec_id)
SELECT *, CASE WHEN novelty >= 0.8 THEN 'very_high' WHEN novelty >= 0.6 THEN 'high' WHEN novelty >= 0.4 THEN 'moderate' ELSE 'low' END AS level FROM f""")
def _(c):
    items = c.vectors.select(F.col("chunk_id").alias("item_id"), (F.col("chunk_id") % 12).cast("int").alias("period"), "vector")
    return R.novelty_of_items(items, f"{checkpoint_dir(c.spark).rstrip('/')}/novelty-{uuid.uuid4().hex}", 64)


cte("frontier", """SELECT topic, coalesce(momentum, 0.0) AS momentum, coalesce(convergence, 0.0) AS convergence, support, counter_signals, periods FROM (
  SELECT topic, arg_max(momentum, year) AS momentum, sum(papers)::BIGINT AS support, count(*) FILTER (direction = 'declining') AS counter_signals, count(*) AS periods FROM (
    SELECT *, round(avg(growth) OVER (PARTITION BY topic ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS momentum FROM topic_growths) GROUP BY 1)
  LEFT JOIN (SELECT topic, round(avg(growth), 6) AS convergence FROM (SELECT a AS topic, growth FROM pair_growths UNION ALL SELECT b, growth FROM pair_growths) GROUP BY 1) USING (topic)""", "topic_growths", "pair_growths")


@query("frontier_rank", """
SELECT topic, momentum, convergence, support, counter_signals, round(((momentum - min(momentum) OVER ()) / (max(momentum) OVER () - min(momentum) OVER ()) + (convergence - min(convergence) OVER ()) / (max(convergence) OVER () - min(convergence) OVER ())
  + (support - min(support) OVER ()) / (max(support) OVER () - min(support) OVER ())) / 3.0 - 0.1 * counter_signals / periods, 6) AS score FROM frontier""", "frontier")
def _(c):
    return R.frontier_rank(c.paper_topics, c.papers)


@query("gap_cells", """
SELECT topic, method, round(expected, 6) AS expected, observed, lift FROM (SELECT t.topic, m.method, nt * nm / (SELECT count(*) FROM orders) AS expected, coalesce(o, 0) AS observed, round(coalesce(o, 0) / (nt * nm / (SELECT count(*) FROM orders)), 6) AS lift
  FROM (SELECT topic, count(*) AS nt FROM p_topics GROUP BY 1) t CROSS JOIN (SELECT method, count(*) AS nm FROM p_methods GROUP BY 1) m LEFT JOIN (SELECT topic, method, count(*) AS o FROM p_topics JOIN p_methods USING (paper_id) GROUP BY 1, 2) s ON s.topic = t.topic AND s.method = m.method)
WHERE expected >= 5 AND lift < 1.3""", "p_topics", "p_methods")
def _(c):
    return R.gap_cells(c.paper_topics, c.paper_methods, c.papers, 5.0, 1.3)


@query("timeline", "SELECT topic, min(year) AS first, arg_max(year, papers * 10000 - year) AS peak, max(papers) AS peak_papers, max(year) AS last FROM topic_years GROUP BY 1", "topic_years")
def _(c):
    return R.timeline(R.per_period(c.paper_topics, c.papers, "topic"))


@query("landscape", """
SELECT topic, year, o_orderpriority AS provider, grouping_id(topic, year, o_orderpriority)::BIGINT AS level, count(*) AS papers FROM p_topics JOIN years USING (paper_id) JOIN orders ON o_orderkey = paper_id GROUP BY CUBE (topic, year, o_orderpriority)""", "p_topics", "years")
def _(c):
    rows = c.paper_topics.join(c.papers.select("paper_id", "year", "provider"), "paper_id")
    return R.landscape(rows, ["topic", "year", "provider"])


# -- listings ---------------------------------------------------------------------------

cte("coll_items", "SELECT DISTINCT o_custkey AS collection_id, l_partkey AS paper_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")


def _collections(c):
    colls = c.table("customer").select(
        F.col("c_custkey").alias("collection_id"), F.col("c_nationkey").alias("owner_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"),
        (F.col("c_custkey") % 5 == 0).alias("archived"), F.floor("c_acctbal").alias("created"))
    items = c.table("orders").select("o_orderkey", F.col("o_custkey").alias("collection_id")).join(
        c.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("paper_id")), "o_orderkey").select("collection_id", "paper_id").distinct()
    return colls, items


@query("list_collections", """
SELECT c_custkey AS collection_id, c_name AS name, floor(c_acctbal)::BIGINT AS created, coalesce(n, 0) AS paper_count FROM customer LEFT JOIN (SELECT collection_id, count(*) AS n FROM coll_items GROUP BY 1) ON collection_id = c_custkey
WHERE c_nationkey = 7 AND (c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%') AND c_custkey % 5 <> 0 ORDER BY created DESC, collection_id DESC LIMIT 10 OFFSET 10""", "coll_items")
def _(c):
    colls, items = _collections(c)
    found = L.list_collections(colls, items, 7, "1", False).select("collection_id", "name", "created", "paper_count")
    return L.page(found, [F.desc("created"), F.desc("collection_id")], 2, 10)


@query("list_collections_total", "SELECT count(*) AS total FROM customer WHERE c_nationkey = 7 AND (c_name ILIKE '%1%' OR c_mktsegment ILIKE '%1%') AND c_custkey % 5 <> 0")
def _(c):
    return L.total(L.list_collections(*_collections(c), 7, "1", False))


@query("collection_items", """
SELECT paper_id, p_name AS title FROM coll_items JOIN part ON p_partkey = paper_id WHERE collection_id = 11 ORDER BY p_name, paper_id LIMIT 20""", "coll_items")
def _(c):
    papers = c.table("part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))
    return L.page(L.collection_items(_collections(c)[1], papers, 11).select("paper_id", "title"), [F.asc("title"), F.asc("paper_id")])


@query("collection_add", """
SELECT * FROM coll_items UNION SELECT l_suppkey, l_partkey * 2 FROM lineitem WHERE l_suppkey IN (SELECT c_custkey FROM customer) AND l_partkey * 2 IN (SELECT p_partkey FROM part)""", "coll_items")
def _(c):
    colls, items = _collections(c)
    wanted = c.table("lineitem").select(F.col("l_suppkey").alias("collection_id"), (F.col("l_partkey") * 2).alias("paper_id"))
    return L.collection_add(items, wanted, colls, c.table("part").select(F.col("p_partkey").alias("paper_id")))


@query("collection_remove", """
SELECT collection_id, paper_id FROM coll_items WHERE (collection_id, paper_id) NOT IN (SELECT (o_custkey, l_partkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 25)""", "coll_items")
def _(c):
    items = _collections(c)[1]
    lines = c.table("lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("paper_id"))
    gone = c.table("orders").select("o_orderkey", F.col("o_custkey").alias("collection_id")).join(lines, "o_orderkey").select("collection_id", "paper_id").distinct()
    return L.collection_remove(items, gone).select("collection_id", "paper_id")


@query("collection_overlap", """
SELECT paper_id, CASE WHEN count(DISTINCT collection_id) = 2 THEN 'both' WHEN min(collection_id) = 11 THEN 'left' ELSE 'right' END AS side FROM coll_items WHERE collection_id IN (11, 12) GROUP BY 1""", "coll_items")
def _(c):
    return L.collection_overlap(_collections(c)[1], 11, 12)


@query("list_reports", """
SELECT o_orderkey AS report_id, o_orderstatus AS status FROM orders WHERE o_custkey = 11 AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
def _(c):
    reports = c.table("orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated"))
    return L.page(L.list_reports(reports, 11, "F"), [F.desc("updated"), F.desc("report_id")]).select("report_id", "status")


@query("list_documents", "SELECT l_linenumber AS document_id, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7")
def _(c):
    docs = c.table("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("document_id"), "l_partkey", "l_quantity")
    return L.list_documents(docs, 7).drop("paper_id")


@query("list_sections", "SELECT turn AS section_index, role AS title FROM conversations WHERE conv_id = 3")
def _(c):
    return L.list_sections(c.turns.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("section_index"), F.col("role").alias("title")), 3).drop("document_id")


@query("list_chunks", "SELECT i AS chunk_index, text FROM linked WHERE document_id = 5", "linked")
def _(c):
    from folioframe.operators import chunk as K

    return L.list_chunks(K.fixed_chunks(c.documents), 5).select("chunk_index", "text")


# -- events -----------------------------------------------------------------------------

cte("health", """SELECT component, total, total - failed AS successful, failed, round((total - failed) / total, 6) AS success_rate, round(busy / total, 6) AS mean_ms, CASE WHEN failed / total >= 0.5 THEN 'unhealthy' WHEN failed / total >= 0.1 THEN 'degraded' ELSE 'healthy' END AS status FROM (
  SELECT user_id % 10 AS component, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, sum(greatest(0.0, value)) AS busy FROM events GROUP BY 1)""")


def _ops(c):
    return c.events.withColumnRenamed("value", "duration_ms").withColumn("trace_id", F.col("user_id"))


@query("component_health", "SELECT * FROM health", "health")
def _(c):
    return T.component_health(_ops(c))


@query("overall_health", "SELECT count(*) AS components, CASE WHEN count(*) FILTER (status = 'unhealthy') > 0 THEN 'unhealthy' WHEN count(*) FILTER (status = 'degraded') > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM health", "health")
def _(c):
    return T.overall_health(T.component_health(_ops(c)))


@query("trace_rollup", """
SELECT user_id AS trace_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS spans, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS busy_ms,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3) AS duration_s FROM events GROUP BY 1""")
def _(c):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return T.trace_rollup(_ops(c)).withColumn("started", F.date_format("started", fmt)).withColumn("ended", F.date_format("ended", fmt))


@query("recent_events", "SELECT user_id AS trace_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_type = 'click' QUALIFY rank <= 5")
def _(c):
    return T.recent_events(_ops(c), 5, kind="click").select("trace_id", "event_id", "rank")


@query("strategy_performance", """
SELECT event_type || (user_id % 3) AS strategy, count(*) AS executions, count(*) FILTER (value >= 5) AS successes, round(count(*) FILTER (value >= 5) / count(*), 6) AS success_rate, round(avg(value), 6) AS mean_score, round(avg(value * 2), 6) AS mean_ms,
  round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') / avg(value) FILTER (ts < TIMESTAMP '2024-01-16') - 1.0, 6) AS improvement,
  CASE WHEN round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') / avg(value) FILTER (ts < TIMESTAMP '2024-01-16') - 1.0, 6) > 0.05 THEN 'improving' WHEN round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') / avg(value) FILTER (ts < TIMESTAMP '2024-01-16') - 1.0, 6) < -0.05 THEN 'declining' ELSE 'stable' END AS trend
FROM events GROUP BY 1""")
def _(c):
    e = c.events.select("ts", F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("strategy"), F.col("value").alias("score"), (F.col("value") * 2).alias("duration_ms"), (F.col("value") < 5).alias("failed"))
    return T.strategy_performance(e, F.to_timestamp(F.lit("2024-01-16 00:00:00")))


@query("history_window", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 3")
def _(c):
    return T.history_window(c.turns, 3).select("conv_id", "turn", "back")


@query("qa_pairs", """
SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS after, lead(turn) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND after = 'assistant' AND nt = turn + 1""")
def _(c):
    return T.qa_pairs(c.turns)


# -- streams ----------------------------------------------------------------------------
# Closed windows only: those the watermark (latest event less one day) has passed.

CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


def _stream(c):
    return ST.events(ST.read_table(c.spark, c.root, "events"))


def _stamp(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


@query("stream_ingest", "SELECT identity, min(arrival) AS arrival, arg_min(provider, arrival) AS provider FROM identified GROUP BY 1", "identified")
def _(c):
    feed = c.records_of(ST.read_table(c.spark, c.root, "orders"))
    return ST.run_ingest(with_identity(feed.withColumn("year", ids.year(F.col("published"))))).select("identity", "arrival", "provider")


@query("stream_index", "SELECT term, chunk_id, tf, dl FROM postings", "postings")
def _(c):
    docs = ST.read_table(c.spark, c.root, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return ST.run_index(docs).select("term", "chunk_id", "tf", "dl")


@query("stream_health", f"""
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS start, user_id % 10 AS component, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, round(sum(value) / count(*), 6) AS mean_ms,
  CASE WHEN count(*) FILTER (event_type = 'error') / count(*) >= 0.5 THEN 'unhealthy' WHEN count(*) FILTER (event_type = 'error') / count(*) >= 0.1 THEN 'degraded' ELSE 'healthy' END AS status
FROM (SELECT *, date_trunc('day', ts) AS d FROM events) WHERE d + INTERVAL 1 DAY <= {CLOSED} GROUP BY d, 2""")
def _(c):
    return _stamp(ST.drain(ST.stream_health(_stream(c))), "start")


@query("stream_trend", f"""
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (
  SELECT event_type, d - INTERVAL (k) DAY AS d FROM (SELECT *, date_trunc('day', ts) AS d FROM events) CROSS JOIN (SELECT unnest([0, 1]) AS k)) WHERE d + INTERVAL 2 DAY <= {CLOSED} GROUP BY d, 2""")
def _(c):
    return _stamp(ST.drain(ST.stream_trend(_stream(c))), "start")


@query("stream_sessions", f"""
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS end, user_id, count(*) AS n FROM (
  SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= {CLOSED}""")
def _(c):
    return _stamp(ST.drain(ST.stream_sessions(_stream(c))), "start", "end")


@query("stream_enrich", "SELECT event_id, event_type, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id")
def _(c):
    segments = c.table("customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return ST.drain(ST.stream_enrich(_stream(c), segments, "user_id")).select("event_id", "event_type", "c_mktsegment")
