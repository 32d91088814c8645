"""Query-table operators, context packing and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions.lexicon import (
    ASSERTION, CONNECTORS, COVERAGE_STOP, CRITERIA, EXPANSIONS, INTENT_KEYWORDS, INTENT_PATTERNS, NEGATION, NEGATIVE_PHRASES, PART_SUFFIX,
    POSITIVE_PHRASES, QUERY_STOP, SEMANTIC_PATTERNS,
)
from folioframe.operators import evidence as V
from folioframe.operators import pack as P
from folioframe.operators import questions as Q
from folioframe.operators import search as S
from folioframe.plans import base as B
from folioframe.plans.ingest import sq
from folioframe.plans.registry import cte, query
from folioframe.plans.retrieval import _hash_vectors


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# -- questions --------------------------------------------------------------------------

OPENINGS = ("What is the method of", "Compare rag vs bm25:", "Explain why", "recent research and benchmark datasets", 'fix "the  bug" in llm code 2024',
            "how does x affects y and z relationship between", "", "difference between nlp and ML", "summary of embedding")


def _asked(c):
    k = F.col("query_id")
    opening = F.get(F.array(*[F.lit(o) for o in OPENINGS]), (k % len(OPENINGS)).cast("int"))
    return c.questions.select("query_id", F.concat(opening, F.lit(" "), "text").alias("text"))


cte("asked", f"""SELECT query_id, o || ' ' || text AS text FROM (
  SELECT conv_id * 1000 + turn AS query_id, text, [{quoted(OPENINGS)}][(conv_id * 1000 + turn) % {len(OPENINGS)} + 1] AS o FROM conversations WHERE role = 'user')""")


def counted(patterns, test: str) -> str:
    return " + ".join(f"({test.format(p)})::INT" for p in patterns)


FAMILIES = ", ".join("{'hits': " + " + ".join("regexp_matches(t, '" + p + "')::INT" for p in ps) + f", 'priority': {7 - i}, 'name': '{n}'}}" for i, (n, ps) in enumerate(INTENT_PATTERNS.items()))


@query("classify_queries", f"""
SELECT query_id, intent, confidence, signals, intent IN ('comparative', 'literature', 'multi_hop') AS needs_many_documents, intent IN ('comparative', 'literature') AS needs_broad_search, intent = 'multi_hop' AS needs_many_steps FROM (
  SELECT query_id, CASE WHEN t = '' THEN 'general' WHEN top.hits = 0 THEN 'factual' ELSE top.name END AS intent, top.hits AS signals,
    CASE WHEN t = '' THEN 0.0 WHEN top.hits = 0 THEN 0.55 ELSE least(0.95, round(0.6 + 0.08 * top.hits, 6)) END::DOUBLE AS confidence FROM (
    SELECT query_id, t, list_max([{FAMILIES}]) AS top FROM (SELECT query_id, {sq('lower(text)')} AS t FROM asked)))""", "asked")
def _(c):
    return Q.classify_queries(_asked(c))


KINDS = ", ".join("{'hits': " + " + ".join(f"contains(t, '{w}')::INT" for w in ws) + f", 'place': {-i}, 'name': '{n}'}}" for i, (n, ws) in enumerate(INTENT_KEYWORDS.items()))


@query("score_intents", f"""
SELECT query_id, CASE WHEN total = 0 THEN 'factual' ELSE top.name END AS intent, top.hits AS hits, CASE WHEN total = 0 THEN 0.0 ELSE round(top.hits / total, 2) END AS confidence FROM (
  SELECT query_id, list_max(s) AS top, list_sum(list_transform(s, lambda x: x.hits)) AS total FROM (SELECT query_id, [{KINDS}] AS s FROM (SELECT query_id, lower(text) AS t FROM asked)))""", "asked")
def _(c):
    return Q.score_intents(_asked(c))


TERM = Q.TERM
FIRST = "list_filter({0}, lambda v, i: list_position(list_transform({0}, lambda w: lower(w)), lower(v)) = i)"
cte("termed", rf"""SELECT *, {FIRST.format('terms')} AS keywords FROM (SELECT query_id, text,
  list_filter(regexp_extract_all(text, '{TERM}'), lambda t: lower(t) NOT IN ({quoted(QUERY_STOP)}) AND length(t) > 1) AS terms,
  list_filter(list_transform(regexp_extract_all(text, '"([^"]+)"', 1), lambda p: trim(p)), lambda p: p <> '') AS phrases FROM asked)""", "asked")


@query("query_terms", "SELECT query_id, array_to_string(terms, '|') AS terms, array_to_string(keywords, '|') AS keywords, array_to_string(phrases, '|') AS phrases FROM termed", "termed")
def _(c):
    return Q.query_terms(_asked(c)).select("query_id", *[F.array_join(n, "|").alias(n) for n in ("terms", "keywords", "phrases")])


@query("route_queries", rf"""
SELECT query_id, semantic, keyword, CASE WHEN t = '' THEN 'hybrid' WHEN semantic >= 0.6 THEN 'dense' WHEN n <= 4 AND keyword >= 0.75 THEN 'bm25' ELSE 'hybrid' END AS mode,
  CASE WHEN t = '' THEN 1.0 WHEN semantic >= 0.6 THEN semantic WHEN n <= 4 AND keyword >= 0.75 THEN keyword ELSE greatest(semantic, keyword, 0.5) END AS confidence FROM (
  SELECT query_id, t, len(ws) AS n, CASE WHEN hits = 0 THEN 0.0 ELSE least(1.0, round(0.45 + 0.12 * hits, 6)) END::DOUBLE AS semantic,
    CASE WHEN len(ws) = 0 THEN 0.0 ELSE least(1.0, round(least(0.45, 0.15 * len(list_filter(ws, lambda w: regexp_matches(w, '[\p{{N}}_-]')))) + CASE WHEN regexp_matches(t, '["'']') THEN 0.25 ELSE 0 END
      + CASE WHEN len(ws) <= 3 THEN 0.3 WHEN len(ws) <= 5 THEN 0.15 ELSE 0 END, 6)) END::DOUBLE AS keyword FROM (
    SELECT query_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+(?:-+[\p{{L}}\p{{N}}_]+)*') AS ws, {" + ".join(f"regexp_matches(lower(t), '{p}')::INT" for p in SEMANTIC_PATTERNS)} AS hits
    FROM (SELECT query_id, {sq('text')} AS t FROM asked)))""", "asked")
def _(c):
    return Q.route_queries(_asked(c))


EXPAND = "MAP {" + ", ".join(f"'{k}': [{quoted(vs)}]" for k, vs in EXPANSIONS.items()) + "}"
cte("expanded", f"""SELECT query_id, keywords, phrases, text, {FIRST.format('e')} AS extra FROM (
  SELECT *, list_transform(flatten(list_transform(keywords, lambda k: coalesce({EXPAND}[lower(k)], []))), lambda x: x) AS e FROM termed)""", "termed")


@query("expand_queries", f"""
SELECT query_id, (generate_subscripts(l, 1) - 1)::INT AS variant, unnest(l) AS search_text FROM (SELECT query_id, ({FIRST.format('texts')}) AS l FROM (
  SELECT query_id, list_filter([{sq('text')}, array_to_string(keywords, ' '), array_to_string({FIRST.format('ke')}, ' '), array_to_string({FIRST.format('pk')}, ' ')], lambda x: x <> '') AS texts FROM (
    SELECT *, list_concat(keywords, extra) AS ke, list_concat(phrases, keywords) AS pk FROM expanded)))""", "expanded")
def _(c):
    return Q.expand_queries(_asked(c))


@query("multi_queries", """
SELECT conv_id * 1000 + turn AS query_id, i::INT AS variant, text || ['', ' explanation', ' evidence'][i + 1] AS search_text FROM conversations CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) WHERE role = 'user'""")
def _(c):
    return Q.multi_queries(c.questions)


SPLIT = "CASE " + " ".join(f"WHEN contains(low, '{k}') THEN list_filter(list_transform(string_split(low, '{k}'), lambda p: trim(p)), lambda p: p <> '')" for k in CONNECTORS) + " ELSE [t] END"
ANY = " OR ".join(f"contains(low, '{k}')" for k in CONNECTORS)


@query("decompose_queries", f"""
SELECT query_id, (generate_subscripts(l, 1) - 1)::INT AS part, unnest(l) AS sub_query FROM (
  SELECT query_id, list_concat(list_transform({SPLIT}, lambda p: p || ' {PART_SUFFIX}'),
    CASE WHEN ({ANY}) AND (contains(low, 'compare') OR contains(low, 'difference') OR contains(low, ' vs ')) THEN ['Compare: ' || t] ELSE [] END) AS l FROM (
    SELECT query_id, trim(text) AS t, lower(trim(text)) AS low FROM asked))""", "asked")
def _(c):
    return Q.decompose_queries(_asked(c))


# -- packing ----------------------------------------------------------------------------

SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')), lambda x: x <> '')"
WORDS = r"list_filter(string_split_regex({0}, '[ \n\t\r]+'), lambda w: w <> '')"
TOKENS = r"CASE WHEN {0} = '' THEN 0 ELSE greatest(1, ceil(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')) / 0.75)) END::INT"
cte("top_sents", f"""SELECT query_id, chunk_id, CASE WHEN len(ss) <= 3 THEN {sq('text')} ELSE array_to_string(list_transform(list_sort(list_transform(
    list_sort(list_transform(ss, lambda s, i: {{'w': -len({WORDS.format('s')}), 'i': i, 'p': list_position(ss, s), 's': s}}))[1:3], lambda x: {{'p': x.p, 'i': x.i, 's': x.s}})), lambda x: x.s), ' ') END AS compressed
  FROM (SELECT query_id, chunk_id, text, {SENT.format('text')} AS ss FROM evidence)""", "evidence")


@query("top_sentences", f"SELECT query_id, chunk_id, compressed, {TOKENS.format('compressed')} AS tokens FROM top_sents", "top_sents")
def _(c):
    return P.top_sentences(B.evidence(c)).select("query_id", "chunk_id", "compressed", "tokens")


@query("similarity_cut", "SELECT query_id, chunk_id, rank, h.score AS similarity FROM runs JOIN hash_dense h USING (query_id, chunk_id) WHERE h.score >= 0.55", "runs", "hash_dense")
def _(c):
    q, d = _hash_vectors(c)
    return P.similarity_cut(B.runs(c).drop("score"), q, d, 0.55)


def _sized(c):
    from folioframe.functions import text as X

    return B.evidence(c).select("query_id", "chunk_id", "score", X.tokens_by_matches(F.col("text")).alias("tokens"))


cte("packed", f"""SELECT query_id, chunk_id, tokens, kept FROM (
  WITH RECURSIVE s AS MATERIALIZED (SELECT query_id, chunk_id, tokens, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS i FROM (
    SELECT query_id, chunk_id, score, {TOKENS.format('text')} AS tokens FROM evidence)),
  r AS (SELECT query_id, chunk_id, i, tokens, CASE WHEN tokens <= 600 THEN tokens ELSE 0 END AS used, tokens <= 600 AS kept FROM s WHERE i = 1 UNION ALL
    SELECT s.query_id, s.chunk_id, s.i, s.tokens, r.used + CASE WHEN r.used + s.tokens <= 600 THEN s.tokens ELSE 0 END, r.used + s.tokens <= 600 FROM r JOIN s ON s.query_id = r.query_id AND s.i = r.i + 1)
  SELECT * FROM r)""", "evidence")


@query("pack_budget", "SELECT query_id, chunk_id, tokens, kept FROM packed", "packed")
def _(c):
    return P.pack_budget(_sized(c), 600)


@query("compression_report", """
SELECT query_id, sum(tokens)::BIGINT AS tokens_before, sum(CASE WHEN kept THEN tokens ELSE 0 END)::BIGINT AS tokens_after,
  CASE WHEN sum(tokens) > 0 THEN round(sum(CASE WHEN kept THEN tokens ELSE 0 END) / sum(tokens), 6) ELSE 1.0 END AS ratio, count(*) FILTER (NOT kept) AS removed FROM packed GROUP BY 1""", "packed")
def _(c):
    return P.compression_report(P.pack_budget(_sized(c), 600))


@query("order_context", """
SELECT query_id, chunk_id, source, best, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, source, chunk_id) AS place FROM (
  SELECT *, max(score) OVER (PARTITION BY query_id, source) AS best FROM evidence)""", "evidence")
def _(c):
    return P.order_context(B.evidence(c).withColumn("chunk_index", F.col("chunk_id"))).select("query_id", "chunk_id", "source", "best", "place")


@query("truncate_context", f"""
SELECT doc_id AS chunk_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 1000) || '...' END AS by_characters,
  CASE WHEN {TOKENS.format('text')} <= 200 THEN text ELSE array_to_string(({WORDS.format('text')})[1:150], ' ') END AS by_tokens FROM documents""")
def _(c):
    return c.chunks.select("chunk_id", P.truncate_characters(F.col("text")).alias("by_characters"), P.truncate_tokens(F.col("text"), 200).alias("by_tokens"))


# -- claims and scores ------------------------------------------------------------------

CLEAN_CLAIM = "list_filter(list_transform(" + SENT.format("text") + ", lambda s: regexp_replace(" + sq("s") + ", '[.!?;:]+$', '')), lambda s: length(s) >= 30 AND NOT regexp_matches(lower(s), '^(figure |table |reference |references |http://|https://)'))"
cte("claim_docs", f"""SELECT query_id, rank, chunk_id, {FIRST.format('cs')} AS cs, round(0.7 * relevance + 0.2 * CASE WHEN length(trim(text)) < 50 THEN 0.5 WHEN length(trim(text)) < 100 THEN 0.75 ELSE 1 END + 0.1, 4) AS confidence
  FROM (SELECT *, {CLEAN_CLAIM} AS cs FROM evidence)""", "evidence")
cte("claims", """SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank, place) - 1)::INT AS claim_index, chunk_id, claim, confidence FROM (
  SELECT * FROM (SELECT query_id, rank, chunk_id, confidence, unnest(cs) AS claim, generate_subscripts(cs, 1) AS place FROM claim_docs)
  QUALIFY row_number() OVER (PARTITION BY query_id, lower(claim) ORDER BY rank, place) = 1)""", "claim_docs")


def claims(c):
    return V.extract_claims(B.evidence(c))


@query("extract_claims", "SELECT * FROM claims", "claims")
def _(c):
    return claims(c)


LENGTH_SQL = "CASE WHEN length(text) = 0 THEN 0.0 WHEN length(trim(text)) < 20 THEN 0.2 WHEN length(trim(text)) < 100 THEN 0.5 WHEN length(trim(text)) < 300 THEN 0.75 ELSE 1.0 END"
cte("scored_rows", f"""SELECT *, round(0.3 * relevance + 0.35 * rerank_score + 0.2 * {LENGTH_SQL} + 0.15 * least(1.0, (1 + (title IS NOT NULL)::INT + (document_id IS NOT NULL)::INT) / 4.0), 6) AS evidence_score FROM (
  SELECT e.*, query_id * 100 + rank AS row_id, e.relevance * 0.5 AS rerank_score, CASE WHEN chunk_id % 2 = 0 THEN lang END AS title, CASE WHEN chunk_id % 3 = 0 THEN chunk_id // 4 END AS document_id FROM evidence e)""", "evidence")


def _scored(c):
    k = F.col("chunk_id")
    rows = B.evidence(c).withColumns({
        "row_id": F.col("query_id") * 100 + F.col("rank"), "retrieval_score": F.col("relevance"), "rerank_score": F.col("relevance") * 0.5,
        "title": F.when(k % 2 == 0, F.col("lang")), "document_id": F.when(k % 3 == 0, F.floor(k / 4))})
    return V.score_evidence(rows)


@query("score_evidence", "SELECT query_id, chunk_id, evidence_score FROM scored_rows", "scored_rows")
def _(c):
    return _scored(c).select("query_id", "chunk_id", "evidence_score")


cte("doubled", """SELECT query_id, row_id * 2 + d AS row_id, CASE WHEN chunk_id % 5 <> 0 THEN chunk_id END AS chunk_id, document_id, text, round(evidence_score - d * 0.05, 6) AS evidence_score, rank * 2 - d AS arrival
  FROM scored_rows CROSS JOIN (SELECT unnest([0, 1]) AS d)""", "scored_rows")


def _doubled(c):
    k = F.col("chunk_id")
    return _scored(c).withColumn("d", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "query_id", (F.col("row_id") * 2 + F.col("d")).alias("row_id"), F.when(k % 5 != 0, k).alias("chunk_id"), "document_id", "text",
        F.round(F.col("evidence_score") - F.col("d") * 0.05, 6).alias("evidence_score"), (F.col("rank") * 2 - F.col("d")).alias("arrival"))


KEY_SQL = f"coalesce('chunk_id:' || chunk_id, 'document_id:' || document_id, 'content:' || sha256({sq('lower(text)')}))"


@query("collect_evidence", f"""
SELECT query_id, key, row_id, evidence_score, row_number() OVER (PARTITION BY query_id ORDER BY evidence_score DESC, row_id) AS rank FROM (
  SELECT *, {KEY_SQL} AS key FROM doubled WHERE evidence_score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY evidence_score DESC, row_id) = 1) QUALIFY rank <= 6""", "doubled")
def _(c):
    return V.collect_evidence(_doubled(c), 6, 0.3)


@query("collect_evidence_ordered", f"""
SELECT query_id, key, arrival, evidence_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY evidence_score DESC, arrival) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY arrival) AS seat FROM (
    SELECT *, coalesce(document_id || ':' || chunk_id, sha256({sq('lower(text)')})) AS key FROM doubled WHERE length(trim(text)) >= 10 QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY arrival) = 1)
  QUALIFY seat <= 7)""", "doubled")
def _(c):
    return V.collect_evidence_ordered(_doubled(c).withColumnRenamed("evidence_score", "score"), 7).select("query_id", "key", "arrival", "score", "rank")


def _items(c):
    k = F.col("chunk_id")
    return B.evidence(c).select(
        "query_id", "chunk_id", "rank", F.col("relevance").alias("score"), F.when(k % 4 != 0, F.col("source")).alias("source"), F.when(k % 3 != 0, F.floor(k / 10)).alias("document_id"),
        F.concat(F.lit("E"), F.col("rank").cast("string")).alias("evidence_id"),
        F.concat("text", F.when(k % 2 == 0, " not").otherwise(""), F.when(k % 3 == 0, " supports").otherwise("")).alias("text"))


cte("items", """SELECT query_id, chunk_id, rank, relevance AS score, CASE WHEN chunk_id % 4 <> 0 THEN source END AS source, CASE WHEN chunk_id % 3 <> 0 THEN chunk_id // 10 END AS document_id, 'E' || rank AS evidence_id,
  text || CASE WHEN chunk_id % 2 = 0 THEN ' not' ELSE '' END || CASE WHEN chunk_id % 3 = 0 THEN ' supports' ELSE '' END AS text FROM evidence""", "evidence")
cte("completed", """SELECT *, round(((source IS NOT NULL)::INT + (document_id IS NOT NULL)::INT + (chunk_id % 5 = 0)::INT) / (2 + (chunk_id % 5 = 0)::INT), 6) AS completeness, coalesce(source, document_id::VARCHAR, evidence_id) AS source_key FROM items""", "items")


@query("provenance_completeness", "SELECT query_id, chunk_id, completeness, source_key FROM completed", "completed")
def _(c):
    rows = _items(c).withColumn("provenance", F.when(F.col("chunk_id") % 5 == 0, "p"))
    return V.provenance_completeness(rows, ("source", "document_id"), "provenance").select("query_id", "chunk_id", "completeness", "source_key")


# -- coverage ---------------------------------------------------------------------------

cte("cq_terms", f"""SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9_-]*'), lambda t: length(t) >= 3 AND t NOT IN ({quoted(QUERY_STOP)}))) AS ts FROM benchmark""")
cte("cq_hits", """SELECT query_id, t, bool_or(regexp_matches(lower(s.text), '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')) AS hit FROM (SELECT query_id, unnest(ts) AS t FROM cq_terms) JOIN scored_rows s USING (query_id) GROUP BY 1, 2""", "cq_terms", "scored_rows")


@query("coverage_quality", """
SELECT query_id, n_matched, n_missing, coverage, coverage >= 0.6 AS sufficient FROM (SELECT query_id, count(*) FILTER (hit) AS n_matched, count(*) FILTER (NOT hit) AS n_missing,
  round(least(1.0, 0.7 * count(*) FILTER (hit) / count(*) + 0.3 * any_value(q)), 6) AS coverage FROM cq_hits JOIN (SELECT query_id, avg(evidence_score) AS q FROM scored_rows GROUP BY 1) USING (query_id) GROUP BY 1)""", "cq_hits")
def _(c):
    return V.coverage_quality(c.queries, _scored(c)).select(
        "query_id", F.size("matched").cast("long").alias("n_matched"), F.size("missing").cast("long").alias("n_missing"), "coverage", "sufficient")


cte("ct_terms", rf"""SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+(?:-+[\p{{L}}\p{{N}}_]+)*'), lambda t: regexp_matches(t, '^[a-z0-9][a-z0-9_-]+$') AND t NOT IN ({quoted(COVERAGE_STOP)}))) AS ts FROM benchmark""")
cte("ct", r"""SELECT query_id, count(*) AS terms, count(*) FILTER (hit) AS covered FROM (SELECT query_id, t, bool_or(regexp_matches(lower(i.text), '(^|[^\p{L}\p{N}_])' || t || '($|[^\p{L}\p{N}_])')) AS hit
  FROM (SELECT query_id, unnest(ts) AS t FROM ct_terms) JOIN items i USING (query_id) GROUP BY 1, 2) GROUP BY 1""", "ct_terms", "items")


@query("coverage_terms", """
SELECT b.query_id, len(ts)::INT AS terms, coalesce(covered, 0)::INT AS covered, round(CASE WHEN len(ts) = 0 THEN 0.0 ELSE coalesce(covered, 0) / len(ts) END, 6) AS coverage,
  CASE WHEN len(ts) = 0 THEN 0.0 ELSE coalesce(covered, 0) / len(ts) END >= 0.7 AS sufficient FROM ct_terms b LEFT JOIN ct USING (query_id)""", "ct")
def _(c):
    return V.coverage_terms(c.queries, _items(c))


APOS = r"[\p{L}\p{N}_]+(?:[''-]+[\p{L}\p{N}_]+)*"
cte("wq", f"SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '{APOS}'), lambda t: length(t) > 1)) AS ts FROM benchmark")
cte("wcov", f"""SELECT query_id, len(any_value(ts)) AS total_terms, len(list_intersect(any_value(ts), list_distinct(flatten(list(regexp_extract_all(lower(e.text), '{APOS}')))))) AS covered_terms FROM wq JOIN evidence e USING (query_id) GROUP BY 1""", "wq", "evidence")


@query("coverage_tokens", "SELECT query_id, total_terms::INT AS total_terms, covered_terms::INT AS covered_terms, round(covered_terms / total_terms, 6) AS coverage FROM wcov", "wcov")
def _(c):
    return V.coverage_tokens(c.queries, B.evidence(c))


# -- agreement --------------------------------------------------------------------------

cte("corro", "SELECT query_id, count(*) AS evidence_count, count(DISTINCT source_key) AS unique_sources, round(least(1.0, count(DISTINCT source_key) / 4), 6) AS corroboration, count(DISTINCT source_key) >= 4 AS independent FROM completed GROUP BY 1", "completed")


@query("corroboration", "SELECT * FROM corro", "corro")
def _(c):
    return V.corroboration(_items(c), 4)


cte("stances", rf"""SELECT query_id, chunk_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+'), lambda t: regexp_matches(t, '^[a-z0-9'']+$'))) AS ts,
  len(list_intersect(ts, [{quoted(NEGATION)}])) > 0 AS neg, len(list_intersect(ts, [{quoted(ASSERTION)}])) > 0 AS pos FROM items""", "items")
cte("contra", """SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, 0.7 + CASE WHEN a.pos <> b.pos THEN 0.2 ELSE 0 END AS contradiction, len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts) - len(list_intersect(a.ts, b.ts))) AS similarity
  FROM stances a JOIN stances b ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id AND a.neg <> b.neg AND len(a.ts) > 0 AND len(b.ts) > 0 WHERE similarity >= 0.1 - 1e-9""", "stances")
cte("contra_sum", """SELECT query_id, count(*) AS items, coalesce(any_value(n), 0) AS contradictions, round(greatest(0.0, 1.0 - coalesce(any_value(n), 0) / count(*)), 6) AS consistency, coalesce(any_value(n), 0) > 0 AS has_contradiction
  FROM items LEFT JOIN (SELECT query_id, count(*) AS n FROM contra GROUP BY 1) USING (query_id) GROUP BY 1""", "contra")


@query("contradictions", "SELECT * FROM contra_sum", "contra_sum")
def _(c):
    return V.contradictions(_items(c), 0.1)


cte("stance_sets", """SELECT query_id, list_sort(ts) AS tokens, min(chunk_id) AS id, any_value(neg) AS neg, any_value(pos) AS pos, count(*) AS copies
  FROM stances WHERE len(ts) > 0 GROUP BY 1, 2""", "stances")


@query("contradiction_pairs", """
SELECT a.query_id, a.id AS a, b.id AS b, round(n / (len(a.tokens) + len(b.tokens) - n), 6) AS similarity,
  (0.7 + CASE WHEN a.pos <> b.pos THEN 0.2 ELSE 0 END)::DOUBLE AS contradiction, a.copies * b.copies AS pairs
FROM stance_sets a JOIN stance_sets b ON a.query_id = b.query_id AND a.id < b.id AND a.neg <> b.neg,
  LATERAL (SELECT len(list_intersect(a.tokens, b.tokens)) AS n) WHERE n / (len(a.tokens) + len(b.tokens) - n) >= 0.1 - 1e-9""", "stance_sets")
def _(c):
    return V.contradiction_pairs(_items(c), 0.1)


TAILS = (" improves results", " performs worse than x", "", " increased and harms", " is better than y")


def _tailed(c):
    tail = F.get(F.array(*[F.lit(t) for t in TAILS]), (F.col("claim_index") * 7 + F.col("query_id")) % len(TAILS))
    return claims(c).withColumn("claim", F.concat("claim", tail))


cte("flagged", f"""SELECT query_id, claim_index, {" OR ".join(f"contains(t, '{p}')" for p in POSITIVE_PHRASES)} AS gain, {" OR ".join(f"contains(t, '{p}')" for p in NEGATIVE_PHRASES)} AS loss FROM (
  SELECT query_id, claim_index, lower(claim || [{quoted(TAILS)}][(claim_index * 7 + query_id) % {len(TAILS)} + 1]) AS t FROM claims)""", "claims")


@query("claim_conflicts", """
SELECT a.query_id, a.claim_index, any_value(a.gain) AS gain, any_value(a.loss) AS loss, count(*) AS opponents FROM flagged a JOIN flagged b ON a.query_id = b.query_id AND a.claim_index <> b.claim_index AND ((a.gain AND b.loss) OR (a.loss AND b.gain)) GROUP BY 1, 2""", "flagged")
def _(c):
    return V.claim_conflicts(_tailed(c))


cte("validated", """SELECT query_id, rank, array_to_string(list_filter([CASE WHEN evidence_id IS NULL THEN 'missing evidence identifier' END, CASE WHEN length(trim(text)) < 200 THEN 'content below minimum length' END,
  CASE WHEN score < 0.2 THEN 'score below minimum threshold' END, CASE WHEN source IS NULL AND document_id IS NULL THEN 'missing source' END], lambda x: x IS NOT NULL), '|') AS errors FROM (
  SELECT * REPLACE (CASE WHEN rank = 4 THEN NULL ELSE evidence_id END AS evidence_id) FROM items)""", "items")


def _validated(c):
    return V.validate_evidence(_items(c).withColumn("evidence_id", F.when(F.col("rank") != 4, F.col("evidence_id"))), 200, 0.2, True)


@query("validate_evidence", "SELECT query_id, rank, errors, errors = '' AS accepted FROM validated", "validated")
def _(c):
    return _validated(c).select("query_id", "rank", F.array_join("errors", "|").alias("errors"), "accepted")


@query("acceptance_rate", "SELECT query_id, count(*) AS items, count(*) FILTER (errors = '') AS accepted, round(count(*) FILTER (errors = '') / count(*), 6) AS acceptance FROM validated GROUP BY 1", "validated")
def _(c):
    return V.acceptance_rate(_validated(c))


@query("evidence_confidence", """
SELECT query_id, chunk_id, round(0.4 * least(1.0, score / 40) + 0.4 * relevance + 0.2 * CASE WHEN length(trim(text)) = 0 THEN 0 WHEN length(trim(text)) >= 500 THEN 1 WHEN length(trim(text)) >= 200 THEN 0.8 WHEN length(trim(text)) >= 100 THEN 0.6 ELSE 0.4 END, 4) AS confidence FROM evidence""", "evidence")
def _(c):
    return B.evidence(c).select("query_id", "chunk_id", V.evidence_confidence(F.col("score") / 40, F.col("relevance"), F.col("text")).alias("confidence"))


cte("assessed", """SELECT query_id, relevance, coverage, corroboration, provenance, consistency, has_contradiction, round(least(1.0, 0.35 * relevance + 0.25 * coverage + 0.15 * corroboration + 0.1 * provenance + 0.15 * consistency), 6) AS overall FROM (
  SELECT query_id, sum(s / place) / sum(1.0 / place) AS relevance FROM (SELECT query_id, 0.75 * score + 0.25 * (source IS NOT NULL)::INT AS s, row_number() OVER (PARTITION BY query_id ORDER BY 0.75 * score + 0.25 * (source IS NOT NULL)::INT DESC, chunk_id) AS place FROM items) WHERE place <= 5 GROUP BY 1)
  JOIN (SELECT query_id, avg((source IS NOT NULL)::INT) AS provenance, least(1.0, count(DISTINCT source_key) / 2) AS corroboration FROM completed GROUP BY 1) USING (query_id)
  JOIN (SELECT query_id, round(covered / terms, 6) AS coverage FROM ct) USING (query_id) JOIN (
    SELECT query_id, round(greatest(0.0, 1.0 - coalesce(n, 0) / items), 6) AS consistency, coalesce(n, 0) > 0 AS has_contradiction FROM (SELECT query_id, count(*) AS items FROM items GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS n FROM contra WHERE similarity >= 0.35 - 1e-9 GROUP BY 1) USING (query_id)) USING (query_id)""", "completed", "ct", "contra")


@query("assess_evidence", """
SELECT query_id, overall, round(relevance, 6) AS relevance, coverage, corroboration, round(provenance, 6) AS provenance, consistency, overall >= 0.7 AND coverage >= 0.7 AND NOT has_contradiction AS sufficient,
  NOT (overall >= 0.7 AND coverage >= 0.7 AND NOT has_contradiction) OR coverage < 0.5 OR has_contradiction AS needs_refinement FROM assessed""", "assessed")
def _(c):
    return V.assess_evidence(c.queries, _items(c))


# -- claims and sources -----------------------------------------------------------------


@query("claim_support", """
SELECT a.query_id, a.claim_index, b.claim_index AS evidence_index, count(*) AS overlap FROM (SELECT query_id, claim_index, unnest(list_distinct(string_split(lower(claim), ' '))) AS w FROM claims) a
JOIN (SELECT query_id, claim_index, unnest(list_distinct(string_split(lower(claim), ' '))) AS w FROM claims) b USING (query_id, w) GROUP BY 1, 2, 3""", "claims")
def _(c):
    return V.claim_support(claims(c), claims(c))


@query("evidence_chain", "SELECT query_id, claim_index, claim, confidence, source, lang FROM claims LEFT JOIN documents ON doc_id = chunk_id", "claims")
def _(c):
    sources = c.chunks.select(F.col("chunk_id").alias("source_id"), "source", "lang")
    return V.evidence_chain(claims(c).withColumnRenamed("chunk_id", "source_id"), sources).select("query_id", "claim_index", "claim", "confidence", "source", "lang")


@query("group_findings", """
SELECT query_id, topic, count(*)::INT AS statements, string_agg(claim, ' ' ORDER BY position) AS content, string_agg(id, ',' ORDER BY position) AS evidence_ids FROM (
  SELECT *, coalesce(nullif(trim(topic_a), ''), nullif(trim(topic_b), ''), 'Findings') AS topic, coalesce('id:' || id, 'claim:' || lower(claim)) AS key FROM (
    SELECT query_id, query_id * 100 + claim_index AS position, CASE WHEN claim_index % 4 <> 0 THEN 'c' || chunk_id || '-' || (claim_index % 3) END AS id, claim, CASE WHEN query_id % 3 = 0 THEN ' ' WHEN query_id % 3 = 1 THEN lang END AS topic_a,
      CASE WHEN chunk_id % 2 = 0 THEN source END AS topic_b FROM claims JOIN documents ON doc_id = chunk_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY position) = 1) GROUP BY 1, 2""", "claims")
def _(c):
    j = claims(c).join(c.chunks.select("chunk_id", "lang", "source"), "chunk_id")
    i, q = F.col("claim_index"), F.col("query_id")
    items = j.select(
        "query_id", (q * 100 + i).alias("position"), F.when(i % 4 != 0, F.concat(F.lit("c"), F.col("chunk_id").cast("string"), F.lit("-"), (i % 3).cast("string"))).alias("id"), "claim",
        F.when(q % 3 == 0, " ").when(q % 3 == 1, F.col("lang")).alias("topic_a"), F.when(F.col("chunk_id") % 2 == 0, F.col("source")).alias("topic_b"))
    return V.group_findings(items, ("topic_a", "topic_b"))


@query("comparison_table", f"SELECT query_id, claim_index, chunk_id, criterion FROM claims CROSS JOIN (SELECT unnest([{quoted(CRITERIA)}]) AS criterion)", "claims")
def _(c):
    return V.comparison_table(claims(c)).select("query_id", "claim_index", "chunk_id", "criterion")


@query("render_references", """
SELECT paper_id, names || '. (' || y || '). ' || title || '.' AS apa, names || ', "' || title || '", ' || y || '.' AS ieee, names || '. ' || title || '. ' || y || '.' AS mla,
  '@article{' || replace(lower(title), ' ', '_') || ', title={' || title || '}, author={' || replace(names, ', ', ' and ') || '}, year={' || coalesce(yr, '') || '}}' AS bibtex,
  CASE WHEN names = '' THEN 'Unknown author' ELSE names END || '. ' || title || '. ' || y || '.' || CASE WHEN paper_id % 2 = 0 THEN ' https://x.org/' || paper_id ELSE '' END AS plain FROM (
  SELECT p.paper_id, p.title, yr, coalesce(yr, 'n.d.') AS y, coalesce(names, '') AS names FROM (SELECT o_orderkey AS paper_id, 'Study ' || (o_custkey % 97) || ' of ' || lower(o_orderstatus) AS title,
    CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate)::VARCHAR END AS yr FROM orders) p LEFT JOIN (SELECT l_orderkey, string_agg(s_name, ', ' ORDER BY s_suppkey) AS names FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) ON l_orderkey = p.paper_id)""")
def _(c):
    names = c.paper_authors.join(c.authors, "author_id").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("author_id", "name"))).alias("a"))
    k = F.col("paper_id")
    s = c.papers.join(names, "paper_id", "left").select(
        "paper_id", "title", F.when(k % 5 != 0, F.col("year")).alias("year"), F.coalesce("a.name", F.array().cast("array<string>")).alias("authors"),
        F.when(k % 2 == 0, F.concat(F.lit("https://x.org/"), k.cast("string"))).alias("url"))
    return V.render_references(s).select("paper_id", "apa", "ieee", "mla", "bibtex", "plain")


# -- citation markers -------------------------------------------------------------------

cte("cited", r"""SELECT query_id, generate_subscripts(l, 1) - 1 AS position, 'E' || unnest(l)::INT AS evidence_id FROM (SELECT query_id, flatten(list_transform(regexp_extract_all(cited, '(?i)\[E[0-9]+(?:\s*,\s*E[0-9]+)*\]'),
  lambda m: regexp_extract_all(m, '(?i)E([0-9]+)', 1))) AS l FROM qa)""", "qa")
cte("held_ids", "SELECT query_id, 'E' || rank AS evidence_id FROM runs", "runs")


def _held(c):
    return B.runs(c).select("query_id", F.concat(F.lit("E"), F.col("rank").cast("string")).alias("evidence_id"))


def _cited(c):
    return B.qa(c).select("query_id", F.col("cited").alias("answer"))


@query("extract_citations", "SELECT query_id, position::INT AS position, evidence_id FROM cited", "cited")
def _(c):
    return V.extract_citations(_cited(c))


@query("validate_citations", """
SELECT query_id, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (times > 0 AND held), '') AS valid_ids, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (held IS NULL), '') AS invalid_ids,
  coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (times IS NULL), '') AS missing_ids, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (times > 1), '') AS duplicate_ids,
  coalesce(sum(times), 0)::BIGINT AS citations, count(*) FILTER (held IS NULL) = 0 AND coalesce(sum(times), 0) > 0 AS valid
FROM (SELECT query_id, evidence_id, count(*) AS times FROM cited GROUP BY 1, 2) FULL JOIN (SELECT *, true AS held FROM held_ids) USING (query_id, evidence_id) GROUP BY 1""", "cited", "held_ids")
def _(c):
    return V.validate_citations(_cited(c), _held(c))


@query("strip_invalid_citations", """
SELECT query_id, answer || ' ' || CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE '[' || concat_ws(', ', a, CASE WHEN b IS DISTINCT FROM a THEN b END) || ']' END || ' and ' ||
  CASE WHEN d IS NULL THEN '' ELSE '[' || d || ']' END AS answer FROM (
  SELECT q.query_id, q.answer, x.evidence_id AS a, y.evidence_id AS b, z.evidence_id AS d FROM qa q
  LEFT JOIN held_ids x ON x.query_id = q.query_id AND x.evidence_id = 'E1' LEFT JOIN held_ids y ON y.query_id = q.query_id AND y.evidence_id = 'E' || (q.query_id % 12 + 1)
  LEFT JOIN held_ids z ON z.query_id = q.query_id AND z.evidence_id = 'E' || (q.query_id % 5 + 1))""", "qa", "held_ids")
def _(c):
    return V.strip_invalid_citations(_cited(c), _held(c))
