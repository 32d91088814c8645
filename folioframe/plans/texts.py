"""Duplicates, identities, sections and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import ids
from folioframe.functions.lexicon import KNOWN_HEADINGS, STRUCTURAL_HEADINGS
from folioframe.operators import chunk as K
from folioframe.operators import resolve as R
from folioframe.plans import base as B
from folioframe.plans.ingest import sq
from folioframe.plans.registry import cte, query

# -- identity ---------------------------------------------------------------------------

cte("identified", """SELECT s.*, o_orderstatus, o_custkey, coalesce('doi:' || doi_norm, 'arxiv:' || arxiv_norm, 'pmid:' || pmid_norm,
  'provider:' || provider || ':' || provider_id) AS identity FROM strict s JOIN orders ON o_orderkey = k""", "strict")


def _records(c):
    return R.with_identity(c.records.withColumn("year", ids.year(F.col("published"))))


@query("identity_key", r"""
SELECT arrival, identity, 'title:' || sha256(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g') || '|' || regexp_extract(published, '[0-9]{4}')) AS by_title FROM identified""", "identified")
def _(c):
    null = F.lit(None).cast("string")
    by_title = ids.identity_key(null, null, null, null, null, F.col("title"), F.col("year"))
    return _records(c).select("arrival", "identity", by_title.alias("by_title"))


@query("dedup_first", "SELECT identity, min(arrival) AS arrival, arg_min(provider, arrival) AS provider FROM identified GROUP BY 1", "identified")
def _(c):
    return R.dedup_first(_records(c).select("identity", "arrival", "provider"))


cte("ident_rows", """SELECT arrival, feed, 0 AS p, 'doi' AS kind, doi_norm AS v FROM identified UNION ALL SELECT arrival, feed, 1, 'arxiv', arxiv_norm FROM identified
  UNION ALL SELECT arrival, feed, 2, 'openalex', openalex_norm FROM identified UNION ALL SELECT arrival, feed, 4, 'pmid', pmid_norm FROM identified
  UNION ALL SELECT arrival, feed, 5, 'crossref', CASE WHEN feed = 1 THEN provider_id END FROM identified UNION ALL SELECT arrival, feed, 6, 'key', identity FROM identified""", "identified")
cte("dups", """SELECT a.arrival AS record, arg_min(b.arrival, a.p::BIGINT * 1000000000 + b.arrival) AS match, arg_min(a.kind, a.p::BIGINT * 1000000000 + b.arrival) AS kind
  FROM ident_rows a JOIN ident_rows b ON a.feed = 1 AND b.feed = 0 AND a.kind = b.kind AND a.v = b.v GROUP BY 1""", "ident_rows")


def _sides(c):
    r = _records(c)
    return r.filter("provider = 'crossref'"), r.filter("provider = 'openalex'")


@query("find_duplicates", "SELECT * FROM dups", "dups")
def _(c):
    return R.find_duplicates(*_sides(c))


@query("upsert_papers", """
SELECT arrival AS record, CASE WHEN arrival NOT IN (SELECT record FROM dups) AND row_number() OVER (PARTITION BY identity ORDER BY arrival) = 1 THEN 'created' ELSE 'duplicate' END AS action
FROM identified WHERE feed = 1""", "dups")
def _(c):
    return R.upsert_papers(*_sides(c))[1]


@query("upsert_papers_table", """
SELECT provider, count(*) AS papers FROM (SELECT provider FROM identified WHERE feed = 0 UNION ALL
  SELECT provider FROM identified WHERE feed = 1 AND arrival NOT IN (SELECT record FROM dups) QUALIFY row_number() OVER (PARTITION BY identity ORDER BY arrival) = 1) GROUP BY 1""", "dups")
def _(c):
    return R.upsert_papers(*_sides(c))[0].groupBy("provider").agg(F.count(F.lit(1)).alias("papers"))


cte("entity_links", """SELECT o_orderkey AS record, 'customer:' || o_custkey || ':' || strftime(o_orderdate, '%Y-%m') AS value FROM orders
  UNION ALL SELECT o_orderkey, 'day:' || (o_custkey % 40) || ':' || strftime(o_orderdate, '%Y-%m-%d') FROM orders""")


@query("resolve_entities", """
WITH RECURSIVE l AS MATERIALIZED (SELECT o_orderkey AS record, 'customer:' || o_custkey || ':' || strftime(o_orderdate, '%Y-%m') AS value FROM orders
  UNION ALL SELECT o_orderkey, 'day:' || (o_custkey % 40) || ':' || strftime(o_orderdate, '%Y-%m-%d') FROM orders),
e AS MATERIALIZED (SELECT DISTINCT a.record AS x, b.record AS y FROM l a JOIN l b USING (value)),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT x AS record, min(y) AS entity FROM reach GROUP BY 1""")
def _(c):
    o = c.table("orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    links = o.select(F.col("o_orderkey").alias("record"), F.explode(F.array(
        F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"), F.lit(":"), F.date_format("o_orderdate", "yyyy-MM")),
        F.concat(F.lit("day:"), (F.col("o_custkey") % 40).cast("string"), F.lit(":"), day))).alias("value"))
    return R.resolve_entities(links)


# -- authors ----------------------------------------------------------------------------

cte("author_in", """SELECT l_orderkey AS paper_id, l_linenumber * 100000 + l_suppkey AS position, CASE WHEN l_linenumber % 2 = 0 THEN upper(s_name) ELSE s_name || ' ' END AS name,
  CASE WHEN l_suppkey % 3 = 0 AND l_linenumber % 2 = 1 THEN '0000-' || l_suppkey END AS orcid, CASE WHEN l_linenumber = 3 THEN 'Nation ' || s_nationkey END AS affiliation
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
cte("author_old", """SELECT s_suppkey AS author_id, s_name AS name, NULL AS orcid, CASE WHEN s_suppkey % 4 = 0 THEN 'Old place' END AS affiliation FROM supplier WHERE s_suppkey % 2 = 0""")


def _sync(c):
    sup = c.table("supplier")
    items = c.table("lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    n = F.col("l_linenumber")
    incoming = items.select(
        F.col("l_orderkey").alias("paper_id"), (n * 100000 + F.col("l_suppkey")).alias("position"),
        F.when(n % 2 == 0, F.upper("s_name")).otherwise(F.concat("s_name", F.lit(" "))).alias("name"),
        F.when((F.col("l_suppkey") % 3 == 0) & (n % 2 == 1), F.concat(F.lit("0000-"), F.col("l_suppkey").cast("string"))).alias("orcid"),
        F.when(n == 3, F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))).alias("affiliation"))
    stored = sup.filter(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("orcid"),
        F.when(F.col("s_suppkey") % 4 == 0, "Old place").alias("affiliation"))
    return R.sync_authors(incoming, stored)


# every incoming name belongs to exactly one supplier, so the supplier is the identity here
cte("author_facts", """SELECT lower(trim(name)) AS key, arg_min(trim(name), paper_id * 10000000 + position) AS name, min(orcid) AS orcid, min(affiliation) AS affiliation FROM author_in GROUP BY 1""", "author_in")


@query("sync_authors", """
SELECT coalesce(o.author_id::VARCHAR, 'new:' || f.key) AS author_id, coalesce(o.name, f.name) AS name, f.orcid, coalesce(o.affiliation, f.affiliation) AS affiliation
FROM author_facts f FULL JOIN author_old o ON lower(o.name) = f.key""", "author_facts", "author_old")
def _(c):
    return _sync(c)[0]


@query("sync_author_links", """
SELECT paper_id, coalesce(o.author_id::VARCHAR, 'new:' || lower(trim(i.name))) AS author_id, min(position) AS author_order
FROM author_in i LEFT JOIN author_old o ON lower(o.name) = lower(trim(i.name)) GROUP BY 1, 2""", "author_in", "author_old")
def _(c):
    return _sync(c)[1]


# -- copies -----------------------------------------------------------------------------


@query("dedup_exact_text", f"SELECT min(doc_id) AS chunk_id, count(*) AS copies FROM documents GROUP BY {sq('lower(text)')}")
def _(c):
    return R.dedup_exact_text(c.chunks)


LEVELS = 8
cte("near_sets", "SELECT chunk_id, list_sort(list_distinct(words)) AS ts, len(list_distinct(words)) AS n, n_chars FROM tok JOIN documents ON doc_id = chunk_id", "tok")
cte("near_flat", "SELECT chunk_id, n, n_chars, unnest(ts) AS t FROM near_sets", "near_sets")
cte("near_pairs", """SELECT b.chunk_id AS low, a.chunk_id AS high FROM near_flat a JOIN near_flat b USING (t)
  WHERE (a.n_chars > b.n_chars OR (a.n_chars = b.n_chars AND a.chunk_id < b.chunk_id)) AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) - 1e-9
  GROUP BY a.chunk_id, b.chunk_id HAVING count(*) / (first(a.n) + first(b.n) - count(*)) >= 0.9 - 1e-9""", "near_flat")
cte("open_0", "SELECT chunk_id AS id FROM near_sets", "near_sets")
for i in range(LEVELS):
    cte(f"free_{i}", f"SELECT id FROM open_{i} WHERE id NOT IN (SELECT low FROM near_pairs WHERE low IN (FROM open_{i}) AND high IN (FROM open_{i}))", f"open_{i}", "near_pairs")
    cte(f"gone_{i}", f"SELECT DISTINCT low AS id FROM near_pairs WHERE high IN (FROM free_{i}) AND low IN (FROM open_{i})", f"free_{i}")
    cte(f"open_{i + 1}", f"SELECT id FROM open_{i} WHERE id NOT IN (FROM free_{i}) AND id NOT IN (FROM gone_{i})", f"gone_{i}")


@query("dedup_near_text", "SELECT id AS chunk_id, true AS kept FROM (" + " UNION ALL ".join(f"FROM free_{i}" for i in range(LEVELS)) + ") UNION ALL SELECT id, false FROM ("
       + " UNION ALL ".join(f"FROM gone_{i}" for i in range(LEVELS)) + f") UNION ALL SELECT id, NULL FROM open_{LEVELS}", f"open_{LEVELS}")
def _(c):
    rows = c.documents.select(F.col("document_id").alias("chunk_id"), "text", F.col("n_chars").alias("score"))
    return R.dedup_near_text(rows, 0.9).select("chunk_id", (F.col("kept_id") == F.col("chunk_id")).alias("kept"))


APOS = r"[\p{L}\p{N}_]+(?:[''-]+[\p{L}\p{N}_]+)*"
cte("ev_words", f"SELECT query_id, chunk_id, relevance, list_distinct(list_filter(regexp_extract_all(lower(text), '{APOS}'), lambda t: length(t) > 1)) AS ws FROM evidence", "evidence")


@query("pairwise_jaccard", """
SELECT query_id, items, duplicate_pairs, round(CASE WHEN items < 2 THEN 0.0 ELSE duplicate_pairs / (items * (items - 1) / 2) END, 6) AS duplicate_ratio,
  round(1.0 - CASE WHEN items < 2 THEN 0.0 ELSE duplicate_pairs / (items * (items - 1) / 2) END, 6) AS diversity FROM
  (SELECT query_id, count(*) AS items FROM ev_words GROUP BY 1) JOIN (SELECT query_id, count(*) FILTER (j >= 0.9 - 1e-9) AS duplicate_pairs FROM
    (SELECT a.query_id, CASE WHEN len(a.ws) + len(b.ws) = 0 THEN 1.0 WHEN a.chunk_id < b.chunk_id THEN len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) ELSE 0 END AS j
     FROM ev_words a JOIN ev_words b ON a.query_id = b.query_id AND a.chunk_id <= b.chunk_id) GROUP BY 1) USING (query_id)""", "ev_words")
def _(c):
    return R.pairwise_jaccard(B.evidence(c))


@query("prefix_diversity", r"""
SELECT query_id, count(*) AS items, count(DISTINCT o) AS openings, CASE WHEN count(*) <= 1 THEN 1.0 ELSE round(count(DISTINCT o) / count(*), 6) END AS diversity FROM (
  SELECT query_id, array_to_string(words[1:50], ' ') AS o FROM evidence JOIN tok USING (chunk_id)) GROUP BY 1""", "evidence", "tok")
def _(c):
    return R.prefix_diversity(B.evidence(c))


# -- sources ----------------------------------------------------------------------------


def _source_rows(c):
    e = F.col("event_id")
    rows = c.events.select(
        e.alias("position"), F.when(e % 7 != 6, F.concat(F.lit("S"), (e % 500).cast("string"))).alias("id"),
        F.when(e % 4 == 0, F.col("user_id")).alias("paper_id"), F.when(e % 4 == 1, F.concat(F.lit("DOC"), (F.col("user_id") % 20).cast("string"))).alias("document_id"),
        F.concat(F.lit(" Log  of "), "event_type").alias("title"), F.lit("Event").alias("source_type"))
    used = c.table("lineitem").select(F.concat(F.lit("S"), (F.col("l_partkey") % 700).cast("string")).alias("source_id"))
    return rows, used


cte("source_rows", """SELECT event_id AS position, CASE WHEN event_id % 7 <> 6 THEN 'S' || (event_id % 500) END AS id, CASE WHEN event_id % 4 = 0 THEN user_id END AS paper_id,
  CASE WHEN event_id % 4 = 1 THEN 'DOC' || (user_id % 20) END AS document_id, ' Log  of ' || event_type AS title FROM events""")
cte("source_use", "SELECT 'S' || (l_partkey % 700) AS id, count(*) AS n FROM lineitem GROUP BY 1")


@query("unique_sources", """
SELECT identity, arg_min(id, position) FILTER (position = p0) AS source_id, arg_min(title, position) AS title, count(*) AS mentions, sum(coalesce(n, 0))::BIGINT AS evidence_count FROM (
  SELECT *, min(position) OVER (PARTITION BY identity) AS p0 FROM (
  SELECT r.*, u.n, coalesce('paper:' || paper_id, 'document:' || lower(document_id), 'source:' || lower(r.id), 'title:log of ' || lower(trim(replace(title, ' Log  of ', ''))) || '|source:event') AS identity
  FROM source_rows r LEFT JOIN source_use u USING (id))) GROUP BY 1""", "source_rows", "source_use")
def _(c):
    return R.unique_sources(*_source_rows(c))


@query("unique_citations", """
SELECT id, min(position) AS position, arg_min(title, position) AS title FROM source_rows WHERE id IN (SELECT id FROM source_use) GROUP BY 1""", "source_rows", "source_use")
def _(c):
    rows, used = _source_rows(c)
    return R.unique_citations(rows.select("id", "position", "title"), used)


cte("ref_rows", """SELECT query_id, rank AS position, lang || ' text' AS title, CASE chunk_id % 3 WHEN 0 THEN 'paper:' || (chunk_id // 50) WHEN 1 THEN 'document:' || source
  ELSE 'title:' || lang || ' text|authors:ann b|c d|year:' || (2000 + chunk_id % 4) || '|source:web' END AS identity FROM evidence""", "evidence")


@query("unique_references", """
SELECT query_id, identity, arg_min(title, position) AS title, row_number() OVER (PARTITION BY query_id ORDER BY min(position), identity) AS number, count(*) AS evidence_count FROM ref_rows GROUP BY 1, 2""", "ref_rows")
def _(c):
    k = F.col("chunk_id")
    e = B.evidence(c).select("query_id", F.col("rank").alias("position"), F.concat("lang", F.lit(" text")).alias("title"), R.reference_identity(
        F.when(k % 3 == 0, F.floor(k / 50)), F.when(k % 3 == 1, F.col("source")), F.concat("lang", F.lit(" text")),
        F.array(F.lit("Ann  B"), F.lit("C D")), k % 4 + 2000, F.lit("Web"), k).alias("identity"))
    return R.unique_references(e, e.select("query_id", "identity"), "query_id")


# -- sections and chunks ----------------------------------------------------------------

cte("sectioned", """SELECT doc_id AS document_id, text || chr(10) || '1 Introduction' || chr(10) || chr(10) || text || chr(10) || '## Notes on ' || lang || chr(10) || 'References' || chr(10) ||
  '2.1.3 Source, ' || source || chr(10) || '   ' || chr(10) || text AS text FROM documents""")


def _sectioned(c):
    nl = F.lit("\n")
    return c.documents.select("document_id", F.concat(
        "text", F.lit("\n1 Introduction\n\n"), "text", F.lit("\n## Notes on "), "lang", F.lit("\nReferences\n2.1.3 Source, "), "source", nl, F.lit("   "), nl, "text").alias("text"))


@query("split_sentences", r"""
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY i) - 1)::INT AS sentence_index, s AS sentence FROM (
  SELECT doc_id AS document_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(text, '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')), lambda x: x <> '') AS l FROM documents))""")
def _(c):
    return K.split_sentences(c.documents)


@query("estimate_tokens", r"""
SELECT doc_id AS document_id, CASE WHEN len(words) = 0 THEN 0 ELSE greatest(1, floor(len(words) * 1.3)) END::INT AS by_words,
  CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) / 0.75)) END::INT AS by_matches FROM documents JOIN tok ON chunk_id = doc_id""", "tok")
def _(c):
    return K.estimate_tokens(c.documents)


@query("detect_headers", r"""
SELECT document_id, line, CASE WHEN h <> '' THEN length(h) ELSE length(num) - length(replace(num, '.', '')) + 1 END::INT AS level, CASE WHEN h = '' THEN num END AS number,
  trim(CASE WHEN h <> '' THEN regexp_extract(t, '^#{1,6}\s+(.*)$', 1) ELSE regexp_extract(t, '^[0-9]+(\.[0-9]+)*\s+(.*)$', 2) END) AS title FROM (
  SELECT document_id, line, t, regexp_extract(t, '^(#{1,6})\s+(.*)$', 1) AS h, regexp_extract(t, '^([0-9]+(\.[0-9]+)*)\s+(.*)$', 1) AS num FROM (
    SELECT document_id, (generate_subscripts(l, 1) - 1)::INT AS line, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS t FROM (SELECT document_id, string_split(text, chr(10)) AS l FROM sectioned)))
WHERE h <> '' OR num <> ''""", "sectioned")
def _(c):
    return K.detect_headers(_sectioned(c))


KNOWN_SQL = ", ".join(f"'{h}'" for h in KNOWN_HEADINGS)
HEAD = r"^(?:([0-9]+(?:\.[0-9]+)*)[.:\s-]+)?([A-Z][A-Za-z0-9][A-Za-z0-9\s,:&''()/-]{1,150})$"


@query("parse_sections", rf"""
SELECT document_id, no::INT AS section_index, CASE WHEN max(lv) > 0 THEN any_value(t) FILTER (lv > 0) ELSE 'Document' END AS title, CASE WHEN max(lv) > 0 THEN max(lv) ELSE 1 END::INT AS level,
  coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (lv = 0), '') AS content FROM (
  SELECT *, sum(CASE WHEN i = 1 OR lv > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS no FROM (
    SELECT document_id, i, t, CASE WHEN length(t) > 180 THEN 0 WHEN lower(t) IN ({KNOWN_SQL}) THEN 1
      WHEN regexp_extract(t, '{HEAD}', 2) <> '' AND len(regexp_split_to_array(trim(regexp_extract(t, '{HEAD}', 2)), '\s+')) <= 15
        THEN length(regexp_extract(t, '{HEAD}', 1)) - length(replace(regexp_extract(t, '{HEAD}', 1), '.', '')) + 1 ELSE 0 END AS lv FROM (
      SELECT document_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT document_id, list_filter(list_transform(string_split(text, chr(10)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM sectioned)))) GROUP BY document_id, no""", "sectioned")
def _(c):
    return K.parse_sections(_sectioned(c))


NUMBERED = r"^\s*([0-9]+(?:\.[0-9]+)*)\s+(.+?)\s*$"
cte("struct_lines", rf"""SELECT document_id, i, t, word, num, CASE WHEN length(t) <= 120 THEN CASE WHEN word <> '' THEN word WHEN num <> '' AND len(regexp_split_to_array(rest, '\s+')) <= 12 THEN rest END END AS hd,
  CASE WHEN num <> '' THEN length(num) - length(replace(num, '.', '')) + 1 ELSE 1 END AS lv FROM (
  SELECT *, regexp_extract(t, '(?i)^(?:[0-9]+(?:\.[0-9]+)*\s+)?({STRUCTURAL_HEADINGS})\s*$', 1) AS word, regexp_extract(t, '{NUMBERED}', 1) AS num, regexp_extract(t, '{NUMBERED}', 2) AS rest FROM (
    SELECT document_id, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS t, generate_subscripts(l, 1) AS i FROM (SELECT document_id, string_split(text, chr(10)) AS l FROM sectioned)))""", "sectioned")
cte("struct_blocks", """SELECT document_id, no, bool_or(hd IS NOT NULL) AS is_head, CASE WHEN bool_or(hd IS NOT NULL) THEN max(hd) ELSE string_agg(t, ' ' ORDER BY i) END AS body,
  any_value(st) AS section_title, coalesce(any_value(sl), 0) AS section_level FROM (
  SELECT *, sum(b) OVER (PARTITION BY document_id ORDER BY i) AS no, last_value(hd IGNORE NULLS) OVER w AS st, last_value(CASE WHEN hd IS NOT NULL THEN lv END IGNORE NULLS) OVER w AS sl FROM (
    SELECT *, CASE WHEN hd IS NOT NULL OR i = 1 OR lag(t) OVER v = '' OR lag(hd) OVER v IS NOT NULL THEN 1 ELSE 0 END AS b FROM struct_lines WINDOW v AS (PARTITION BY document_id ORDER BY i))
  WINDOW w AS (PARTITION BY document_id ORDER BY i)) WHERE t <> '' GROUP BY 1, 2""", "struct_lines")


@query("structural_chunks", r"""
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY no, p) - 1)::INT AS chunk_index, CASE WHEN long THEN array_to_string(ws[p:p + 499], ' ') ELSE body END AS text,
  CASE WHEN is_head THEN 'heading' WHEN long THEN 'structural_split' ELSE 'structural' END AS chunk_type, section_title, section_level::INT AS section_level FROM (
  SELECT *, unnest(CASE WHEN long THEN range(1, len(ws) + 1, 500) ELSE [1] END) AS p FROM (
    SELECT *, NOT is_head AND floor(len(ws) * 1.3) > 500 AS long FROM (SELECT *, list_filter(regexp_split_to_array(body, '[ \n\t\r]+'), lambda x: x <> '') AS ws FROM struct_blocks)))""", "struct_blocks")
def _(c):
    return K.structural_chunks(_sectioned(c))


cte("cased", r"SELECT doc_id AS document_id, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '') AS ws FROM documents")


@query("fixed_chunks", """
SELECT document_id, ((p - 1) // 400)::INT AS chunk_index, array_to_string(ws[p:p + 499], ' ') AS text, least(500, len(ws) - p + 1)::INT AS token_count FROM (
  SELECT document_id, ws, unnest(range(1, len(ws) + 1, 400)) AS p FROM cased)""", "cased")
def _(c):
    return K.fixed_chunks(c.documents)


@query("sentence_pack_chunks", r"""
WITH RECURSIVE s AS MATERIALIZED (SELECT document_id, s, row_number() OVER (PARTITION BY document_id ORDER BY i) AS i, len(list_filter(string_split_regex(s, '[ \n\t\r]+'), lambda x: x <> '')) AS n FROM (
  SELECT doc_id AS document_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(text, '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g')), lambda x: x <> '') AS l FROM documents))),
r AS (SELECT document_id, i, s, n AS used, 0 AS no FROM s WHERE i = 1 UNION ALL
  SELECT s.document_id, s.i, s.s, CASE WHEN r.used + s.n > 300 AND r.used > 0 THEN s.n ELSE r.used + s.n END, r.no + CASE WHEN r.used + s.n > 300 AND r.used > 0 THEN 1 ELSE 0 END
  FROM r JOIN s ON s.document_id = r.document_id AND s.i = r.i + 1)
SELECT document_id, no AS chunk_index, string_agg(s, ' ' ORDER BY i) AS text, len(list_filter(string_split_regex(string_agg(s, ' ' ORDER BY i), '[ \n\t\r]+'), lambda x: x <> ''))::INT AS token_count FROM r GROUP BY 1, 2""")
def _(c):
    return K.sentence_pack_chunks(c.documents)


@query("semantic_chunks")
def _(c):
    return K.semantic_chunks(_sectioned(c))


@query("code_chunks", r"""
SELECT document_id, k::INT AS chunk_index, string_agg(t, chr(10) ORDER BY i) AS text, len(list_filter(string_split_regex(string_agg(t, chr(10) ORDER BY i), '[ \n\t\r]+'), lambda x: x <> ''))::INT AS token_count FROM (
  SELECT doc_id AS document_id, unnest(l) AS t, generate_subscripts(l, 1) AS i, (generate_subscripts(l, 1) - 1) // 80 AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents WHERE text <> '')) GROUP BY 1, 2""")
def _(c):
    return K.code_chunks(c.documents)


@query("char_chunks", """
SELECT doc_id AS document_id, ((p - 1) // 1000)::INT AS chunk_index, substr(text, p, 1000) AS text FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, 1000)) AS p FROM documents)""")
def _(c):
    return K.char_chunks(c.documents)


cte("linked", """SELECT document_id, ((p - 1) // 400)::INT AS i, array_to_string(ws[p:p + 499], ' ') AS text FROM (SELECT document_id, ws, unnest(range(1, len(ws) + 1, 400)) AS p FROM cased)""", "cased")


@query("link_chunks", """
SELECT document_id, i AS chunk_index, sha256(document_id || ':' || i) AS chunk_id, lag(i) OVER w AS previous_index, lead(i) OVER w AS next_index, length(text)::INT AS character_count,
  greatest(1, floor(len(string_split(text, ' ')) * 1.3))::INT AS token_count FROM linked WINDOW w AS (PARTITION BY document_id ORDER BY i)""", "linked")
def _(c):
    return K.link_chunks(K.fixed_chunks(c.documents))


@query("broken_sequences", """
SELECT conv_id AS document_id, count(*) AS n, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS distinct_n FROM conversations WHERE role <> 'system' GROUP BY 1 HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)""")
def _(c):
    return K.broken_sequences(c.turns.filter("role <> 'system'").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index")))


@query("document_tree", """
WITH RECURSIVE n AS (SELECT o_orderkey AS node_id, CASE WHEN o_orderkey % 17 = 0 THEN -5 WHEN o_orderkey = 0 THEN NULL ELSE o_orderkey // 3 END AS parent_id FROM orders),
t AS (SELECT node_id, CASE WHEN parent_id IN (SELECT node_id FROM n) AND parent_id <> node_id THEN parent_id END AS parent_id FROM n),
r AS (SELECT node_id, parent_id, 1 AS depth FROM t WHERE parent_id IS NULL UNION ALL SELECT t.node_id, t.parent_id, r.depth + 1 FROM r JOIN t ON t.parent_id = r.node_id)
SELECT * FROM r""")
def _(c):
    k = F.col("o_orderkey")
    nodes = c.table("orders").select(k.alias("node_id"), F.when(k % 17 == 0, -5).when(k == 0, None).otherwise(F.floor(k / 3)).alias("parent_id"))
    return K.document_tree(nodes)
