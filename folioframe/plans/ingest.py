"""Feeds, record cleaning and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import ids
from folioframe.functions import text as X
from folioframe.functions.lexicon import PRESENCE_STOP, SECTION_FAMILIES
from folioframe.operators import clean as C
from folioframe.plans import base as B
from folioframe.plans.registry import cte, query
from folioframe.sources import feeds, files


def sq(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \n\t\r]+', ' ', 'g'))"


cte("records", r"""SELECT o_orderkey * 2 + feed AS arrival, o_orderkey AS k, feed, CASE feed WHEN 0 THEN 'openalex' ELSE 'crossref' END AS provider,
  CASE feed WHEN 0 THEN 'https://openalex.org/w' || o_orderkey ELSE 'cr-' || o_orderkey END AS provider_id,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN feed = 0 AND o_orderkey % 4 = 0 THEN ' https://doi.org/10.1000/ORD.' || o_orderkey || '. '
    WHEN feed = 0 AND o_orderkey % 4 = 1 THEN 'doi:10.1000/Ord.' || o_orderkey WHEN feed = 0 THEN 'http://dx.doi.org/10.1000/ord.' || o_orderkey || ','
    ELSE '10.1000/ORD.' || o_orderkey END AS doi,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE feed WHEN 0 THEN 'arXiv:2101.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || 'v2'
    ELSE 'https://arxiv.org/abs/2101.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || '?x=1' END END AS arxiv_id,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE feed WHEN 0 THEN 'pmid:' ELSE 'https://pubmed.ncbi.nlm.nih.gov/' END || o_orderkey ||
    CASE WHEN o_orderkey % 10 = 0 THEN '/' ELSE '' END END AS pmid,
  CASE WHEN o_orderkey % 50 = 49 THEN '  ' ELSE '  Study  ' || (o_custkey % 97) || CASE feed WHEN 0 THEN ' of ' ELSE chr(9) || 'OF ' END || lower(o_orderstatus) || ' ' END AS title,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Priority' || chr(10) || o_orderpriority END AS abstract,
  'c. ' || year(o_orderdate) || CASE feed WHEN 0 THEN '' ELSE '-01-01' END AS published,
  CASE feed WHEN 0 THEN 'Customer  ' || o_custkey || '; Clerk ' || (o_orderkey % 11) || ' ,Customer ' || o_custkey ELSE 'Clerk ' || (o_orderkey % 11) END AS authors,
  CASE WHEN feed = 0 THEN o_orderpriority END AS venue, CASE WHEN feed = 1 THEN o_orderpriority END AS journal,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'https://example.org/' || o_orderkey || CASE feed WHEN 0 THEN '.pdf' ELSE '' END END AS pdf_url,
  ' https://example.org/view/' || o_orderkey || ' ' AS url,
  o_orderstatus || ';' || lower(o_orderstatus) || '; ' || lower(o_orderpriority) || ';;' || o_orderpriority AS keywords
  FROM orders CROSS JOIN (SELECT unnest([0, 1]) AS feed)""")

# -- feeds ------------------------------------------------------------------------------


def through_json(df, schema):
    """Rows as JSON text and back through the feed's own schema."""
    text = df.select(F.to_json(F.struct("*")).alias("j"))
    return text.select(F.from_json("j", schema).alias("r")).select("r.*")


def _openalex_rows(c):
    k = F.col("o_orderkey")
    key = k.cast("string")
    return through_json(c.table("orders").select(
        F.concat(F.lit("https://openalex.org/W"), key).alias("id"),
        F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" Work "), key)).alias("title"),
        F.when(k % 4 != 3, F.concat(F.lit("https://doi.org/10.1000/W."), key)).alias("doi"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        F.floor(F.col("o_totalprice") / 1000).alias("cited_by_count"),
        F.array(F.struct(F.struct(F.concat(F.lit(" Customer "), F.col("o_custkey").cast("string")).alias("display_name")).alias("author")),
                F.struct(F.struct(F.lit(None).cast("string").alias("display_name")).alias("author"))).alias("authorships"),
        F.create_map(F.lit("priority"), F.array(F.lit(1)), F.lit("the"), F.array(F.lit(0), F.lit(2)), F.col("o_orderpriority"), F.array(F.lit(3))).alias("abstract_inverted_index"),
        F.struct(F.struct(F.col("o_orderstatus").alias("display_name"), F.when(k % 2 == 0, "journal").otherwise("repository").alias("type")).alias("source")).alias("primary_location"),
        F.struct(F.when(k % 3 == 0, F.concat(F.lit("https://x.org/"), key)).alias("pdf_url")).alias("best_oa_location"),
        F.array(F.struct(F.lit(None).cast("string").alias("pdf_url")), F.struct(F.concat(F.lit("https://y.org/"), key).alias("pdf_url"))).alias("locations"),
    ), feeds.OPENALEX_SCHEMA)


def _crossref_rows(c):
    k = F.col("o_orderkey")
    key = k.cast("string")
    day = F.col("o_orderdate")
    part = lambda *xs: F.struct(F.array(F.array(*xs)).alias("date-parts"))
    return through_json(c.table("orders").select(
        F.when(k % 10 != 7, F.concat(F.lit("doi:10.1000/W."), key)).alias("DOI"),
        F.array(F.concat(F.lit("Work "), key)).alias("title"),
        F.array(F.struct(F.lit("Ann").alias("given"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("family")),
                F.struct(F.lit(None).cast("string").alias("given"), F.lit(" Lone ").alias("family"))).alias("author"),
        F.when(k % 3 == 0, F.array(F.col("o_orderpriority"))).otherwise(F.array().cast("array<string>")).alias("container-title"),
        F.lit("House").alias("publisher"), F.concat(F.lit("https://doi.org/10.1000/W."), key).alias("URL"),
        F.concat(F.lit("<jats:p>Status <b>"), "o_orderstatus", F.lit("</b></jats:p> ")).alias("abstract"),
        F.floor(F.col("o_totalprice") / 1000).alias("is-referenced-by-count"),
        F.when(k % 4 == 0, part(F.year(day), F.lit(13))).alias("published-print"),
        F.when(k % 4 == 1, part(F.year(day))).when(k % 4 == 2, part(F.year(day), F.month(day))).otherwise(part(F.year(day), F.month(day), F.dayofmonth(day))).alias("issued"),
    ), feeds.CROSSREF_SCHEMA)


def _s2_rows(c):
    k = F.col("o_orderkey")
    key = k.cast("string")
    return through_json(c.table("orders").select(
        F.concat(F.lit("s2-"), key).alias("paperId"),
        F.struct(F.when(k % 5 != 0, F.concat(F.lit("10.1000/W."), key)).alias("DOI")).alias("externalIds"),
        F.concat(F.lit("Work "), key).alias("title"), F.lit(" ").alias("abstract"),
        F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("publicationDate"),
        F.year("o_orderdate").alias("year"), F.struct(F.concat(F.lit("https://z.org/"), key).alias("url")).alias("openAccessPdf"),
        F.col("o_orderpriority").alias("venue"), F.when(k % 3 == 0, F.struct(F.lit("J").alias("name"))).alias("journal"),
        F.array(F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("name"))).alias("authors"),
        F.concat(F.lit("https://s2.org/"), key).alias("url"), F.floor(F.col("o_totalprice") / 1000).alias("citationCount"),
    ), feeds.SEMANTIC_SCHOLAR_SCHEMA)


def _arxiv_rows(c):
    k = F.col("o_orderkey")
    key = k.cast("string")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2101."), key, F.lit("v1</id><title>Work\n  "), key, F.lit("</title><summary> Sum  of "), F.col("o_orderstatus"),
        F.lit("</summary><published>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z</published><author><name>C"), F.col("o_custkey").cast("string"),
        F.lit("</name></author><author><name>Second</name></author><category term=\"cs.CL\"/><category term=\"cs.IR\"/><category term=\"cs.CL\"/>"),
        F.lit("<link href=\"http://arxiv.org/abs/2101."), key, F.lit("\" type=\"text/html\"/><link title=\"pdf\" href=\"http://arxiv.org/pdf/2101."), key,
        F.lit("\" type=\"application/pdf\"/>"), F.when(k % 2 == 0, F.concat(F.lit("<doi>10.1000/W."), key, F.lit("</doi>"))).otherwise(""), F.lit("</entry>"))
    return c.table("orders").select(F.from_xml(entry, feeds.ARXIV_SCHEMA.replace("\n", " ")).alias("r")).select("r.*")


def flat(df):
    return df.withColumn("authors", F.array_join("authors", "|")).withColumn("published", F.date_format("published", "yyyy-MM-dd"))


@query("read_openalex", """
SELECT 'openalex' AS provider, 'W' || o_orderkey AS provider_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'Work ' || o_orderkey END AS title,
  'the priority the ' || o_orderpriority AS abstract, 'Customer ' || o_custkey AS authors, CASE WHEN o_orderkey % 4 <> 3 THEN '10.1000/W.' || o_orderkey END AS doi,
  'https://openalex.org/W' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS published, o_orderstatus AS venue,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS journal, floor(o_totalprice / 1000)::BIGINT AS citation_count,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://x.org/' ELSE 'https://y.org/' END || o_orderkey AS pdf_url FROM orders""")
def _(c):
    return flat(feeds.openalex(_openalex_rows(c)))


@query("abstract_from_inverted_index", """
SELECT item_id, array_to_string(regexp_extract_all(text, '[^ ]+'), ' ') AS abstract FROM
  (SELECT item_id, trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g')) AS text FROM benchmark)""")
def _(c):
    at = c.table("benchmark").select("item_id", F.posexplode(X.words(F.col("text"))).alias("p", "w"))
    index = at.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("idx"))
    return index.select("item_id", feeds.abstract_from_inverted_index(F.col("idx")).alias("abstract"))


@query("read_crossref", """
SELECT 'crossref' AS provider, '10.1000/W.' || o_orderkey AS provider_id, 'Work ' || o_orderkey AS title, 'Status ' || o_orderstatus AS abstract,
  'Ann C' || o_custkey || '|Lone' AS authors, '10.1000/W.' || o_orderkey AS doi, 'https://doi.org/10.1000/W.' || o_orderkey AS url,
  CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%Y-01-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'House' END AS venue, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS journal,
  floor(o_totalprice / 1000)::BIGINT AS citation_count, NULL::VARCHAR AS pdf_url FROM orders WHERE o_orderkey % 10 <> 7""")
def _(c):
    return flat(feeds.crossref(_crossref_rows(c)))


@query("date_from_parts", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-01-01') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01')
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def _(c):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    parts = F.when(k == 0, F.array(F.array(F.year(d)))).when(k == 1, F.array(F.array(F.year(d), F.month(d)))).when(
        k == 2, F.array(F.array(F.year(d), F.month(d), F.dayofmonth(d)))).otherwise(F.array(F.array(F.year(d), F.lit(2), F.lit(30))))
    return c.table("orders").select("o_orderkey", F.date_format(feeds.date_from_parts(parts), "yyyy-MM-dd").alias("day"))


@query("read_semantic_scholar", """
SELECT 'semantic_scholar' AS provider, 's2-' || o_orderkey AS provider_id, 'Work ' || o_orderkey AS title, NULL::VARCHAR AS abstract, 'C' || o_custkey AS authors,
  CASE WHEN o_orderkey % 5 <> 0 THEN '10.1000/W.' || o_orderkey END AS doi, 'https://s2.org/' || o_orderkey AS url,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-01-01') END AS published, o_orderpriority AS venue,
  CASE WHEN o_orderkey % 3 = 0 THEN 'J' ELSE o_orderpriority END AS journal, floor(o_totalprice / 1000)::BIGINT AS citation_count,
  'https://z.org/' || o_orderkey AS pdf_url FROM orders""")
def _(c):
    return flat(feeds.semantic_scholar(_s2_rows(c)))


@query("read_arxiv_atom", """
SELECT 'arxiv' AS provider, '2101.' || o_orderkey || 'v1' AS provider_id, 'Work ' || o_orderkey AS title, 'Sum of ' || o_orderstatus AS abstract,
  'C' || o_custkey || '|Second' AS authors, CASE WHEN o_orderkey % 2 = 0 THEN '10.1000/W.' || o_orderkey END AS doi,
  'https://arxiv.org/abs/2101.' || o_orderkey || 'v1' AS url, strftime(o_orderdate, '%Y-%m-%d') AS published, 'cs.CL, cs.IR' AS venue,
  NULL::VARCHAR AS journal, NULL::BIGINT AS citation_count, 'http://arxiv.org/pdf/2101.' || o_orderkey AS pdf_url FROM orders""")
def _(c):
    return flat(feeds.arxiv(_arxiv_rows(c)))


def _all_feeds(c):
    return feeds.union_providers([feeds.openalex(_openalex_rows(c)), feeds.crossref(_crossref_rows(c)), feeds.semantic_scholar(_s2_rows(c))])


@query("union_providers", """
SELECT provider, count(*) AS records, count(doi) AS with_doi FROM (
  SELECT 'openalex' AS provider, CASE WHEN o_orderkey % 4 <> 3 THEN 1 END AS doi FROM orders UNION ALL
  SELECT 'crossref', 1 FROM orders WHERE o_orderkey % 10 <> 7 UNION ALL
  SELECT 'semantic_scholar', CASE WHEN o_orderkey % 5 <> 0 THEN 1 END FROM orders) GROUP BY 1""")
def _(c):
    return _all_feeds(c).groupBy("provider").agg(F.count(F.lit(1)).alias("records"), F.count("doi").alias("with_doi"))


@query("lookup_by_doi", """
SELECT '10.1000/W.' || o_orderkey AS doi, CASE WHEN o_orderkey % 10 <> 7 THEN 'crossref' WHEN o_orderkey % 4 <> 3 THEN 'openalex' ELSE 'semantic_scholar' END AS provider,
  CASE WHEN o_orderkey % 10 <> 7 THEN '10.1000/W.' WHEN o_orderkey % 4 <> 3 THEN 'W' ELSE 's2-' END || o_orderkey AS provider_id
FROM orders WHERE o_orderkey % 10 <> 7 OR o_orderkey % 4 <> 3 OR o_orderkey % 5 <> 0""")
def _(c):
    wanted = c.table("orders").select(F.concat(F.lit("10.1000/W."), F.col("o_orderkey").cast("string")).alias("doi"))
    return feeds.lookup_by_doi(wanted, _all_feeds(c), ["crossref", "openalex", "semantic_scholar"]).select("doi", "provider", "provider_id")


@query("scan_files")
def _(c):
    return files.scan_files(c.spark, c.root, "*.parquet").select("file_name", "file_extension", "file_size", "sha256")


PAGE_SQL = sq(r"""replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
  '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')""")


@query("pages_to_documents", f"SELECT * FROM (SELECT page_id, url, {PAGE_SQL} AS text FROM pages) WHERE length(text) >= 50")
def _(c):
    return files.pages_to_documents(c.table("pages")).select("page_id", "url", "text")


@query("resolve_document_url", f"""
SELECT arrival, document_url, contains(lower(regexp_extract(document_url, '^https://[^/]*([^?#]*)', 1)), 'pdf') AS is_pdf FROM
  (SELECT arrival, coalesce(nullif(trim(pdf_url), ''), trim(url)) AS document_url FROM records)""", "records")
def _(c):
    return feeds.resolve_document_url(c.records).select("arrival", "document_url", "is_pdf")


@query("paper_documents", """
SELECT p.o_orderkey AS paper_id, count(DISTINCT d.doc_id) AS documents, count(DISTINCT l.doc_id) AS chunked,
  count(DISTINCT d.doc_id) > 0 AND count(DISTINCT l.doc_id) > 0 AS ingested
FROM orders p LEFT JOIN documents d ON d.doc_id // 2 = p.o_orderkey LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(c):
    from folioframe.operators import listing as L

    docs = c.documents.select("document_id", F.floor(F.col("document_id") / 2).alias("paper_id"))
    return L.paper_documents(c.papers.select("paper_id"), docs, c.labels.select("document_id"))


@query("write_corpus", """
SELECT doc_id AS chunk_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'seen ' || lang ELSE lang END AS lang, n_chars FROM documents""")
def _(c):
    import uuid

    from folioframe.session import checkpoint_dir

    path = f"{checkpoint_dir(c.spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    rows = c.documents.select(F.col("document_id").alias("chunk_id"), "lang", "n_chars")
    files.write_corpus(rows, path, "chunk_id", 16)
    labelled = rows.join(c.labels.select(F.col("document_id").alias("chunk_id")), "chunk_id", "left_semi")
    files.upsert_corpus(labelled.withColumn("lang", F.concat(F.lit("seen "), "lang")), path, "chunk_id", 16)
    return c.spark.read.parquet(path).drop("bucket")


# -- cleaning ---------------------------------------------------------------------------


def _normalized(c):
    return C.normalize_papers(c.records.withColumn("authors", F.split("authors", "[;,]")).withColumn("keywords", F.split("keywords", ";")))


SQ_DOI = f"regexp_replace({sq('doi')}, '^(https?://)?(dx\\.)?doi\\.org/', '', 'i')"
cte("normalized", f"""SELECT arrival, provider, nullif({sq('title')}, '') AS title, nullif({sq('abstract')}, '') AS abstract, nullif({sq('venue')}, '') AS venue,
  nullif(lower(regexp_replace(trim({SQ_DOI}), '\\.+$', '')), '') AS doi, nullif(trim(arxiv_id), '') AS arxiv_id, nullif(trim(pmid), '') AS pmid, nullif(trim(url), '') AS url,
  array_to_string(list_filter(list_transform(regexp_split_to_array(authors, '[;,]'), lambda x: {sq('x')}), lambda x: x <> ''), '|') AS authors,
  o.o_orderstatus || '|' || lower(o.o_orderstatus) || '|' || lower(o.o_orderpriority) || '|' || o.o_orderpriority AS keywords
  FROM records r JOIN orders o ON o.o_orderkey = r.k""", "records")


@query("normalize_papers", "SELECT * FROM normalized", "normalized")
def _(c):
    return _normalized(c).select("arrival", "provider", "title", "abstract", "venue", "doi", "arxiv_id", "pmid", "url",
                                 F.array_join("authors.name", "|").alias("authors"), F.array_join("keywords", "|").alias("keywords"))


cte("strict", """SELECT *, CASE WHEN doi IS NOT NULL THEN '10.1000/ord.' || k END AS doi_norm,
  CASE WHEN arxiv_id IS NOT NULL THEN '2101.' || lpad((k % 100000)::VARCHAR, 5, '0') END AS arxiv_norm,
  CASE WHEN pmid IS NOT NULL THEN k::VARCHAR END AS pmid_norm, CASE WHEN feed = 0 THEN 'W' || k END AS openalex_norm FROM records""", "records")


@query("normalize_doi", r"""
SELECT arrival, lower(nullif(regexp_extract(regexp_replace(regexp_replace(trim(doi), '^(https?://(dx\.)?doi\.org/|doi:)', '', 'i'), '[.,; ]+$', ''), '^10\.[0-9]{4,9}/[^ ]+$'), '')) AS doi FROM records""", "records")
def _(c):
    return c.records.select("arrival", ids.doi(F.col("doi")).alias("doi"))


@query("normalize_arxiv", "SELECT arrival, arxiv_norm AS arxiv_id FROM strict", "strict")
def _(c):
    return c.records.select("arrival", ids.arxiv(F.col("arxiv_id")).alias("arxiv_id"))


@query("normalize_pmid", "SELECT arrival, pmid_norm AS pmid FROM strict", "strict")
def _(c):
    return c.records.select("arrival", ids.pmid(F.col("pmid")).alias("pmid"))


@query("normalize_openalex", "SELECT arrival, CASE WHEN feed = 0 THEN openalex_norm END AS openalex_id FROM strict", "strict")
def _(c):
    return c.records.select("arrival", ids.openalex(F.col("provider_id")).alias("openalex_id"))


@query("resolve_fields", f"""
SELECT arrival, nullif({sq('title')}, '') AS resolved_title, nullif({sq('abstract')}, '') AS resolved_abstract, coalesce(venue, journal) AS resolved_venue,
  regexp_extract(published, '[0-9]{{4}}')::INT AS resolved_year, CASE WHEN doi_norm IS NOT NULL THEN 'https://doi.org/' || doi_norm ELSE trim(url) END AS resolved_url FROM strict""", "strict")
def _(c):
    return C.resolve_fields(c.records).select("arrival", "resolved_title", "resolved_abstract", "resolved_venue", "resolved_year", "resolved_url")


@query("publication_year", r"""
SELECT o_orderkey, nullif(regexp_extract(CASE o_orderkey % 4 WHEN 0 THEN 'c. ' || year(o_orderdate) WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN 2 THEN '0' || year(o_orderdate) ELSE 'vol 2101, ' || year(o_orderdate) END, '\b(1[0-9]{3}|20[0-9]{2}|2100)\b', 1), '')::INT AS year FROM orders""")
def _(c):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    y = F.year(d).cast("string")
    raw = F.when(k == 0, F.concat(F.lit("c. "), y)).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.concat(F.lit("0"), y)).otherwise(F.concat(F.lit("vol 2101, "), y))
    return c.table("orders").select("o_orderkey", ids.year(raw).alias("year"))


@query("resolve_authors", """
SELECT arrival, CASE feed WHEN 0 THEN 'Customer ' || o_custkey || '|Clerk ' || (k % 11) ELSE 'Clerk ' || (k % 11) END AS authors
FROM records JOIN orders ON o_orderkey = k""", "records")
def _(c):
    return c.records.select("arrival", F.array_join(C.resolve_authors(F.col("authors")), "|").alias("authors"))


@query("normalize_keywords", """
SELECT arrival, o_orderstatus || '|' || lower(o_orderpriority) AS keywords FROM records JOIN orders ON o_orderkey = k""", "records")
def _(c):
    return c.records.select("arrival", F.array_join(C.normalize_keywords(F.split("keywords", ";")), "|").alias("keywords"))


@query("validate_papers", """
SELECT arrival, title IS NOT NULL AND length(title) >= 2 AS accepted, CASE WHEN title IS NULL THEN 'title is required' WHEN length(title) < 2 THEN 'title is too short' ELSE '' END AS errors FROM normalized""", "normalized")
def _(c):
    return C.validate_papers(_normalized(c)).select("arrival", "accepted", F.array_join("errors", "|").alias("errors"))


cte("confidence", """SELECT *, CASE WHEN s >= 0.85 THEN 'high' WHEN s >= 0.60 THEN 'medium' ELSE 'low' END AS confidence_level FROM (SELECT arrival, round(
  CASE WHEN title IS NULL THEN 0 ELSE 0.25 END + CASE WHEN abstract IS NULL THEN 0 ELSE 0.15 END + 0.15 + 0.10 +
  CASE WHEN doi IS NULL THEN 0 ELSE 0.15 END + CASE WHEN venue IS NULL THEN 0 ELSE 0.05 END + CASE WHEN url IS NULL THEN 0 ELSE 0.05 END, 4)::DOUBLE AS s FROM normalized)""", "normalized")


@query("metadata_confidence", "SELECT arrival, s AS confidence_score, confidence_level FROM confidence", "confidence")
def _(c):
    return C.metadata_confidence(_normalized(c)).select("arrival", "confidence_score", "confidence_level")


@query("clean_text", r"""
SELECT doc_id AS document_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def _(c):
    return c.documents.select("document_id", C.clean_text(F.col("text")).alias("text"))


@query("normalize_lines", r"""
SELECT doc_id AS document_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)),
  lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text FROM documents""")
def _(c):
    return c.documents.select("document_id", C.normalize_lines(F.col("text")).alias("text"))


@query("year_range_filter", "SELECT o_orderkey AS paper_id, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999")
def _(c):
    return C.year_range_filter(c.papers.select("paper_id", "year"), 1997, 1999)


@query("parse_query_filters", """
SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 2010 + item_id % 9 WHEN 1 THEN 2015 END::INT AS year_from,
  CASE item_id % 3 WHEN 0 THEN 2020 WHEN 1 THEN 2015 END::INT AS year_to, 'ann ' || item_id AS author, CASE WHEN item_id % 2 = 0 THEN 'nlp' END AS topic,
  'src' || (item_id % 20) AS source, NULL::VARCHAR AS venue, 'd' || item_id AS document_id, CASE WHEN item_id % 5 = 0 THEN 'p2' END AS paper_id, 'web' AS source_type FROM benchmark""")
def _(c):
    q = F.col("query_id")
    s = q.cast("string")
    tail = F.concat(
        F.when(q % 3 == 0, F.concat(F.lit(" year:"), (q % 9 + 2010).cast("string"), F.lit("-2020"))).when(q % 3 == 1, " year:2015").otherwise(""),
        F.lit(' Author:"ann '), s, F.lit('" '), F.when(q % 2 == 0, "topic:nlp ").otherwise(""), F.lit("source:src"), (q % 20).cast("string"),
        F.lit(" document:d"), s, F.when(q % 5 == 0, " paper:p1 paper:p2").otherwise(""), F.lit(" source_type:web"))
    return C.parse_query_filters(c.queries.withColumn("text", F.concat("text", tail)))


# -- paper search -----------------------------------------------------------------------


def _searchable(c):
    nations = c.table("nation").select(F.col("n_nationkey").alias("venue_id"), F.col("n_name").alias("venue_name"))
    authors = c.paper_authors.join(c.authors, "author_id").select("paper_id", F.col("name").alias("author_name"))
    return c.papers.join(nations, "venue_id", "left"), authors


cte("searchable", """SELECT o_orderkey AS paper_id, 'Study ' || (o_custkey % 97) || ' of ' || lower(o_orderstatus) AS title, o_orderpriority AS provider,
  o_orderdate::DATE AS published, year(o_orderdate)::INT AS year, floor(o_totalprice / 1000)::BIGINT AS citation_count, n_nationkey AS venue_id, n_name AS venue_name
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")


@query("paper_search", """
SELECT paper_id, title, citation_count, year FROM searchable WHERE (title ILIKE '%study 1%' OR venue_name ILIKE '%study 1%' OR paper_id IN
  (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_name ILIKE '%study 1%'))
  AND published >= DATE '1996-01-01' AND published < DATE '2000-12-31' + 1 AND paper_id IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_name ILIKE '%1%')
  AND paper_id IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type ILIKE '%econ%')
ORDER BY citation_count DESC NULLS LAST, paper_id DESC LIMIT 20 OFFSET 20""", "searchable")
def _(c):
    papers, authors = _searchable(c)
    topics = c.paper_topics.filter(F.ilike("topic", F.lit("%econ%"))).select("paper_id").distinct()
    found = C.paper_matches(papers, authors, {"query": "study 1", "author": "1", "published_from": "1996-01-01", "published_to": "2000-12-31", "topics": topics})
    return C.paper_page(found, "citation_count", True, 20, 20).select("paper_id", "title", "citation_count", "year")


@query("paper_search_total", """
SELECT count(*) AS total FROM searchable WHERE title ILIKE '%study 1%' AND venue_id = 7 AND year = 1997 AND provider = '1-URGENT'""", "searchable")
def _(c):
    papers, authors = _searchable(c)
    return C.paper_total(C.paper_matches(papers, authors, {"query": "study 1", "venue": "7", "year": 1997, "provider": "1-URGENT"}))


@query("search_text", """
SELECT paper_id, title FROM searchable WHERE title ILIKE '%of f%' OR venue_name ILIKE '%of f%' OR paper_id IN
  (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_name ILIKE '%of f%') ORDER BY published DESC, paper_id DESC LIMIT 20""", "searchable")
def _(c):
    papers, authors = _searchable(c)
    return C.paper_page(C.paper_matches(papers, authors, {"query": "of f"})).select("paper_id", "title")


# -- sections and presence --------------------------------------------------------------

HEADINGS = ("Abstract", "1. Introduction", "II) Related  Work", "3.1 Methodology", "Materials and methods", "A. Experimental setup:", "Findings",
            "IV Concluding remarks", "Acknowledgements.", "6 Future directions", "Bibliography", "Notes on the corpus", "Appendix")
FAMILY_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(lower(bare), '{p}') THEN '{n}'" for n, p in SECTION_FAMILIES) + " ELSE 'other' END"


@query("classify_sections", rf"""
SELECT l_orderkey, l_linenumber, l_partkey, number, bare AS section_title, {FAMILY_SQL} AS section_type FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, nullif(regexp_extract(t, '(?i)^\s*([IVXLCDM]+|[0-9]+(?:\.[0-9]+)*|[A-Z])[\s.):-]+(.+?)\s*$', 1), '') AS number,
    CASE WHEN regexp_matches(t, '(?i)^\s*([IVXLCDM]+|[0-9]+(?:\.[0-9]+)*|[A-Z])[\s.):-]+(.+?)\s*$') THEN regexp_extract(t, '(?i)^\s*([IVXLCDM]+|[0-9]+(?:\.[0-9]+)*|[A-Z])[\s.):-]+(.+?)\s*$', 2) ELSE t END AS bare
  FROM (SELECT *, regexp_replace({sq("(" + str(list(HEADINGS)) + ")[l_partkey % " + str(len(HEADINGS)) + " + 1]")}, '^[ \t\r\n.:;-]+|[ \t\r\n.:;-]+$', '', 'g') AS t FROM lineitem))""")
def _(c):
    titles = F.array(*[F.lit(h) for h in HEADINGS])
    rows = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.get(titles, (F.col("l_partkey") % len(HEADINGS)).cast("int")).alias("title"))
    return C.classify_sections(rows).select("l_orderkey", "l_linenumber", "l_partkey", "number", "section_title", "section_type")


@query("presence_relevance", rf"""
SELECT query_id, chunk_id, hits, round(least(1.0, 0.75 * hits / n + CASE WHEN phrase THEN 0.15 ELSE 0 END + 0.1 * relevance), 6) AS relevance FROM (
  SELECT query_id, chunk_id, e.relevance, len(w) AS n, len(list_filter(w, lambda t: regexp_matches(body, '(^|[^a-z0-9])' || regexp_escape(t) || '($|[^a-z0-9])'))) AS hits,
    contains({sq('lower(e.text)')}, {sq('lower(b.text)')}) AS phrase FROM
    (SELECT *, lower(text || ' ' || source) AS body FROM evidence) e JOIN (SELECT item_id, text, list_distinct(list_filter(list_transform(
      regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9_.+/#-]*'), lambda t: trim(t, '._+-/#')),
      lambda t: length(t) >= 2 AND t NOT IN ({", ".join(f"'{w}'" for w in PRESENCE_STOP)}))) AS w FROM benchmark) b ON b.item_id = query_id) WHERE hits > 0""", "evidence")
def _(c):
    e = B.evidence(c).join(c.queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    return C.presence_relevance(e.drop("score").withColumnRenamed("relevance", "score").withColumn("meta_text", F.col("source")))
