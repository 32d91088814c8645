"""Readers of bibliographic feeds into one record schema.

Each feed has a fixed schema, a mapper over already parsed rows, and a reader for a path.
Records: ``provider, provider_id, title, abstract, authors, doi, url, published, venue,
journal, citation_count, pdf_url``. Nothing is inferred, so a read is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPENALEX_SCHEMA = """
id string, title string, doi string, publication_date string, cited_by_count long,
authorships array<struct<author: struct<display_name: string>>>,
abstract_inverted_index map<string, array<int>>,
primary_location struct<source: struct<display_name: string, type: string>>,
best_oa_location struct<pdf_url: string>, locations array<struct<pdf_url: string>>
"""

_PARTS = "struct<`date-parts`: array<array<int>>>"
CROSSREF_SCHEMA = f"""
DOI string, title array<string>, author array<struct<given: string, family: string>>,
`container-title` array<string>, publisher string, URL string, abstract string,
`is-referenced-by-count` long, `published-print` {_PARTS}, `published-online` {_PARTS},
published {_PARTS}, issued {_PARTS}, created {_PARTS}
"""

SEMANTIC_SCHOLAR_SCHEMA = """
paperId string, externalIds struct<DOI: string>, title string, abstract string,
publicationDate string, year int, openAccessPdf struct<url: string>, venue string,
journal struct<name: string>, authors array<struct<name: string>>, url string, citationCount long
"""

ARXIV_SCHEMA = """
id string, title string, summary string, published string,
author array<struct<name: string>>, category array<struct<_term: string>>,
link array<struct<_href: string, _type: string, _title: string>>, doi string
"""


def clean(value: Column) -> Column:
    """Ends trimmed, blank becomes null."""
    return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


def _one_line(value: Column) -> Column:
    return clean(F.regexp_replace(value, r"\s+", " "))


def bare_doi(value: Column) -> Column:
    return clean(F.regexp_replace(clean(value), r"^(?:https?://(?:dx\.)?doi\.org/|doi:|DOI:)", ""))


def iso_date(value: Column) -> Column:
    """Date of an ISO date or date-time; anything else is null."""
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(value, 1, 10).try_cast("date"))


def date_from_parts(parts: Column) -> Column:
    """``[[year, month, day]]`` with month and day defaulting to 1; impossible dates are null."""
    first = F.get(parts, F.lit(0))

    def piece(i: int) -> Column:
        return F.coalesce(F.get(first, F.lit(i)), F.lit(1))

    return F.when(
        F.get(first, F.lit(0)).isNotNull(),
        F.format_string("%04d-%02d-%02d", F.get(first, F.lit(0)), piece(1), piece(2)).try_cast("date"),
    )


def abstract_from_inverted_index(index: Column) -> Column:
    """Words put back at their positions."""
    placed = F.flatten(F.transform(
        F.map_entries(index),
        lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))),
    ))
    return clean(F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " "))


def _names(people: Column) -> Column:
    return F.filter(people, lambda n: n.isNotNull())


def openalex(rows: DataFrame) -> DataFrame:
    key = clean(F.col("id"))
    source = F.col("primary_location.source")
    pdf = F.filter(F.transform("locations", lambda l: clean(l["pdf_url"])), lambda u: u.isNotNull())
    return rows.filter(key.isNotNull()).select(
        F.lit("openalex").alias("provider"),
        F.when(F.contains(key, F.lit("/W")), F.element_at(F.split(key, "/"), -1)).otherwise(key).alias("provider_id"),
        clean(F.col("title")).alias("title"),
        abstract_from_inverted_index(F.col("abstract_inverted_index")).alias("abstract"),
        F.coalesce(_names(F.transform("authorships", lambda a: clean(a["author"]["display_name"]))), F.array().cast("array<string>")).alias("authors"),
        bare_doi(F.col("doi")).alias("doi"), key.alias("url"),
        iso_date(F.col("publication_date")).alias("published"),
        clean(source["display_name"]).alias("venue"),
        F.when(source["type"] == "journal", clean(source["display_name"])).alias("journal"),
        F.col("cited_by_count").alias("citation_count"),
        F.coalesce(clean(F.col("best_oa_location.pdf_url")), F.get(pdf, F.lit(0))).alias("pdf_url"),
    )


def crossref(rows: DataFrame) -> DataFrame:
    doi = bare_doi(F.col("DOI"))
    journal = clean(F.get("container-title", F.lit(0)))
    names = F.transform("author", lambda a: clean(F.concat_ws(" ", clean(a["given"]), clean(a["family"]))))
    dates = [date_from_parts(F.col(f"`{n}`")["date-parts"]) for n in ("published-print", "published-online", "published", "issued", "created")]
    return rows.filter(doi.isNotNull()).select(
        F.lit("crossref").alias("provider"), doi.alias("provider_id"),
        clean(F.get("title", F.lit(0))).alias("title"),
        clean(F.regexp_replace("abstract", r"<[^>]+>", "")).alias("abstract"),
        F.coalesce(_names(names), F.array().cast("array<string>")).alias("authors"),
        doi.alias("doi"), clean(F.col("URL")).alias("url"), F.coalesce(*dates).alias("published"),
        F.coalesce(journal, clean(F.col("publisher"))).alias("venue"), journal.alias("journal"),
        F.col("is-referenced-by-count").alias("citation_count"), F.lit(None).cast("string").alias("pdf_url"),
    )


def semantic_scholar(rows: DataFrame) -> DataFrame:
    venue = clean(F.col("venue"))
    by_year = F.when(F.col("year") > 0, F.format_string("%04d-01-01", "year").try_cast("date"))
    return rows.filter(clean(F.col("paperId")).isNotNull()).select(
        F.lit("semantic_scholar").alias("provider"), clean(F.col("paperId")).alias("provider_id"),
        clean(F.col("title")).alias("title"), clean(F.col("abstract")).alias("abstract"),
        F.coalesce(_names(F.transform("authors", lambda a: clean(a["name"]))), F.array().cast("array<string>")).alias("authors"),
        bare_doi(F.col("externalIds.DOI")).alias("doi"), clean(F.col("url")).alias("url"),
        F.coalesce(iso_date(F.col("publicationDate")), by_year).alias("published"),
        venue.alias("venue"), F.coalesce(clean(F.col("journal.name")), venue).alias("journal"),
        F.col("citationCount").alias("citation_count"), clean(F.col("openAccessPdf.url")).alias("pdf_url"),
    )


def arxiv(rows: DataFrame) -> DataFrame:
    tail = F.regexp_replace(clean(F.col("id")), r"^(?:https?://arxiv\.org/(?:abs|pdf)/|arXiv:|arxiv:)", "")
    key = clean(F.regexp_replace(F.regexp_replace(tail, r"(?i)\.pdf$", ""), r"/+$", ""))
    terms = F.array_distinct(_names(F.transform("category", lambda t: clean(t["_term"]))))
    pdf = F.filter("link", lambda l: clean(l["_href"]).isNotNull() & (
        F.coalesce(l["_type"] == "application/pdf", F.lit(False)) | F.coalesce(F.lower(l["_title"]) == "pdf", F.lit(False))
        | F.contains(l["_href"], F.lit("/pdf/"))))
    return rows.filter(key.isNotNull()).select(
        F.lit("arxiv").alias("provider"), key.alias("provider_id"),
        _one_line(F.col("title")).alias("title"), _one_line(F.col("summary")).alias("abstract"),
        F.coalesce(_names(F.transform("author", lambda a: clean(a["name"]))), F.array().cast("array<string>")).alias("authors"),
        clean(F.col("doi")).alias("doi"), F.concat(F.lit("https://arxiv.org/abs/"), key).alias("url"),
        iso_date(F.col("published")).alias("published"),
        F.when(F.size(terms) > 0, F.array_join(terms, ", ")).otherwise("arXiv").alias("venue"),
        F.lit(None).cast("string").alias("journal"), F.lit(None).cast("long").alias("citation_count"),
        clean(F.get(pdf, F.lit(0))["_href"]).alias("pdf_url"),
    )


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    return openalex(spark.read.schema(OPENALEX_SCHEMA).json(path))


def read_crossref(spark: SparkSession, path: str) -> DataFrame:
    return crossref(spark.read.schema(CROSSREF_SCHEMA).json(path))


def read_semantic_scholar(spark: SparkSession, path: str) -> DataFrame:
    return semantic_scholar(spark.read.schema(SEMANTIC_SCHOLAR_SCHEMA).json(path))


def read_arxiv_atom(spark: SparkSession, path: str) -> DataFrame:
    return arxiv(spark.read.schema(ARXIV_SCHEMA).format("xml").option("rowTag", "entry").load(path))


def union_providers(feeds: list[DataFrame]) -> DataFrame:
    merged = feeds[0]
    for feed in feeds[1:]:
        merged = merged.unionByName(feed, allowMissingColumns=True)
    return merged


def lookup_by_doi(wanted: DataFrame, records: DataFrame, order: list[str]) -> DataFrame:
    """For each wanted DOI the record of the first provider, in ``order``, that holds it."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider"))
    others = [c for c in records.columns if c != "doi"]
    ranked = F.struct(F.when(place > 0, place).otherwise(len(order) + 1), F.col("provider"), F.col("provider_id"))
    held = records.join(wanted.select("doi").distinct(), "doi", "left_semi")
    return held.groupBy("doi").agg(F.min_by(F.struct(*others), ranked).alias("r")).select("doi", "r.*")


# fixed values: fields that may hold the document address, best first
URL_FIELDS = ("pdf_url", "document_url", "download_url", "full_text_url", "open_access_url", "url")


def resolve_document_url(records: DataFrame) -> DataFrame:
    """Best document address of a record and whether it looks like a PDF."""
    present = [clean(F.col(n)) for n in URL_FIELDS if n in records.columns]
    url = F.coalesce(*present)
    path = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    return records.withColumn("document_url", url).withColumn("is_pdf", F.contains(path, F.lit("pdf")))
