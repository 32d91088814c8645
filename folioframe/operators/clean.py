"""Record cleaning: column expressions and row filters, no shuffle unless said so."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioframe.functions import ids
from folioframe.functions import text as X
from folioframe.functions.lexicon import PRESENCE_STOP, SECTION_FAMILIES
from folioframe.functions.scores import clamp01, r6


def present(value: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.length(X.squeeze(value)) > 0, F.lit(False))


def distinct_values(values: Column) -> Column:
    """List items squeezed, blank ones dropped, first occurrences kept in order."""
    cleaned = F.transform(values, lambda v: X.squeeze(v))
    return F.array_distinct(F.filter(cleaned, lambda v: v.isNotNull() & (v != "")))


def normalize_papers(records: DataFrame) -> DataFrame:
    """Squeeze texts, blank to null, plain DOI, trimmed ids, lists distinct in order.

    ``authors``, ``keywords`` are arrays of strings; authors become structs with a name.
    """
    doi = F.regexp_replace(X.blank_to_null(F.col("doi")), r"(?i)^(https?://)?(dx\.)?doi\.org/", "")
    return records.withColumns({
        "title": X.blank_to_null(F.col("title")),
        "abstract": X.blank_to_null(F.col("abstract")),
        "venue": X.blank_to_null(F.col("venue")),
        "doi": F.nullif(F.lower(F.regexp_replace(F.trim(doi), r"\.+$", "")), F.lit("")),
        "arxiv_id": F.nullif(F.trim("arxiv_id"), F.lit("")),
        "pmid": F.nullif(F.trim("pmid"), F.lit("")),
        "url": F.nullif(F.trim("url"), F.lit("")),
        "authors": F.transform(
            F.filter(F.transform("authors", lambda a: X.squeeze(a)), lambda a: a != ""), lambda a: F.struct(a.alias("name"))),
        "keywords": distinct_values(F.col("keywords")),
    })


def normalize_ids(records: DataFrame) -> DataFrame:
    """Strict identifiers next to the raw ones."""
    return records.withColumns({
        "doi_norm": ids.doi(F.col("doi")), "arxiv_norm": ids.arxiv(F.col("arxiv_id")),
        "pmid_norm": ids.pmid(F.col("pmid")),
        "openalex_norm": F.when(F.col("provider") == "openalex", ids.openalex(F.col("provider_id"))),
    })


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[X.blank_to_null(c) for c in columns])


def resolve_fields(records: DataFrame) -> DataFrame:
    """One value per field out of its alias columns; a DOI decides the address."""
    have = set(records.columns)

    def pick(*names: str) -> Column:
        return first_present(*[F.col(n) for n in names if n in have]) if have & set(names) else F.lit(None).cast("string")

    doi = ids.doi(F.col("doi")) if "doi" in have else F.lit(None).cast("string")
    return records.withColumns({
        "resolved_title": pick("title", "paper_title", "name"),
        "resolved_abstract": pick("abstract", "abstract_text", "summary", "description"),
        "resolved_venue": pick("venue", "journal", "journal_name", "container_title", "publication"),
        "resolved_publisher": pick("publisher", "publisher_name"),
        "resolved_year": ids.year(pick("publication_year", "year", "published_year", "published", "publication_date", "published_date")),
        "resolved_url": F.coalesce(
            F.concat(F.lit("https://doi.org/"), doi), pick("url", "paper_url", "landing_page", "landing_page_url", "web_url", "link")),
    })


def resolve_authors(value: Column) -> Column:
    """Author names of a ``,`` or ``;`` separated string, distinct in order."""
    return distinct_values(F.split(value, r"\s*[,;]\s*"))


def resolve_author_list(people: Column) -> Column:
    """Names of a list of structs that may hold the name under any of several fields."""
    return distinct_values(F.transform(people, lambda a: F.coalesce(
        a["name"], a["display_name"], a["full_name"], a["author_name"])))


def normalize_keywords(values: Column) -> Column:
    """Case-insensitive distinct, keeping the first spelling. Works inside the row."""
    def keep(cleaned: Column) -> Column:
        return X.let(F.transform(cleaned, lambda v: F.lower(v)), lambda low: F.filter(
            cleaned, lambda v, i: F.array_position(low, F.lower(v)) == i + 1))

    return X.let(F.filter(F.transform(values, lambda v: X.squeeze(v)), lambda v: v != ""), keep)


def validate_papers(records: DataFrame) -> DataFrame:
    """Adds ``errors`` and ``accepted``."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"^\s+|\s+$", "")
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.length("title"), F.lit(0)) == 0, F.lit("title is required")),
        F.when((F.length("title") > 0) & (F.length(title) < 2), F.lit("title is too short")),
    ))
    return records.withColumn("errors", errors).withColumn("accepted", F.size("errors") == 0)


# fixed values: weight of each present field
CONFIDENCE_WEIGHTS = {
    "title": 0.25, "abstract": 0.15, "authors": 0.15, "published": 0.10, "doi": 0.15,
    "venue": 0.05, "publisher": 0.05, "url": 0.05, "external_ids": 0.05,
}


def metadata_confidence(records: DataFrame) -> DataFrame:
    """Weighted share of present fields and its level. Arrays and maps count when not empty."""
    total = F.lit(0.0)
    for name, weight in CONFIDENCE_WEIGHTS.items():
        if name not in records.columns:
            continue
        kind = records.schema[name].dataType.typeName()
        there = F.size(name) > 0 if kind in ("array", "map") else (
            F.length(name) > 0 if kind == "string" else F.col(name).isNotNull())
        total = total + F.when(there, weight).otherwise(0.0)
    score = F.least(F.lit(1.0), F.round(total, 4))
    level = F.when(score >= 0.85, "high").when(score >= 0.60, "medium").otherwise("low")
    return records.withColumn("confidence_score", score).withColumn("confidence_level", level)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def clean_text(text: Column) -> Column:
    """Compatibility normal form, no NUL, single blanks, at most one empty line.

    Plain ASCII is already normal: such rows send only a null to Python.
    """
    foreign = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    normal = F.coalesce(_nfkc(foreign), text)
    squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace(normal, r"\x00", ""), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(squeezed, r"^\s+|\s+$", "")


def normalize_lines(text: Column) -> Column:
    """Lines stripped, one empty line between blocks."""
    unix = F.regexp_replace(text, r"\r\n|\r", "\n")
    stripped = F.array_join(F.transform(F.split(unix, "\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(stripped, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def year_range_filter(papers: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    if start is not None and end is not None and start > end:
        raise ValueError("year_from must not be after year_to")
    kept = papers
    if start is not None:
        kept = kept.filter(F.col("year") >= start)
    if end is not None:
        kept = kept.filter(F.col("year") <= end)
    return kept


FILTER_PATTERN = r'(?i)(year|author|topic|source|venue|document|paper|source_type):("[^"]+"|[^\s]+)'


def parse_query_filters(queries: DataFrame) -> DataFrame:
    """Filters written inside a query text; the last mention of a key wins."""
    keys = F.transform(F.regexp_extract_all("text", F.lit(FILTER_PATTERN), F.lit(1)), lambda k: F.lower(k))
    values = F.transform(F.regexp_extract_all("text", F.lit(FILTER_PATTERN), F.lit(2)), lambda v: F.trim(F.replace(v, F.lit('"'), F.lit(""))))
    found = queries.withColumn("pairs", F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["v"] != ""))

    def last(key: str, pattern: str | None = None) -> Column:
        hits = F.filter("pairs", lambda p: (p["k"] == key) & (p["v"].rlike(pattern) if pattern else F.lit(True)))
        return F.try_element_at(hits, F.lit(-1))["v"]

    years = last("year", r"^([0-9]{4}-[0-9]{4}|[0-9]+)$")
    return found.select(
        "query_id",
        F.regexp_extract(years, r"^([0-9]+)", 1).try_cast("int").alias("year_from"),
        F.regexp_extract(years, r"([0-9]+)$", 1).try_cast("int").alias("year_to"),
        last("author").alias("author"), last("topic").alias("topic"), last("source").alias("source"),
        last("venue").alias("venue"), last("document").alias("document_id"), last("paper").alias("paper_id"),
        last("source_type").alias("source_type"),
    )


# -- paper search over one request --------------------------------------------------------


def paper_matches(papers: DataFrame, authors: DataFrame, request: dict[str, object]) -> DataFrame:
    """Papers meeting every condition of a request.

    ``papers`` carry ``venue_name``; ``authors`` are ``paper_id, author_name``. Author
    conditions become semi-joins on paper ids.
    """
    kept = papers

    def by_author(pattern: str) -> DataFrame:
        return authors.filter(F.ilike("author_name", F.lit(pattern))).select("paper_id").distinct()

    text = str(request.get("query") or "").strip()
    if text:
        like = f"%{text}%"
        own = F.lit(False)
        for name in ("title", "abstract", "doi", "arxiv_id", "pmid", "provider_paper_id", "venue_name"):
            if name in papers.columns:
                own = own | F.coalesce(F.ilike(F.col(name), F.lit(like)), F.lit(False))
        hit = by_author(like).withColumn("by_author", F.lit(True))
        kept = kept.join(hit, "paper_id", "left").filter(own | F.col("by_author").isNotNull()).drop("by_author")
    if request.get("doi"):
        kept = kept.filter(F.ilike("doi", F.lit(f"%{str(request['doi']).strip()}%")))
    if request.get("provider"):
        kept = kept.filter(F.col("provider") == str(request["provider"]).strip())
    if request.get("provider_paper_id"):
        kept = kept.filter(F.ilike("provider_paper_id", F.lit(f"%{str(request['provider_paper_id']).strip()}%")))
    venue = str(request.get("venue") or "").strip()
    if venue.isdigit():
        kept = kept.filter(F.col("venue_id") == int(venue))
    elif venue:
        kept = kept.filter(F.ilike("venue_name", F.lit(f"%{venue}%")))
    if request.get("author"):
        kept = kept.join(by_author(f"%{str(request['author']).strip()}%"), "paper_id", "left_semi")
    if request.get("year") is not None:
        kept = kept.filter(F.col("year") == int(request["year"]))
    if request.get("published_from"):
        kept = kept.filter(F.col("published") >= F.lit(request["published_from"]).cast("date"))
    if request.get("published_to"):
        kept = kept.filter(F.col("published") < F.date_add(F.lit(request["published_to"]).cast("date"), 1))
    if request.get("topics") is not None:
        kept = kept.join(request["topics"], "paper_id", "left_semi")
    return kept


def paper_page(matches: DataFrame, sort_by: str = "published", descending: bool = True, offset: int = 0, size: int = 20) -> DataFrame:
    """One page, nulls last, ties by id in the same direction."""
    column = F.col(sort_by)
    order = (
        (column.desc_nulls_last(), F.desc("paper_id")) if descending else (column.asc_nulls_last(), F.asc("paper_id"))
    )
    return matches.orderBy(*order).offset(max(offset, 0)).limit(max(size, 1))


def paper_total(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("total"))


# -- sections and relevance ---------------------------------------------------------------


def clean_title(title: Column) -> Column:
    return F.regexp_replace(X.squeeze(title), r"^[ \t\r\n.:;-]+|[ \t\r\n.:;-]+$", "")


def classify_sections(sections: DataFrame, title: str = "title") -> DataFrame:
    """Section number, bare title and family of a heading; the first family that fits wins."""
    cleaned = clean_title(F.col(title))
    pattern = r"(?i)^\s*((?:[IVXLCDM]+|[0-9]+(?:\.[0-9]+)*|[A-Z]))[\s.):-]+(.+?)\s*$"
    number = F.nullif(F.regexp_extract(cleaned, pattern, 1), F.lit(""))
    bare = F.when(number.isNull(), cleaned).otherwise(F.regexp_extract(cleaned, pattern, 2))
    matched = F.lower(clean_title(bare))
    family = F.lit("other")
    for name, words in reversed(SECTION_FAMILIES):
        family = F.when(matched.rlike(f"^(?:{words})$"), name).otherwise(family)
    return sections.withColumns({"number": number, "section_title": bare, "section_type": family})


PRESENCE_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_.+/#-]*"


def presence_tokens(text: Column) -> Column:
    found = F.transform(X.matches(F.lower(text), PRESENCE_TOKEN), lambda t: F.regexp_replace(t, r"^[._+/#-]+|[._+/#-]+$", ""))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*PRESENCE_STOP)))


def presence_relevance(results: DataFrame) -> DataFrame:
    """Results that hold a query word: token coverage, whole phrase and former score.

    ``results``: ``query_id, chunk_id, query_text, text, meta_text, score``.
    """
    body = F.lower(F.concat_ws(" ", "text", "meta_text"))
    named = results.withColumns({"wanted": presence_tokens(F.col("query_text")), "body": body})
    hits = X.let(F.col("body"), lambda body: F.size(F.filter("wanted", lambda t: X.has_term(body, t))))
    phrase = F.contains(X.squeeze(F.lower("text")), X.squeeze(F.lower("query_text"))) & (X.squeeze(F.col("query_text")) != "")
    scored = named.withColumn("hits", hits).filter("hits > 0").withColumn(
        "relevance",
        r6(clamp01(0.75 * F.col("hits") / F.size("wanted") + F.when(phrase, 0.15).otherwise(0.0)
                   + 0.10 * F.when(F.col("score").between(0.0, 1.0), F.col("score")).otherwise(0.0))),
    )
    return scored.select("query_id", "chunk_id", "hits", "relevance")
