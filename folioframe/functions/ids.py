"""Identifier column expressions: null when the value is not a valid identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.text import squeeze

BLANKS = r"^[ \n\t\r]+|[ \n\t\r]+$"


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, BLANKS, "")


def _valid(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(pattern), value)


def doi(value: Column) -> Column:
    """Lower-case DOI without resolver prefix or closing punctuation."""
    bare = F.regexp_replace(_strip(value), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)", "")
    bare = F.regexp_replace(_strip(bare), r"[.,; ]+$", "")
    bare = F.regexp_replace(bare, r"(?i)^doi\.org/", "")
    bare = F.regexp_replace(bare, r"(?i)^dx\.doi\.org/", "")
    return F.lower(_valid(bare, r"^10\.[0-9]{4,9}/[^ \n\t\r]+$"))


def arxiv(value: Column) -> Column:
    """arXiv id, old or new form, without version."""
    bare = F.regexp_replace(_strip(value), r"(?i)^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv:)", "")
    bare = F.regexp_replace(_strip(bare), r"[.,; ]+$", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"(?i)v[0-9]+$", "")
    return _valid(bare, r"^(?:[0-9]{4}\.[0-9]{4,5}|[a-zA-Z-]+(?:\.[A-Za-z-]+)?/[0-9]{7})$")


def pmid(value: Column) -> Column:
    """PubMed id: digits only."""
    bare = F.regexp_replace(_strip(value), r"(?i)^(?:https?://pubmed\.ncbi\.nlm\.nih\.gov/|pmid:)", "")
    bare = F.regexp_replace(_strip(bare), r"[/.,; ]+$", "")
    bare = F.regexp_replace(bare, r"(?i)^pubmed/", "")
    return _valid(bare, r"^[0-9]+$")


def openalex(value: Column) -> Column:
    """OpenAlex work id: ``W`` and digits."""
    bare = F.regexp_replace(_strip(value), r"(?i)^(?:https?://openalex\.org/|openalex:)", "")
    bare = F.regexp_replace(_strip(bare), r"/+$", "")
    return F.upper(_valid(bare, r"^[Ww][0-9]+$"))


def year(value: Column) -> Column:
    """First year from 1000 to 2100 standing alone in a value."""
    return F.nullif(
        F.regexp_extract(value.cast("string"), r"\b(1[0-9]{3}|20[0-9]{2}|2100)\b", 1), F.lit("")
    ).cast("int")


def identity_title(value: Column) -> Column:
    """Title reduced to lower-case ASCII letters, digits and single spaces."""
    lowered = F.lower(_strip(F.coalesce(value, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(lowered, r"[^a-z0-9\s]", " "), r"\s+", " ")


def identity_key(doi_: Column, arxiv_: Column, pmid_: Column, provider: Column, provider_id: Column,
                 title: Column, year_: Column) -> Column:
    """The strongest identity a record has; a digest of title and year as the last resort."""
    def clean(c: Column) -> Column:
        return F.nullif(F.lower(_strip(c)), F.lit(""))

    def present(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    raw = F.concat(identity_title(title), F.lit("|"), F.coalesce(year_.cast("string"), F.lit("")))
    return F.coalesce(
        F.concat(F.lit("doi:"), clean(doi_)),
        F.concat(F.lit("arxiv:"), clean(arxiv_)),
        F.concat(F.lit("pmid:"), clean(pmid_)),
        F.concat(F.lit("provider:"), F.lower(_strip(present(provider))), F.lit(":"), _strip(present(provider_id))),
        F.concat(F.lit("title:"), F.sha2(raw, 256)),
    )


def source_identity(paper_id: Column, document_id: Column, source_id: Column, title: Column, kind: Column) -> Column:
    """paper, else document, else own id, else title and kind."""
    def text(c: Column) -> Column:
        return F.lower(squeeze(F.coalesce(c, F.lit(""))))

    return F.coalesce(
        F.concat(F.lit("paper:"), paper_id.cast("string")),
        F.concat(F.lit("document:"), F.lower(F.nullif(document_id.cast("string"), F.lit("")))),
        F.concat(F.lit("source:"), F.lower(F.nullif(source_id.cast("string"), F.lit("")))),
        F.concat(F.lit("title:"), text(title), F.lit("|source:"), text(kind)),
    )
