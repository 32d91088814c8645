"""Listings, membership and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paper_documents(papers: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunked documents per paper; a paper with both counts as ingested."""
    chunked = chunks.select("document_id").distinct().withColumn("has_chunks", F.lit(1))
    per_paper = documents.join(chunked, "document_id", "left").groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count("has_chunks").alias("chunked")
    )
    return papers.join(per_paper, "paper_id", "left").fillna(0, ["documents", "chunked"]).withColumn(
        "ingested", (F.col("documents") > 0) & (F.col("chunked") > 0)
    )


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) of an ordered table: Spark keeps only offset + size rows per task."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def list_collections(collections: DataFrame, items: DataFrame, owner: object | None = None, search: str | None = None,
                     archived: bool | None = None) -> DataFrame:
    """Collections of an owner that meet the filters, each with its number of papers.

    The few matching collections are found first; only their items are counted.
    """
    kept = collections
    if owner is not None:
        kept = kept.filter(F.col("owner_id") == owner)
    if search and search.strip():
        like = F.lit(f"%{search.strip()}%")
        kept = kept.filter(F.ilike("name", like) | F.coalesce(F.ilike("description", like), F.lit(False)))
    if archived is not None:
        kept = kept.filter(F.col("archived") == archived)
    counts = items.join(kept.select("collection_id"), "collection_id", "left_semi").groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("paper_count"))
    return kept.join(counts, "collection_id", "left").fillna(0, ["paper_count"])


def collection_items(items: DataFrame, papers: DataFrame, collection: object) -> DataFrame:
    return items.filter(F.col("collection_id") == collection).join(papers, "paper_id")


def collection_add(items: DataFrame, wanted: DataFrame, collections: DataFrame, papers: DataFrame) -> DataFrame:
    """Membership after adding pairs whose collection and paper exist. Adding twice changes nothing."""
    valid = wanted.join(collections.select("collection_id"), "collection_id", "left_semi").join(
        papers.select("paper_id"), "paper_id", "left_semi").select("collection_id", "paper_id")
    return items.select("collection_id", "paper_id").union(valid).distinct()


def collection_remove(items: DataFrame, unwanted: DataFrame) -> DataFrame:
    return items.join(unwanted, ["collection_id", "paper_id"], "left_anti")


def collection_overlap(items: DataFrame, left: object, right: object) -> DataFrame:
    """Papers of two collections and which side holds them."""
    def side(key: object) -> DataFrame:
        return items.filter(F.col("collection_id") == key).select("paper_id").distinct()

    a, b = side(left), side(right)
    return (
        a.intersect(b).withColumn("side", F.lit("both"))
        .unionByName(a.subtract(b).withColumn("side", F.lit("left")))
        .unionByName(b.subtract(a).withColumn("side", F.lit("right")))
    )


def list_reports(reports: DataFrame, owner: object | None = None, status: str | None = None) -> DataFrame:
    kept = reports
    if owner is not None:
        kept = kept.filter(F.col("owner_id") == owner)
    if status:
        kept = kept.filter(F.col("status") == status)
    return kept


def list_documents(documents: DataFrame, paper: object) -> DataFrame:
    return documents.filter(F.col("paper_id") == paper).orderBy("document_id")


def list_sections(sections: DataFrame, document: object) -> DataFrame:
    return sections.filter(F.col("document_id") == document).orderBy("section_index")


def list_chunks(chunks: DataFrame, document: object) -> DataFrame:
    return chunks.filter(F.col("document_id") == document).orderBy("chunk_index")
