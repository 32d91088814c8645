"""Index tables: postings, vectors, metadata, and their upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X


# -- inverted index ---------------------------------------------------------------------


def doc_stats(chunks: DataFrame) -> DataFrame:
    """``chunk_id, dl``: length of every chunk, empty ones too."""
    return chunks.select("chunk_id", F.size(X.tokens(F.col("text"))).alias("dl"))


def token_rows(chunks: DataFrame) -> DataFrame:
    """``chunk_id, dl, term``: one row per word.

    The outer explode is on purpose: for a plain one the optimizer adds a filter that splits
    every text a second and a third time.
    """
    return chunks.select("chunk_id", X.tokens(F.col("text")).alias("words")).select(
        "chunk_id", F.size("words").alias("dl"), F.explode_outer("words").alias("term")
    ).filter("term IS NOT NULL")


def postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf, dl``.

    All words of a chunk sit in one row, so the map-side combine finishes the count and
    only distinct (chunk, term) pairs are shuffled.
    """
    return token_rows(chunks).groupBy("chunk_id", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")
    ).select("term", "chunk_id", "tf", "dl")


def document_frequency(chunks: DataFrame) -> DataFrame:
    """``term, df`` straight from the texts: one shuffle of per-task counts, no postings."""
    words = chunks.select(F.explode_outer(F.array_distinct(X.tokens(F.col("text")))).alias("term")).filter("term IS NOT NULL")
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def words_and_lengths(chunks: DataFrame) -> DataFrame:
    """``term, df`` of all words and, in the same pass, the number of chunks of each length.

    A length is counted as a blank and its digits, which no word looks like; a text that is
    null as a blank alone.
    """
    words = X.let(X.tokens(F.col("text")), lambda w: F.array_append(F.array_distinct(w), F.concat(F.lit(" "), F.size(w).cast("string"))))
    said = chunks.select(F.explode_outer(F.coalesce(words, F.array(F.lit(" ")))).alias("term")).filter("term IS NOT NULL")
    return said.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length."""
    return stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def with_idf(df: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """Adds ``raw_idf, idf`` to ``term, df``; a negative idf becomes ``epsilon`` times the mean of all."""
    return idf_among(df, corpus_stats(stats).select("n_docs").scalar(), epsilon)


def idf_among(df: DataFrame, n: Column, epsilon: float = 0.25) -> DataFrame:
    """The same among ``n`` chunks; a row whose ``df`` is null has no part in the mean."""
    raw = df.withColumn("raw_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw_idf")).scalar()
    return raw.withColumn("idf", F.when(F.col("raw_idf") < 0, epsilon * mean).otherwise(F.col("raw_idf")))


def build_inverted_index(chunks: DataFrame) -> DataFrame:
    """One row per term: document frequency, total frequency, longest posting, idf."""
    # counting tf > 0 keeps tf in every use of the postings, so that they are shuffled once
    terms = postings(chunks).groupBy("term").agg(
        F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("total_tf"), F.max("tf").alias("max_tf"))
    return with_idf(terms, doc_stats(chunks))


# -- vectors ----------------------------------------------------------------------------


def hash_weights(chunks: DataFrame, dim: int) -> DataFrame:
    """``chunk_id, bucket, weight``: signed feature hashing of words.

    Counts per chunk are finished before the shuffle, which carries at most ``dim`` rows each.
    """
    digest = F.md5("term")
    place = F.pmod(F.conv(F.substring(digest, 1, 6), 16, 10).cast("long"), F.lit(dim)).cast("int")
    sign = F.when(F.pmod(F.conv(F.substring(digest, 7, 2), 16, 10).cast("long"), F.lit(2)) == 0, 1).otherwise(-1)
    return (
        token_rows(chunks).select("chunk_id", place.alias("bucket"), sign.alias("w"))
        .groupBy("chunk_id", "bucket").agg(F.sum("w").alias("weight")).filter("weight <> 0")
    )


def embed_chunks(chunks: DataFrame, dim: int = 384) -> DataFrame:
    """``chunk_id, embedding``: unit vectors by feature hashing; the default model.

    A vector never holds more than ``dim`` entries, so collecting them is bounded.
    """
    weights = hash_weights(chunks, dim)
    packed = weights.groupBy("chunk_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
    )
    dense = X.let(F.struct("m", "norm"), lambda r: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(r["m"], i), F.lit(0)) / r["norm"]))
    return packed.select("chunk_id", dense.alias("embedding"))


def embed_with_model(chunks: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], dim: int,
                     batch: int = 32) -> DataFrame:
    """Vectors of a user's model, which ``factory`` builds once per task.

    Wrong shapes and non-finite numbers raise; results are scaled to unit length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for part in batches:
            ids, texts = part.column(0), part.column(1).to_pylist()
            for lo in range(0, len(texts), batch):
                made = np.asarray(model(texts[lo:lo + batch]), dtype=np.float64)
                if made.shape != (len(texts[lo:lo + batch]), dim):
                    raise ValueError(f"model returned {made.shape}, expected rows of {dim}")
                if not np.isfinite(made).all():
                    raise ValueError("model returned a value that is not finite")
                norm = np.linalg.norm(made, axis=1, keepdims=True)
                made = np.divide(made, norm, out=np.zeros_like(made), where=norm > 0)
                offsets = pa.array(np.arange(0, made.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, made.shape[0]), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))],
                    names=["chunk_id", "embedding"],
                )

    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text").mapInArrow(run, f"chunk_id {id_type}, embedding array<double>")


def valid_vector(vector: Column, dim: int) -> Column:
    """Right dimension, no null, NaN or infinity."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & ~broken


def validate_vectors(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Adds ``valid`` and, for the rejected, ``reason``."""
    v = F.col(vector)
    reason = (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dim, "wrong dimension")
        .when(~valid_vector(v, dim), "not finite")
    )
    return vectors.withColumn("reason", reason).withColumn("valid", reason.isNull())


# -- metadata ---------------------------------------------------------------------------


def index_metadata(chunks: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunk joined with its document and labels into one filter map per chunk."""
    joined = chunks.join(documents, "document_id", "left").join(labels, "document_id", "left")
    entries = F.map_filter(
        F.create_map(
            F.lit("document_id"), F.col("document_id").cast("string"),
            F.lit("lang"), F.col("lang"),
            F.lit("source"), F.col("source"),
            F.lit("quality"), F.col("quality").cast("string"),
            F.lit("toxic"), F.col("toxic").cast("string"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return joined.select("chunk_id", "document_id", entries.alias("metadata"))


def metadata_filter(rows: DataFrame, wanted: dict[str, object], metadata: str = "metadata") -> DataFrame:
    """Keep rows whose map holds every wanted value; a list means any of them."""
    kept = rows
    for key, value in wanted.items():
        field = F.col(metadata)[key]
        if isinstance(value, (list, tuple, set, frozenset)):
            kept = kept.filter(field.isin([str(v) for v in value]))
        else:
            kept = kept.filter(field == str(value))
    return kept


def filters_as_data(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """``(query_id, row)`` pairs where the row meets all of the query's (key, value) rows.

    ``rows`` need ``chunk_id`` and ``metadata``; ``filters`` are ``query_id, key, value``
    with one row per allowed value. Equi-join on (key, value), then a count of keys met.
    """
    needed = filters.groupBy("query_id").agg(F.count_distinct("key").alias("needed"))
    facts = rows.select("chunk_id", F.explode("metadata").alias("key", "value"))
    met = (
        facts.join(filters.distinct(), ["key", "value"])
        .groupBy("query_id", "chunk_id")
        .agg(F.count_distinct("key").alias("met"))
    )
    return met.join(needed, "query_id").filter("met = needed").select("query_id", "chunk_id")


# -- upkeep -----------------------------------------------------------------------------


def index_valid_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with an id and some text."""
    return chunks.filter(F.col("chunk_id").isNotNull() & (F.length(X.squeeze(F.col("text"))) > 0))


def new_chunks(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    return chunks.join(indexed.select("chunk_id"), "chunk_id", "left_anti")


def replace_document(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every chunk of a document in ``fresh`` is replaced by the fresh ones."""
    kept = index.join(fresh.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(fresh)


def latest_items(items: DataFrame, key: str = "chunk_id", batch: str = "batch") -> DataFrame:
    """Last written item per key.

    ``max_by`` over the whole row combines map-side: a key written a million times does not
    gather in one task before it is reduced.
    """
    others = [c for c in items.columns if c != key]
    last = items.groupBy(key).agg(F.max_by(F.struct(*others), F.col(batch)).alias("row"))
    return last.select(key, "row.*")


def index_stats(sparse_ids: DataFrame, dense_ids: DataFrame) -> DataFrame:
    """One row: sizes of both indexes and how many ids only one of them holds."""
    s = sparse_ids.select("chunk_id").distinct().withColumn("in_sparse", F.lit(1))
    d = dense_ids.select("chunk_id").distinct().withColumn("in_dense", F.lit(1))
    return s.join(d, "chunk_id", "full_outer").agg(
        F.count("in_sparse").alias("sparse_items"),
        F.count("in_dense").alias("dense_items"),
        F.count_if(F.col("in_dense").isNull()).alias("only_sparse"),
        F.count_if(F.col("in_sparse").isNull()).alias("only_dense"),
        (F.count_if(F.col("in_dense").isNull() | F.col("in_sparse").isNull()) == 0).alias("in_step"),
    )


def orphaned_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("document_id"), "document_id", "left_anti")


def expired_rows(rows: DataFrame, stamp: str, now: Column, days: int) -> DataFrame:
    """Rows older than ``days`` before ``now``."""
    return rows.filter(F.col(stamp) < now - F.make_dt_interval(F.lit(days)))
