"""Search requests as rows: each with its own mode, size, weights, filters and reranking.

A filter is compiled once for all requests that share it. Chunks are numbered; for each metadata
value there are bitmaps of the numbers that have it, one to a bucket of 32,768 numbers. The values
allowed for a key are joined by OR, the keys by AND, bucket by bucket, and both legs of a search
look candidates up in what comes out before they cut to the k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.scores import r6, top_k
from folioframe.operators import index as I
from folioframe.operators import search as S
from folioframe.operators.masks import ANY
from folioframe.session import cut_lineage

HYBRID, DENSE, SPARSE = "hybrid", "dense", "sparse"
BUCKET_BITS = 32_768


@dataclass
class Bitmaps:
    """``numbers(chunk_id, number, bucket)`` and ``facts(key, value, bucket, bits)``."""

    numbers: DataFrame
    facts: DataFrame


def metadata_bitmaps(chunks: DataFrame) -> Bitmaps:
    """Numbers and bitmaps of ``chunks(chunk_id, metadata)``; store them to use them again.

    A bucket holds chunks of one input partition, so numbers need no order over all of them.
    """
    numbered = cut_lineage(chunks.select("chunk_id", "metadata").withColumn("number", F.monotonically_increasing_id()))
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    facts = numbered.select("number", F.explode("metadata").alias("key", "value")).groupBy("key", "value", bucket).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    return Bitmaps(numbered.select("chunk_id", "number", bucket), facts)


def predicates_of(filters: DataFrame) -> DataFrame:
    """``query_id, predicate``: the filter rows ``(query_id, key, value)`` of a request, in order,
    as one string; equal filters are equal strings."""
    row = F.struct(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return filters.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_set(row))).alias("predicate"))


def compiled(predicates: DataFrame, bitmaps: Bitmaps) -> DataFrame:
    """``predicate, bucket, bits``: the chunks that meet each predicate; buckets without any are
    left out. Values of one key are alternatives, keys must all be met."""
    wanted = predicates.select("predicate").distinct().select(
        "predicate", F.inline(F.from_json("predicate", "array<struct<key: string, value: string>>")))
    keys = wanted.groupBy("predicate").agg(F.count_distinct("key").alias("keys"))
    any_value = wanted.join(bitmaps.facts, ["key", "value"]).groupBy("predicate", "bucket", "key").agg(F.bitmap_or_agg("bits").alias("bits"))
    every_key = any_value.groupBy("predicate", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("met"))
    return every_key.join(keys, "predicate").filter((F.col("met") == F.col("keys")) & (F.bitmap_count("bits") > 0)).select("predicate", "bucket", "bits")


def has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), position % 8)), F.lit(2)) == 1


@dataclass
class Filters:
    """The predicate of each request and what the predicates come to."""

    predicates: DataFrame
    allowed: DataFrame
    numbers: DataFrame

    def keep(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows(query_id, chunk_id, ...)`` that their request's filters allow."""
        told = rows.join(self.predicates, "query_id", "left").withColumn("predicate", F.coalesce("predicate", F.lit(ANY)))
        free = told.filter(F.col("predicate") == ANY)
        bound = told.filter(F.col("predicate") != ANY).join(self.numbers, "chunk_id").join(self.allowed, ["predicate", "bucket"])
        met = bound.filter(has_bit(F.col("bits"), F.bitmap_bit_position("number")))
        return free.select(*rows.columns).unionByName(met.select(*rows.columns))


def dense_leg(requests: DataFrame, corpus: DataFrame, filters: Filters, most: int, dim: int) -> DataFrame:
    """The best ``most`` allowed chunks by inner product of ``requests(query_id, vector)``.

    The corpus is dealt out by bucket and meets the predicates' bitmaps of the bucket there, so
    that a filtered request is cut among its own chunks only. Request vectors go out in blocks
    of bounded size, as in ``dense_search``.
    """
    asked = requests.filter(I.valid_vector(F.col("vector"), dim)).join(filters.predicates, "query_id", "left").withColumn(
        "predicate", F.coalesce("predicate", F.lit(ANY)))
    placed = corpus.filter(I.valid_vector(F.col("vector"), dim)).join(filters.numbers, "chunk_id").select(
        "bucket", F.bitmap_bit_position("number").alias("position"), "chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-asked.count() * dim * 8 // S.BLOCK_BYTES))
    out = None
    for number in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select("query_id", "predicate", "vector")
        part = _masked(block, placed, filters.allowed, most)
        out = part if out is None else out.unionByName(part)
    return top_k(out, "query_id", most, *S.best())


def _masked(block: DataFrame, placed: DataFrame, allowed: DataFrame, most: int) -> DataFrame:
    picked = block.toArrow()
    q_type, c_type = (df.schema[x].dataType.simpleString() for df, x in ((block, "query_id"), (placed, "chunk_id")))
    shared = placed.sparkSession.sparkContext.broadcast(
        (picked.column("query_id"), picked.column("predicate").to_pylist(), S._as_matrix(picked.column("vector").combine_chunks())))

    def scored(chunks: pa.Table, bitmaps: pa.Table) -> pa.Table:
        asked, predicates, wanted = shared.value
        chunks = chunks.combine_chunks().sort_by("chunk_id")
        n = chunks.num_rows
        masks = {p: np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little") for p, b in zip(
            bitmaps["predicate"].to_pylist(), bitmaps["bits"].to_pylist(), strict=True)}
        rows, places, scores = [], [], []
        if n and len(asked):
            position, vectors = chunks["position"].to_numpy(), S._as_matrix(chunks["vector"].combine_chunks())
            by_predicate: dict[str, list[int]] = {}
            for i, p in enumerate(predicates):
                by_predicate.setdefault(p, []).append(i)
            for p, own in by_predicate.items():
                inside = np.arange(n) if p == ANY else np.flatnonzero(masks[p][position]) if p in masks else np.zeros(0, np.int64)
                step = max(1, S.SCORE_BYTES // (16 * max(1, len(inside))))
                for at in range(0, len(own) if len(inside) else 0, step):
                    got = np.round(wanted[own[at:at + step]] @ vectors[inside].T, 6)
                    first = np.argsort(-got, axis=1, kind="stable")[:, :most]
                    rows += np.repeat(own[at:at + step], first.shape[1]).tolist()
                    places.append(inside[first].ravel())
                    scores.append(np.take_along_axis(got, first, 1).ravel())
        at = pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))
        return pa.table({
            "query_id": asked.take(pa.array(rows, pa.int64())), "chunk_id": chunks["chunk_id"].take(at),
            "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

    used = allowed.join(block.select("predicate").distinct(), "predicate", "left_semi")
    return placed.groupBy("bucket").cogroup(used.groupBy("bucket")).applyInArrow(
        scored, f"query_id {q_type}, chunk_id {c_type}, score double")


@dataclass
class Answers:
    """``results(query_id, chunk_id, rank, score, dense_score, sparse_score)`` and one row of
    counts for each request."""

    results: DataFrame
    stages: DataFrame


def search_requests(requests: DataFrame, chunks: DataFrame, filters: DataFrame, dim: int = 64, overfetch: int = 2) -> Answers:
    """Answer ``requests(query_id, text, mode, top_k, vector_weight, keyword_weight, rerank)``.

    ``filters(query_id, key, value)`` hold one row for each allowed value. A leg that the mode
    asks for fetches ``overfetch`` times ``top_k`` chunks that the filters allow; legs are scaled
    to [0, 1] and added by their weights, a single leg by its own; with ``rerank`` the fused
    chunks are rescored against their texts; the first ``top_k`` are the results. Requests
    without a match have counts of 0 and no results.
    """
    fetch = F.col("top_k") * overfetch
    wanted = requests.select("query_id", "mode", "top_k", "vector_weight", "keyword_weight", "rerank")
    most = int(requests.agg(F.max(fetch).alias("most")).first()["most"] or 1)
    bitmaps = metadata_bitmaps(chunks)
    predicates = cut_lineage(predicates_of(filters.join(requests.select("query_id"), "query_id", "left_semi")))
    told = Filters(predicates, cut_lineage(compiled(predicates, bitmaps)), bitmaps.numbers)

    sparse_asked = requests.filter(F.col("mode") != DENSE).select("query_id", "text")
    sparse = S.bm25_search(sparse_asked, chunks, most, predicates=predicates)
    dense_asked = requests.filter(F.col("mode") != SPARSE).select(F.col("query_id").alias("chunk_id"), "text")
    vectors = I.embed_chunks(dense_asked, dim).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    dense = dense_leg(vectors, I.embed_chunks(chunks, dim).withColumnRenamed("embedding", "vector"), told, most, dim)
    columns = ["query_id", "chunk_id", "score", "rank"]
    both = sparse.select(*columns, F.lit(SPARSE).alias("leg")).unionByName(dense.select(*columns, F.lit(DENSE).alias("leg")))
    legs = cut_lineage(both.join(wanted.select("query_id", "top_k"), "query_id").filter(F.col("rank") <= fetch).drop("top_k"))

    unit = legs.withColumn("unit", S.scaled(F.col("score"), "minmax", ["leg", "query_id"]))
    of_leg = lambda name, column: F.max(F.when(F.col("leg") == name, F.col(column)))
    met = unit.groupBy("query_id", "chunk_id").agg(
        of_leg(DENSE, "unit").alias("d"), of_leg(SPARSE, "unit").alias("s"),
        of_leg(DENSE, "score").alias("dense_score"), of_leg(SPARSE, "score").alias("sparse_score"))
    total = F.col("vector_weight") + F.col("keyword_weight")
    by_weight = F.when(total > 0, (F.coalesce("d", F.lit(0.0)) * F.col("vector_weight") + F.coalesce("s", F.lit(0.0)) * F.col("keyword_weight")) / total).otherwise(0.0)
    score = F.when(F.col("mode") == HYBRID, by_weight).otherwise(F.coalesce("d", "s"))
    fused = cut_lineage(met.join(wanted, "query_id").withColumn("score", r6(score)).drop("d", "s"))

    again = fused.filter("rerank").select("query_id", "chunk_id", "score")
    full = S.spread_ids(again).join(requests.select("query_id", F.col("text").alias("query_text")), "query_id").join(
        chunks.select("chunk_id", "text", F.lit("").alias("meta_text")), "chunk_id")
    reranked = S.lexical_rerank(full).select("query_id", "chunk_id", "rerank_score")
    final = fused.join(reranked, ["query_id", "chunk_id"], "left").withColumn("score", F.coalesce("rerank_score", "score"))
    results = cut_lineage(top_k(final, "query_id", None, *S.best()).filter(F.col("rank") <= F.col("top_k")).select(
        "query_id", "chunk_id", "rank", "score", "dense_score", "sparse_score"))

    sizes = told.allowed.groupBy("predicate").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    everything = chunks.select(F.count(F.lit(1)).alias("all"))
    eligible = wanted.join(predicates, "query_id", "left").join(sizes, "predicate", "left").select(
        "query_id", F.when(F.col("predicate").isNull(), everything.scalar()).otherwise(F.coalesce("n", F.lit(0))).alias("eligible"))
    counts = legs.groupBy("query_id").agg(
        F.count_if(F.col("leg") == DENSE).alias("dense_candidates"), F.count_if(F.col("leg") == SPARSE).alias("sparse_candidates"))
    later = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("fused_candidates"), F.count_if("rerank").alias("reranked_candidates"))
    ends = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("final_results"))
    stages = wanted.select("query_id", "mode", "rerank").join(eligible, "query_id")
    for part in (counts, later, ends):
        stages = stages.join(part, "query_id", "left")
    return Answers(results, stages.fillna(0))
