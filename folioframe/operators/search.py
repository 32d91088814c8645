"""Batch retrieval: every function answers a whole table of queries at once.

A *run* is ``query_id, chunk_id, score, rank`` with rank by score descending, then id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.lexicon import QUERY_STOP
from folioframe.functions.scores import clamp01, r6, top_k
from folioframe.operators import index as I
from folioframe.operators.masks import ANY, compile_masks
from folioframe.session import cut_lineage

def best() -> tuple[Column, Column]:
    """Ranking of runs: score descending, then id."""
    return F.desc("score"), F.asc("chunk_id")


# -- sparse -----------------------------------------------------------------------------


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf``: a word used twice in a query counts twice."""
    return (
        queries.select("query_id", F.explode(X.tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_scores(terms: DataFrame, posted: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Score of every (query, chunk) that share a term.

    ``terms``: ``query_id, term, qtf, idf``; ``posted``: stored or fresh postings. Spark
    broadcasts the query terms while they fit its threshold and falls back to a shuffle join
    on the term beyond it, where AQE splits hot terms.
    """
    avgdl = I.corpus_stats(stats).select("avgdl").scalar()
    part = F.col("qtf") * F.col("idf") * (
        F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    )
    return (
        posted.join(terms, "term")
        .groupBy("query_id", "chunk_id")
        .agg(r6(F.sum(part)).alias("score"))
    )


def bm25_over_texts(queries: DataFrame, chunks: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """BM25 scores without a stored index.

    Words that no query asks for are dropped before anything is counted per chunk; only their
    document frequency is needed, for the mean idf.
    """
    stats = I.doc_stats(chunks)
    asked = query_terms(queries)
    known = I.with_idf(I.document_frequency(chunks), stats, epsilon).select("term", "idf")
    wanted = asked.select("term").distinct()
    posted = I.token_rows(chunks).join(wanted, "term").groupBy("chunk_id", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    return bm25_scores(asked.join(known, "term"), posted, stats)


# (query, term) rows of a block that is sent to all tasks
TERM_ROWS = 1 << 20


def word_statistics(chunks: DataFrame) -> DataFrame:
    """``term, idf`` of all words, each with the mean length of a chunk as ``avgdl``, from one pass over the texts.

    Nothing is filtered by ``term`` between the counts and their uses: Spark would move such a
    filter below the counts, which then were different ones and counted once more.
    """
    counted = I.words_and_lengths(chunks)
    is_length = F.startswith("term", F.lit(" "))
    length = F.when(is_length, F.substring("term", 2, 20).try_cast("long"))
    n = counted.agg(F.sum(F.when(is_length, F.col("df")))).scalar()
    avgdl = counted.agg(F.sum(length * F.col("df")).cast("double") / F.sum(F.when(length.isNotNull(), F.col("df")))).scalar()
    words = counted.withColumn("df", F.when(~is_length, F.col("df")))
    return I.idf_among(words, n).select("term", "idf", F.coalesce(F.nullif(avgdl, F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int = 10, wanted: dict[str, object] | None = None,
                statistics: DataFrame | None = None, predicates: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Okapi BM25 top-k; ``wanted`` restricts the candidates before the cut.

    All words of a chunk stand in one row, so its scores are finished where the row is read and
    only the ``k`` best of each task and query are shuffled, not every (query, chunk) that share
    a word. The weights of the queries' words are cut by query into blocks of about TERM_ROWS.
    ``statistics`` are the chunks' ``word_statistics``, where they are known already.
    ``predicates`` (``query_id, predicate``) are filters of each query's own on the chunks'
    ``metadata``; ``by`` names a column of the chunks for each value of which the ``k`` best are kept.
    """
    known = word_statistics(chunks) if statistics is None else statistics
    terms = cut_lineage(query_terms(queries).join(known, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl"))
    rows, avgdl = terms.agg(F.count(F.lit(1)), F.max("avgdl")).first()
    held = I.metadata_filter(chunks, wanted) if wanted else chunks
    more = ([F.col("metadata").cast("map<string,string>").alias("metadata")] if predicates is not None else []) + ([F.col(by)] if by else [])
    said = held.select("chunk_id", X.tokens(F.col("text")).alias("words"), *more)
    blocks = max(1, -(-rows // TERM_ROWS))
    found = None
    for number in range(blocks):
        def of_block(rows: DataFrame) -> DataFrame:
            return rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)

        part = _bm25_block(of_block(terms), said, avgdl, k, None if predicates is None else of_block(predicates), by)
        found = part if found is None else found.unionByName(part)
    return top_k(found, ["query_id", by] if by else "query_id", k, *best()).select("query_id", "chunk_id", "score", *([by] if by else []), "rank")


def _bm25_block(block: DataFrame, said: DataFrame, avgdl: float, k: int, filters: DataFrame | None = None, by: str | None = None,
                k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Best ``k`` of every partition for each query of one bounded block of query terms."""
    picked = block.orderBy("term", "query_id").toArrow().combine_chunks()
    asked = pc.unique(picked["query_id"].combine_chunks() if picked.num_rows else pa.array([], picked.schema.field("query_id").type))
    terms = pc.unique(picked["term"].combine_chunks() if picked.num_rows else pa.array([], pa.string()))
    owner = pc.index_in(picked["query_id"], asked).to_numpy().astype(np.int64)
    place = pc.index_in(picked["term"], terms).to_numpy().astype(np.int64)
    starts = np.searchsorted(place, np.arange(len(terms) + 1))
    sc = said.sparkSession.sparkContext
    shared = sc.broadcast((asked, terms, starts, owner, picked["weight"].to_numpy()))
    masks = None
    if filters is not None:
        told = dict(zip(*(filters.select("query_id", "predicate").toArrow()[n].to_pylist() for n in ("query_id", "predicate")), strict=True))
        of_query = [told.get(q, ANY) for q in asked.to_pylist()]
        different = {p: i for i, p in enumerate(sorted(set(of_query)))}
        masks = sc.broadcast((compile_masks(list(different)), np.array([different[p] for p in of_query], dtype=np.int64)))
    rows = max(1, SCORE_BYTES // (16 * max(1, len(asked))))
    q_type, c_type = _id_type(block, "query_id"), _id_type(said, "chunk_id")

    def scores(words: pa.ListArray) -> np.ndarray:
        """Rounded scores, queries by chunks; -inf where no word is shared."""
        asked, terms, starts, owner, weights = shared.value
        lengths = np.nan_to_num(pc.list_value_length(words).to_numpy(zero_copy_only=False)).astype(np.int64)
        term = pc.fill_null(pc.index_in(words.flatten(), terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        chunk = np.repeat(np.arange(len(words)), lengths)
        pairs, tf = np.unique((chunk * len(terms) + term)[term >= 0], return_counts=True)
        chunk, term = np.divmod(pairs, max(1, len(terms)))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[chunk] / avgdl))
        many = starts[term + 1] - starts[term]
        at = np.repeat(starts[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell = owner[at] * len(words) + np.repeat(chunk, many)
        size = len(asked) * len(words)
        total = np.bincount(cell, np.repeat(part, many) * weights[at], size)
        total = np.where(np.bincount(cell, minlength=size) > 0, np.round(total, 6), -np.inf)
        return total.reshape(len(asked), len(words))

    def groups(part: pa.Table) -> Iterator[tuple[object, np.ndarray]]:
        """The values of ``by`` with the rows that have them; all rows otherwise."""
        if by is None:
            yield None, np.arange(part.num_rows)
            return
        label = part[by].combine_chunks().dictionary_encode("encode")
        for number, value in enumerate(label.dictionary.to_pylist()):
            yield value, np.flatnonzero(label.indices.to_numpy() == number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value[0]
        best, kind, label = {}, None, None
        for whole in batches:
            for low in range(0, whole.num_rows if len(asked) else 0, rows):
                part = pa.Table.from_batches([whole.slice(low, rows)]).sort_by("chunk_id").combine_chunks()
                kind, label = part["chunk_id"].type, part.schema.field(by).type if by else None
                ids = np.array(part["chunk_id"].to_pylist(), dtype=object if pa.types.is_string(kind) else None)
                got = scores(part["words"].combine_chunks())
                if masks is not None:
                    compiled, of_query = masks.value
                    got = np.where(compiled.met(part["metadata"].combine_chunks())[of_query], got, -np.inf)
                for value, own in groups(part):
                    first = np.argsort(-got[:, own], axis=1, kind="stable")[:, :k]
                    best[value] = _merged(best.get(value), (np.take_along_axis(got[:, own], first, 1), ids[own][first]), k)
        for value, (score, found) in best.items():
            query, seat = np.nonzero(score > -np.inf)
            columns = {"query_id": asked.take(pa.array(query)), "chunk_id": pa.array(found[query, seat].tolist(), kind), "score": pa.array(score[query, seat])}
            if by:
                columns[by] = pa.array([value] * len(query), label)
            yield pa.RecordBatch.from_pydict(columns)

    return said.mapInArrow(run, f"query_id {q_type}, chunk_id {c_type}, score double" + (f", `{by}` {_id_type(said, by)}" if by else ""))


def search_index(queries: DataFrame, posted: DataFrame, stats: DataFrame, k: int = 10, epsilon: float = 0.25) -> DataFrame:
    """The same over stored ``postings`` and ``doc_stats`` tables."""
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = query_terms(queries).join(I.with_idf(df, stats, epsilon).select("term", "idf"), "term")
    return top_k(bm25_scores(terms, posted, stats), "query_id", k, *best()).select("query_id", "chunk_id", "score", "rank")


# -- dense ------------------------------------------------------------------------------

# bytes of a block of query vectors that is sent to all tasks, and of a block of scores in one
BLOCK_BYTES, SCORE_BYTES = 32 << 20, 64 << 20


def _as_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _best_of(wanted: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's best ``k`` of one batch; equal scores by id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    rows = max(1, SCORE_BYTES // (16 * max(1, len(ids))))
    scores, found = [], []
    for at in range(0, len(wanted), rows):
        got = np.round(wanted[at:at + rows] @ vectors.T, 6)
        first = np.argsort(-got, axis=1, kind="stable")[:, :k]
        scores.append(np.take_along_axis(got, first, 1))
        found.append(ids[first])
    return np.concatenate(scores), np.concatenate(found)


def _merged(best: tuple[np.ndarray, np.ndarray] | None, found: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's best ``k`` of two such results."""
    if best is None:
        return found
    scores, ids = (np.concatenate(x, axis=1) for x in zip(best, found, strict=True))
    rank = np.unique(ids, return_inverse=True)[1].reshape(ids.shape)
    keep = np.lexsort((rank, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)


def _block_search(block: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Exact inner products of one bounded block of queries with the whole corpus."""
    sc = corpus.sparkSession.sparkContext
    picked = block.toArrow()
    matrix = _as_matrix(picked.column("vector").combine_chunks())
    shared = sc.broadcast((picked.column("query_id").to_pylist(), matrix))
    q_type, c_type = picked.schema.field("query_id").type, _id_type(corpus, "chunk_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted = shared.value
        best, kind = None, None
        for part in batches:
            if not asked or not part.num_rows:
                continue
            kind = part.column(0).type
            found = _best_of(wanted, np.array(part.column(0).to_pylist(), dtype=object if pa.types.is_string(kind) else None), _as_matrix(part.column(1)), k)
            best = _merged(best, found, k)
        if best is not None:
            n = best[0].shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q in asked for _ in range(n)], q_type), pa.array(best[1].ravel().tolist(), kind), pa.array(best[0].ravel())],
                names=["query_id", "chunk_id", "score"],
            )

    return corpus.select("chunk_id", "vector").mapInArrow(run, f"query_id {_id_type(block, 'query_id')}, chunk_id {c_type}, score double")


def dense_scores(queries: DataFrame, corpus: DataFrame, k: int, dim: int) -> DataFrame:
    """Best ``k`` of every partition for every query. Ids are of any one type.

    ``queries`` are ``query_id, vector`` and ``corpus`` is ``chunk_id, vector``. The queries are
    counted first and cut by key into blocks of about BLOCK_BYTES; the corpus is read once per
    block, and no more than one block is ever broadcast.
    """
    queries = queries.filter(I.valid_vector(F.col("vector"), dim))
    corpus = corpus.filter(I.valid_vector(F.col("vector"), dim))
    blocks = max(1, -(-queries.count() * dim * 8 // BLOCK_BYTES))
    found = None
    for number in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        part = _block_search(block, corpus, k)
        found = part if found is None else found.unionByName(part)
    return found


def dense_search(queries: DataFrame, corpus: DataFrame, k: int = 10, dim: int = 384) -> DataFrame:
    """Exact inner-product top-k."""
    return top_k(dense_scores(queries, corpus, k, dim), "query_id", k, *best()).select(
        "query_id", "chunk_id", "score", "rank"
    )


# chance that a query meets each of its true top k, and the most buckets of a table that it asks
SURE, PROBES = 0.95, 4096


def probed(own: np.ndarray, cosine: float, most: int) -> np.ndarray | None:
    """Codes of the buckets, likeliest first and equally many of each table, in one of which a
    vector of at least this ``cosine`` lies with a chance of SURE; None if that takes over ``most``.

    ``own`` are the projections of the unit query, tables by planes. Given the query, a vector at
    that angle is on the other side of each plane independently, so chances are exact products.
    """
    if not 0 < cosine or most < 1:
        return None
    cosine = min(cosine, 1 - 1e-12)
    odds = np.abs(own) * cosine / np.sqrt(2 * (1 - cosine ** 2))
    flipped = np.frompyfunc(math.erfc, 1, 1)(odds).astype(float) / 2
    chance, code = np.ones((len(own), 1)), np.zeros((len(own), 1), np.int64)
    for number in range(own.shape[1]):
        bit = (own[:, number, None] > 0).astype(np.int64)
        chance = np.concatenate((chance * (1 - flipped[:, number, None]), chance * flipped[:, number, None]), axis=1)
        code = np.concatenate((code | bit << number, code | (1 - bit) << number), axis=1)
        kept = np.argsort(-chance, axis=1, kind="stable")[:, :most]
        chance, code = np.take_along_axis(chance, kept, 1), np.take_along_axis(code, kept, 1)
    missed = np.prod(1 - np.minimum(1, np.cumsum(chance, axis=1)), axis=0)
    enough = int(np.searchsorted(-missed, SURE - 1))
    if enough == len(missed):
        return None
    return (code[:, :enough + 1] + (np.arange(len(own))[:, None] << own.shape[1])).ravel()


def dense_search_lsh(queries: DataFrame, corpus: DataFrame, k: int = 10, dim: int = 384, tables: int = 32,
                     planes: int | None = None, seed: int = 17) -> DataFrame:
    """Approximate top-k by random-hyperplane signatures, exact scores on the candidates.

    Query and chunk meet on (table, signature); every candidate found is scored. The planes of
    a signature grow with the logarithm of the corpus, by default one bucket to 32 vectors.
    The k-th score among the query's own buckets bounds the angle to the true top k; the query
    then asks as many further buckets as meet any vector within that angle with a chance of
    SURE, whatever the size of the corpus. Queries that would ask for as many pairs as the
    corpus has vectors, or find no bound, are searched exactly.
    """
    if planes is None:
        planes = max(4, int(np.ceil(np.log2(max(1, corpus.count()) / 32))))
    normals = np.random.default_rng(seed).normal(size=(tables * planes, dim))
    most = min(PROBES, (1 << planes) // tables)

    def valid(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.col("vector").cast("array<double>").alias("vector")).filter(I.valid_vector(F.col("vector"), dim))

    def signed(df: DataFrame, key: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                if not part.num_rows:
                    continue
                bits = (_as_matrix(part.column(1)) @ normals.T > 0).reshape(part.num_rows, tables, planes)
                codes = bits @ (1 << np.arange(planes)) + (np.arange(tables) << planes)
                offsets = pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int64)))],
                    names=[key, "vector", "codes"],
                )

        return valid(df, key).mapInArrow(run, f"{key} {_id_type(df, key)}, vector array<double>, codes array<long>")

    c = signed(corpus, "chunk_id").withColumnRenamed("vector", "cv")
    dot = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def scored(q: DataFrame) -> DataFrame:
        pairs = (
            q.select("query_id", F.explode("codes").alias("code"))
            .join(c.select("chunk_id", F.explode("codes").alias("code")), "code")
            .select("query_id", "chunk_id").distinct()
        )
        return (
            pairs.join(q.select("query_id", F.col("vector").alias("qv")), "query_id").join(c.select("chunk_id", "cv"), "chunk_id")
            .select("query_id", "chunk_id", r6(dot).alias("score"))
        )

    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    longest = valid(corpus, "chunk_id").agg(F.max(norm("vector")).alias("longest")).first()["longest"] or 0.0
    own = signed(queries, "query_id")
    bound = top_k(scored(own), "query_id", k, *best()).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            codes = []
            for vector, least in zip(_as_matrix(part.column(1)), part.column(2).to_pylist(), strict=True):
                length = np.sqrt(vector @ vector)
                if least is None or not length * longest > 0:
                    codes.append(None)
                else:
                    codes.append(probed((normals @ vector / length).reshape(tables, planes), (least - 1e-6) / (length * longest), most))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.list_(pa.int64()))], names=["query_id", "vector", "codes"])

    q = cut_lineage(own.drop("codes").join(bound, "query_id", "left").mapInArrow(
        asked, f"query_id {_id_type(queries, 'query_id')}, vector array<double>, codes array<long>"))
    near = top_k(scored(q.filter("codes IS NOT NULL")), "query_id", k, *best())
    whole = dense_search(q.filter("codes IS NULL").drop("codes"), valid(corpus, "chunk_id"), k, dim)
    return near.select("query_id", "chunk_id", "score", "rank").unionByName(whole)


# -- fusion -----------------------------------------------------------------------------


def rrf_fuse(runs: list[DataFrame], constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion. An id repeated within a run scores at its best rank only."""
    merged = None
    for number, run in enumerate(runs):
        one = run.select(F.lit(number).alias("run"), "query_id", "chunk_id", "rank")
        merged = one if merged is None else merged.unionByName(one)
    once = merged.groupBy("run", "query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("query_id", "chunk_id").agg(
        r6(F.sum(1.0 / (constant + F.col("rank")))).alias("score"), F.count(F.lit(1)).alias("runs")
    )
    order = Window.partitionBy("query_id").orderBy(*best())
    return fused.withColumn("rank", F.row_number().over(order))


def scaled(score: Column, kind: str, group: list[str]) -> Column:
    """Scores of one group on a common scale, not rounded."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    if kind == "zscore":
        spread = F.stddev_pop(score).over(w)
        return F.when(low == high, F.lit(0.0)).otherwise((score - F.avg(score).over(w)) / spread)
    unit = F.when(low == high, F.lit(1.0)).otherwise((score - low) / (high - low))
    return unit * 100.0 if kind == "percent" else unit


def normalize_scores(run: DataFrame, kind: str = "minmax", score: str = "score", group: list[str] | None = None) -> DataFrame:
    """Adds ``normalized``: minmax, zscore (population) or percent, within each query.

    Meant for runs already cut to k rows per query.
    """
    return run.withColumn("normalized", r6(scaled(F.col(score), kind, group or ["query_id"])))


def weighted_fuse(dense: DataFrame, sparse: DataFrame, dense_weight: float = 0.5, sparse_weight: float = 0.5) -> DataFrame:
    """Weighted sum of both runs after min-max scaling; a missing side counts 0."""
    if dense_weight < 0 or sparse_weight < 0 or dense_weight + sparse_weight == 0:
        raise ValueError("weights must not be negative and not both be zero")
    total = dense_weight + sparse_weight
    d = dense.select("query_id", "chunk_id", scaled(F.col("score"), "minmax", ["query_id"]).alias("dense_score"))
    s = sparse.select("query_id", "chunk_id", scaled(F.col("score"), "minmax", ["query_id"]).alias("sparse_score"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer").fillna(0.0, ["dense_score", "sparse_score"])
    fused = both.withColumn(
        "score", r6(F.col("dense_score") * (dense_weight / total) + F.col("sparse_score") * (sparse_weight / total))
    )
    return fused.select(
        "query_id", "chunk_id", r6(F.col("dense_score")).alias("dense_score"), r6(F.col("sparse_score")).alias("sparse_score"),
        "score", F.row_number().over(Window.partitionBy("query_id").orderBy(*best())).alias("rank"))


def attach_scores(fused: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """The fused run with the rank and score either leg gave."""
    def leg(run: DataFrame, name: str) -> DataFrame:
        return run.select(
            "query_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank")
        )

    keys = ["query_id", "chunk_id"]
    return fused.join(leg(dense, "dense"), keys, "left").join(leg(sparse, "sparse"), keys, "left")


# -- reranking --------------------------------------------------------------------------

RERANK_TOKEN = r"[\p{L}\p{N}_]+(?:[./-]+[\p{L}\p{N}_]+)*"


def _content_terms(text: Column) -> Column:
    found = X.matches(F.lower(text), RERANK_TOKEN)
    return F.filter(found, lambda t: t.rlike(r"^[a-z0-9][a-z0-9_./-]*$") & ~t.isin(*QUERY_STOP))


def lexical_rerank(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """Rescore candidates by word overlap, phrases, metadata and their former score.

    ``candidates``: ``query_id, chunk_id, query_text, text, score`` and ``meta_text``. Counting
    works on (candidate, term) rows, so texts do not travel with the term shuffle.
    """
    keys = ["query_id", "chunk_id"]
    base = candidates.select(
        *keys, "score",
        X.squeeze(F.lower("query_text")).alias("q"),
        X.squeeze(F.lower("text")).alias("d"),
        X.squeeze(F.lower(F.coalesce("meta_text", F.lit("")))).alias("m"),
    )
    q_terms = base.select(*keys, F.explode_outer(_content_terms(F.col("q"))).alias("term")).filter("term IS NOT NULL").groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("qf")
    )
    d_terms = base.select(*keys, F.explode_outer(_content_terms(F.col("d"))).alias("term")).filter("term IS NOT NULL").groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("df")
    )
    gain = F.least(F.lit(1.0), F.col("qf") * F.least(F.lit(1.0), F.log1p("df") / F.log(F.lit(2.0))))
    lexical = (
        q_terms.join(d_terms, [*keys, "term"], "full_outer")
        .groupBy(*keys)
        .agg(
            F.sum("qf").alias("q_total"),
            F.sum(F.when(F.col("qf").isNotNull() & F.col("df").isNotNull(), gain).otherwise(0.0)).alias("matched"),
            F.sum(F.coalesce(F.col("qf") * F.col("df"), F.lit(0))).alias("dot"),
            F.sqrt(F.sum(F.coalesce(F.col("qf") * F.col("qf"), F.lit(0)))).alias("q_norm"),
            F.sqrt(F.sum(F.coalesce(F.col("df") * F.col("df"), F.lit(0)))).alias("d_norm"),
        )
    )
    words = X.words(F.col("q"))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    hits = X.let(F.col("d"), lambda d: F.size(F.filter(pairs, lambda p: F.contains(d, p))))
    phrase = (
        F.when((F.col("q") == "") | (F.col("d") == ""), 0.0)
        .when(F.contains(F.col("d"), F.col("q")), 1.0)
        .when(F.size(words) < 2, 0.0)
        .otherwise(hits / (F.size(words) - 1))
    )
    wanted = _content_terms(F.col("q"))
    in_meta = F.array_distinct(_meta_tokens(F.col("m")))
    meta_hits = X.let(in_meta, lambda known: F.size(F.filter(wanted, lambda t: F.array_contains(known, t))))
    meta = F.when((F.size(wanted) == 0) | (F.col("m") == ""), 0.0).otherwise(meta_hits / F.size(wanted))
    scored = (
        base.select(*keys, "score", phrase.alias("phrase"), meta.alias("meta"))
        .join(lexical, keys, "left")
        .withColumn(
            "cosine",
            F.when((F.coalesce("q_norm", F.lit(0.0)) == 0) | (F.coalesce("d_norm", F.lit(0.0)) == 0), 0.0)
            .otherwise(F.col("dot") / (F.col("q_norm") * F.col("d_norm"))),
        )
        .withColumn(
            "lexical",
            F.when(F.coalesce("q_total", F.lit(0)) == 0, 0.0).otherwise(
                F.least(F.lit(1.0), 0.65 * F.col("matched") / F.col("q_total") + 0.35 * F.col("cosine"))
            ),
        )
        .withColumn(
            "rerank_score",
            r6(0.55 * F.col("lexical") + 0.15 * F.col("phrase") + 0.10 * F.col("meta") + 0.20 * clamp01(F.col("score"))),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("chunk_id"))
    ranked = scored.select(*keys, r6(F.col("lexical")).alias("lexical"), r6(F.col("phrase")).alias("phrase"),
                           r6(F.col("meta")).alias("meta"), "rerank_score", F.row_number().over(order).alias("rank"))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _meta_tokens(text: Column) -> Column:
    return F.filter(X.matches(text, RERANK_TOKEN), lambda t: t.rlike(r"^[a-z0-9][a-z0-9_./-]*$"))


def model_rerank(candidates: DataFrame, factory: Callable[[], Callable[[list[str], list[str]], list[float]]], k: int = 10,
                 batch: int = 16) -> DataFrame:
    """Rescore (query, text) pairs with a user's model, built once per task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            made = [
                value
                for lo in range(0, len(frame), batch)
                for value in model(list(frame["query_text"][lo:lo + batch]), list(frame["text"][lo:lo + batch]))
            ]
            yield frame[["query_id", "chunk_id"]].assign(score=np.round(np.asarray(made, dtype=float), 6))

    scored = candidates.select("query_id", "chunk_id", "query_text", "text").mapInPandas(
        run, f"query_id {_id_type(candidates, 'query_id')}, chunk_id {_id_type(candidates, 'chunk_id')}, score double"
    )
    return top_k(scored, "query_id", k, *best())


def spread_ids(run: DataFrame) -> DataFrame:
    """Rows of a run dealt over all shuffle partitions, before texts are joined to them.

    Ids are few bytes, so the engine would pack them into one task, but reading and scoring
    the texts behind them is heavy. The key is a hash of the ids: a repartition by the very
    columns the rows are grouped by already would be dropped as redundant, and coalesced.
    """
    parts = int(run.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return run.repartition(parts, F.xxhash64("query_id", "chunk_id"))


def with_texts(run: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of a written run with the columns of ``texts``, dealt over all shuffle partitions.

    The size of a written run is known, so Spark sends it to the texts where these are read, and
    only the texts found are shuffled. A run too large for that meets them in a shuffle.
    """
    return spread_ids(run.join(texts, "chunk_id"))


# -- composed search --------------------------------------------------------------------


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 10, fetch_k: int | None = None, dim: int = 64,
                  wanted: dict[str, object] | None = None) -> DataFrame:
    """Both legs fetch ``fetch_k`` (twice ``k`` by default), are fused by rank, then reranked.

    Filters apply before either leg is cut. Texts are joined back only for the fused rows.
    """
    fetch_k = fetch_k or 2 * k
    pool = I.metadata_filter(chunks, wanted) if wanted else chunks
    q_vec = I.embed_chunks(queries.withColumnRenamed("query_id", "chunk_id"), dim).select(
        F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    c_vec = I.embed_chunks(pool, dim).withColumnRenamed("embedding", "vector")
    # the legs are small, fetch_k rows per query, and used three times: written once
    legs = cut_lineage(
        bm25_search(queries, chunks, fetch_k, wanted).withColumn("leg", F.lit("sparse"))
        .unionByName(dense_search(q_vec, c_vec, fetch_k, dim).withColumn("leg", F.lit("dense")))
    )
    sparse, dense = legs.filter("leg = 'sparse'").drop("leg"), legs.filter("leg = 'dense'").drop("leg")
    fused = rrf_fuse([sparse, dense]).select("query_id", "chunk_id", "score")
    named = spread_ids(fused).join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    full = named.join(chunks.select("chunk_id", "text", F.lit("").alias("meta_text")), "chunk_id")
    reranked = lexical_rerank(full, k)
    keys = ["query_id", "chunk_id"]
    return (
        attach_scores(reranked.select(*keys, "rerank_score", "rank"), dense, sparse)
        .join(fused.withColumnRenamed("score", "rrf_score"), keys)
        .select(*keys, "rank", "rerank_score", "rrf_score", "dense_score", "sparse_score")
    )


def federated_search(sources: dict[str, DataFrame], queries: DataFrame, k: int = 10) -> DataFrame:
    """Each source answers on its own; results are concatenated under the source's name."""
    found = None
    for name, chunks in sources.items():
        part = bm25_search(queries, chunks, k).withColumn("source", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def federated_by_column(queries: DataFrame, chunks: DataFrame, source: str, k: int = 10) -> DataFrame:
    """As ``federated_search`` with the source in a column: one top-k per query and source."""
    return bm25_search(queries, chunks, k, by=source)


def merge_results(lists: list[DataFrame]) -> DataFrame:
    """Concatenate runs in order and keep the first occurrence of an id."""
    merged = None
    for number, run in enumerate(lists):
        one = run.select("query_id", "chunk_id", F.lit(number).alias("list"), "rank")
        merged = one if merged is None else merged.unionByName(one)
    place = F.struct("list", "rank")
    first = merged.groupBy("query_id", "chunk_id").agg(F.min(place).alias("p"))
    order = Window.partitionBy("query_id").orderBy("p.list", "p.rank", "chunk_id")
    return first.select("query_id", "chunk_id", F.col("p.list").alias("list"), F.row_number().over(order).alias("rank"))


def graph_augmented_merge(run: DataFrame, edges: DataFrame) -> DataFrame:
    """Results, then their graph neighbours that are not among the results yet."""
    reached = (
        run.select("query_id", F.col("chunk_id").alias("src"), "rank")
        .join(edges.select("src", "dst"), "src")
        .groupBy("query_id", F.col("dst").alias("chunk_id"))
        .agg(F.min("rank").alias("rank"))
    )
    return merge_results([run, reached])


def run_confidence(run: DataFrame, expected: int = 3) -> DataFrame:
    """Confidence per query: half mean score, a quarter evenness, a quarter count."""
    s = squashed(F.col("score"))
    agg = run.groupBy("query_id").agg(
        F.avg(s).alias("strength"),
        F.when(F.count("score") == 1, 1.0).otherwise(clamp01(1.0 - F.stddev_pop(s))).alias("consistency"),
        F.least(F.lit(1.0), F.count("score") / F.lit(expected)).alias("density"),
    )
    return agg.select(
        "query_id", r6(F.col("strength")).alias("score_strength"), r6(F.col("consistency")).alias("score_consistency"),
        r6(F.col("density")).alias("evidence_density"),
        r6(clamp01(0.5 * F.col("strength") + 0.25 * F.col("consistency") + 0.25 * F.col("density"))).alias("confidence"),
    )


def squashed(score: Column) -> Column:
    """Scores of any scale into [0, 1]."""
    return (
        F.when(score.isNull() | F.isnan(score) | (F.abs(score) == F.lit(float("inf"))), 0.0)
        .when(score.between(0.0, 1.0), score)
        .when((score >= -1.0) & (score < 0.0), (score + 1.0) / 2.0)
        .when(score == -1.0, 0.0)
        .otherwise(1.0 - 1.0 / (1.0 + score))
    )


def iterative_search(queries: DataFrame, search: Callable[[DataFrame], DataFrame], threshold: float = 0.8, rounds: int = 3,
                     suffix: str = " additional evidence", confidence: Callable[[DataFrame], DataFrame] = run_confidence) -> DataFrame:
    """Search again, with longer texts, for the queries whose result is not convincing.

    ``rounds`` is small and fixed. Results of all rounds are merged in order; each query ends
    with its best confidence and the number of rounds it took. The run of a round is written once:
    its confidence, the next round's queries and the merged results all read it.
    """
    pending, lists, seen = queries, [], None
    for number in range(1, rounds + 1):
        run = cut_lineage(search(pending))
        lists.append(run)
        judged = pending.join(confidence(run).select("query_id", "confidence"), "query_id", "left").select(
            "query_id", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.lit(number).alias("round"),
            F.col("confidence").isNotNull().alias("found"),
        )
        history = judged.select("query_id", "confidence", "round")
        seen = history if seen is None else seen.unionByName(history)
        pending = judged.filter(F.col("confidence") < threshold).select(
            "query_id", F.when(F.col("found"), F.concat("text", F.lit(suffix))).otherwise(F.col("text")).alias("text")
        )
    outcome = seen.groupBy("query_id").agg(
        F.max("confidence").alias("best_confidence"), F.max("round").alias("iterations")
    )
    size = merge_results(lists).groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    return outcome.join(size, "query_id", "left").fillna(0, ["results"])


# -- paper search -----------------------------------------------------------------------

PAPER_TOKEN = r"[a-zA-Z0-9][a-zA-Z0-9._:/-]*"


def paper_query_terms(text: Column, stop: list[str]) -> Column:
    """Search terms of a question; all words of it when only stop words are left."""
    found = F.transform(
        X.matches(F.lower(text), PAPER_TOKEN), lambda t: F.regexp_replace(t, r"^[._:/-]+|[._:/-]+$", "")
    )
    long_enough = F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))
    useful = F.filter(
        long_enough, lambda t: ~t.isin(*stop) & (~t.rlike("^[0-9]+$") | (F.length(t) == 4))
    )
    return F.when(F.size(useful) > 0, useful).otherwise(long_enough)


# needles that are sent to all tasks at once
NEEDLES = 10_000


def contains_join(needles: DataFrame, hay: DataFrame, size: int = 4) -> DataFrame:
    """``needle_id, hay_id`` where the needle is part of the text.

    Both meet on the needle's first characters, then containment is checked; no pair without
    a common start is ever formed. The texts' grams are never broadcast: their number is not in
    the size of the files they come from. Up to NEEDLES needles are.
    """
    start = F.least(F.length("needle"), F.lit(size))
    keyed = needles.filter(F.length("needle") > 0).withColumn("gram", F.substr("needle", F.lit(1), start))
    lengths = F.sequence(F.lit(1), F.least(F.lit(size), F.length("text")))
    grams = hay.filter(F.length("text") > 0).select(
        "hay_id", "text",
        F.explode(F.array_distinct(F.flatten(F.transform(
            lengths, lambda n: F.transform(
                F.sequence(F.lit(1), F.length("text") - n + 1), lambda p: F.substr(F.col("text"), p, n))
        )))).alias("gram"),
    )
    side = "broadcast" if needles.limit(NEEDLES + 1).count() <= NEEDLES else "merge"
    return grams.join(keyed.hint(side), "gram").filter(F.contains("text", "needle")).select("needle_id", "hay_id").distinct()


def keyword_paper_search(queries: DataFrame, papers: DataFrame, stop: list[str], k: int = 10) -> DataFrame:
    """Papers by word hits in title and abstract and by identifier; citations break ties.

    Words match in full, or in part either way when the search word has four letters or more.
    Partial matches are found between the distinct words of both sides, not between texts.
    Papers of equal title and abstract differ in identifiers and order only: of each such group
    the first ``k`` are scored, and every paper with an identifier hit, which can only raise it.
    """
    q = queries.select("query_id", X.squeeze(F.lower("text")).alias("q"), paper_query_terms(F.col("text"), stop).alias("terms"))
    terms = q.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    order = (F.desc("citation_count"), F.desc("year"), F.desc("paper_id"))
    every = papers.filter(F.length(X.squeeze(F.coalesce("abstract", F.lit("")))) > 0).select(
        "paper_id", "citation_count", "year",
        X.squeeze(F.lower(F.coalesce("title", F.lit("")))).alias("title"),
        X.squeeze(F.lower("abstract")).alias("abstract"),
        X.squeeze(F.lower(F.concat_ws(" ", "arxiv_id", "doi", "pmid", "provider_paper_id"))).alias("ids"),
    )
    wanted = terms.select("term").distinct()
    named = cut_lineage(contains_join(
        wanted.select(F.col("term").alias("needle_id"), F.col("term").alias("needle")),
        every.select(F.col("paper_id").alias("hay_id"), F.col("ids").alias("text"))))
    heads = top_k(every, ["title", "abstract"], k, *order, rank="seat").select("paper_id")
    p = cut_lineage(every.join(heads.unionByName(named.select(F.col("hay_id").alias("paper_id"))).distinct(), "paper_id", "left_semi"))
    fields = p.select(
        "paper_id",
        F.explode(F.array(
            F.struct(F.lit("title").alias("field"), X.matches(F.col("title"), PAPER_TOKEN).alias("words")),
            F.struct(F.lit("abstract").alias("field"), X.matches(F.col("abstract"), PAPER_TOKEN).alias("words")),
        )).alias("f"),
    ).select("paper_id", "f.field", F.explode(F.array_distinct("f.words")).alias("token"))
    vocabulary = fields.select("token").distinct()
    inside = wanted.filter(F.length("term") >= 4).select(
        "term",
        F.explode(F.array_distinct(F.flatten(F.transform(
            F.sequence(F.lit(1), F.length("term")),
            lambda n: F.transform(F.sequence(F.lit(1), F.length("term") - n + 1), lambda s: F.substr(F.col("term"), s, n)),
        )))).alias("token"),
    )
    around = contains_join(
        wanted.filter(F.length("term") >= 4).select(F.col("term").alias("needle_id"), F.col("term").alias("needle")),
        vocabulary.select(F.col("token").alias("hay_id"), F.col("token").alias("text")),
    ).select(F.col("needle_id").alias("term"), F.col("hay_id").alias("token"))
    pairs = (
        wanted.select("term", F.col("term").alias("token")).unionByName(inside).unionByName(around).distinct()
    )
    hits = (
        fields.join(pairs, "token").select("paper_id", "field", "term").distinct().join(terms, "term")
        .groupBy("query_id", "paper_id", "n_terms")
        .agg(F.count_if(F.col("field") == "title").alias("title_hits"),
             F.count_if(F.col("field") == "abstract").alias("abstract_hits"))
    )
    id_hits = (
        named.select(F.col("needle_id").alias("term"), F.col("hay_id").alias("paper_id"))
        .join(terms, "term").groupBy("query_id", "paper_id", "n_terms").agg(F.count(F.lit(1)).alias("id_hits"))
    )
    titled = contains_join(q.select(F.col("query_id").alias("needle_id"), F.col("q").alias("needle")),
                           p.select(F.col("paper_id").alias("hay_id"), F.col("title").alias("text"))).select(
        F.col("needle_id").alias("query_id"), F.col("hay_id").alias("paper_id"), F.lit(True).alias("contained"))
    keys = ["query_id", "paper_id"]
    found = (
        hits.join(id_hits, [*keys, "n_terms"], "full_outer").join(titled, keys, "full_outer")
        .fillna(0, ["title_hits", "abstract_hits", "id_hits"])
        .join(q.select("query_id", "q"), "query_id").join(p.drop("abstract", "ids"), "paper_id")
    )
    n = F.coalesce("n_terms", F.lit(1))
    weighted = 0.60 * F.col("title_hits") / n + 0.35 * F.col("abstract_hits") / n + 0.05 * F.col("id_hits") / n
    score = (
        F.when(F.col("q") == F.col("title"), 1.0)
        .when(F.col("contained"), 0.95)
        .when((n == 1) & (F.col("title_hits") == 1), F.greatest(weighted, F.lit(0.90)))
        .otherwise(weighted)
    )
    scored = found.withColumn("score", r6(clamp01(score))).filter("score > 0")
    return top_k(scored, "query_id", k, F.desc("score"), *order).select(
        *keys, "score", "rank")
