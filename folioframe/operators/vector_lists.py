"""A stored vector index of inverted lists whose searches are exact.

Vectors are dealt to the nearest of some centroids, which are fitted on a bounded sample. A list
is a partition of a Parquet table. Beside a vector stand its length along the centroid and the
length of what is left, so that for any query

    q . x  <=  (q . c) along + |q - (q . c) c| left          (c of unit length)

holds for a vector, and with the extremes of a list for all of it. A search scores the lists
that look best, and then whatever the k-th score found there does not rule out: first lists,
which are not read at all, then single vectors of those read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.scores import top_k
from folioframe.operators import index as I
from folioframe.operators import search as S
from folioframe.session import checkpoint_dir

#: Vectors of the sample for each list, lists at most, rounds of fitting, rows of a file.
SAMPLE, MOST_LISTS, ROUNDS, FILE_ROWS = 64, 4096, 10, 1_000_000
#: Vectors that the lists scored first hold together, as a multiple of k, and the slack of bounds.
FIRST, SLACK = 4, 2e-6
COLUMNS = "vector array<double>, along double, left double, list int"


@dataclass
class VectorLists:
    """An opened index: ``centroids`` by list and the table of vectors, partitioned by list."""

    spark: SparkSession
    path: str
    centroids: np.ndarray

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def extents(self) -> DataFrame:
        """``list, n, low, high, left``: size and extremes of each list over all batches."""
        return self.spark.read.parquet(f"{self.path}/extents").groupBy("list").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("left").alias("left"))


def fitted_centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Directions of unit length that the vectors of ``sample`` gather around (spherical k-means)."""
    lengths = np.linalg.norm(sample, axis=1, keepdims=True)
    points = np.divide(sample, lengths, out=np.zeros_like(sample), where=lengths > 0)[lengths.ravel() > 0]
    points = np.unique(points, axis=0)
    if not len(points):
        return np.eye(1, sample.shape[1])
    rng = np.random.default_rng(seed)
    centroids = points[rng.permutation(len(points))[:lists]]
    for _ in range(ROUNDS):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-300), centroids)
    return centroids


def build_lists(vectors: DataFrame, path: str, dim: int, lists: int | None = None) -> VectorLists:
    """Fit centroids and write the lists of ``vectors(chunk_id, vector)`` to ``path``.

    By default there are as many lists as the square root of the vectors, MOST_LISTS at most; the
    sample that reaches the driver has SAMPLE vectors for each, chosen by a hash of their ids.
    Vectors that are null, of another dimension or not finite are left out.
    """
    index = fit_lists(vectors, path, dim, lists)
    add_vectors(index, vectors)
    return index


def fit_lists(vectors: DataFrame, path: str, dim: int, lists: int | None = None) -> VectorLists:
    """An index without vectors whose centroids are fitted on a sample of ``vectors``."""
    spark = vectors.sparkSession
    valid = vectors.filter(I.valid_vector(F.col("vector"), dim))
    lists = lists or int(min(MOST_LISTS, max(1, np.sqrt(valid.count()))))
    sample = valid.select("vector").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE * lists).toArrow()
    matrix = S._as_matrix(sample.column("vector").combine_chunks()) if sample.num_rows else np.zeros((1, dim))
    centroids = fitted_centroids(matrix, lists)
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return VectorLists(spark, path, centroids)


def open_lists(spark: SparkSession, path: str) -> VectorLists:
    stored = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()
    return VectorLists(spark, path, S._as_matrix(stored.column("centroid").combine_chunks()))


def add_vectors(index: VectorLists, vectors: DataFrame) -> None:
    """Add ``vectors(chunk_id, vector)`` to their lists; nothing stored before is written again.

    A list with more than FILE_ROWS new vectors is dealt to several files.
    """
    spark, centroids = index.spark, index.centroids
    dim = centroids.shape[1]
    shared = spark.sparkContext.broadcast(centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            matrix = S._as_matrix(part.column(1))
            products = matrix @ shared.value.T
            nearest = products.argmax(axis=1)
            along = products[np.arange(len(matrix)), nearest]
            left = np.linalg.norm(matrix - along[:, None] * shared.value[nearest], axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(along), pa.array(left), pa.array(nearest.astype(np.int32))],
                names=["chunk_id", "vector", "along", "left", "list"])

    valid = vectors.filter(I.valid_vector(F.col("vector"), dim)).select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    schema = f"chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, {COLUMNS}"
    place = f"{checkpoint_dir(spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
    valid.mapInArrow(assigned, schema).write.parquet(place)
    placed = spark.read.schema(schema).parquet(place)
    extents = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("left").alias("left"))
    extents.coalesce(1).write.mode("append").parquet(f"{index.path}/extents")
    # One row for each list, MOST_LISTS at most.
    files = F.broadcast(extents.select("list", F.ceil(F.col("n") / FILE_ROWS).alias("_files")))
    dealt = placed.join(files, "list").withColumn("_file", F.pmod(F.xxhash64("chunk_id"), "_files"))
    dealt.repartition("list", "_file").drop("_files", "_file").write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(f"{index.path}/vectors")


@dataclass
class Found:
    """The run, and for each query how many vectors were scored (``query_id, scored``)."""

    run: DataFrame
    work: DataFrame


def search_lists(queries: DataFrame, index: VectorLists, k: int = 10) -> Found:
    """Exact inner-product top-k of ``queries(query_id, vector)``; the same rows as ``dense_search``.

    Queries are counted and cut into blocks of bounded size as there; a block's vectors and the
    k-th scores found for it are all that the driver holds.
    """
    dim = index.centroids.shape[1]
    valid = queries.filter(I.valid_vector(F.col("vector"), dim)).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-valid.count() * dim * 8 // S.BLOCK_BYTES))
    q_type = queries.schema["query_id"].dataType.simpleString()
    parts = [_search_block(valid.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow(), index, k, q_type) for b in range(blocks)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    run = top_k(rows.filter("chunk_id IS NOT NULL"), "query_id", k, *S.best()).select("query_id", "chunk_id", "score", "rank")
    return Found(run, rows.filter("chunk_id IS NULL").groupBy("query_id").agg(F.sum("score").cast("long").alias("scored")))


def _search_block(block: pa.Table, index: VectorLists, k: int, q_type: str) -> DataFrame:
    spark, place = index.spark, f"{checkpoint_dir(index.spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
    wanted = S._as_matrix(block.column("vector").combine_chunks()) if block.num_rows else np.zeros((0, index.centroids.shape[1]))
    extents = index.extents().orderBy("list").toArrow().to_pydict()
    known = np.array(extents["list"], np.int64)
    sizes, low, high, left = (np.array(extents[x]) for x in ("n", "low", "high", "left"))
    towards = wanted @ index.centroids.T
    aside = np.sqrt(np.maximum(0, (wanted ** 2).sum(axis=1)[:, None] - towards ** 2))
    most = np.maximum(towards[:, known] * low, towards[:, known] * high) + aside[:, known] * left
    order = np.argsort(-most, axis=1, kind="stable")
    # The lists scored first: the most promising ones that hold FIRST times k vectors.
    before = np.cumsum(sizes[order], axis=1) - sizes[order] if len(known) else np.zeros(order.shape)
    first = np.zeros(most.shape, bool)
    np.put_along_axis(first, order, before < FIRST * k, axis=1)
    bars = np.full(len(wanted), -np.inf)
    _scored(index, block, wanted, towards, aside, known, first, bars, k, q_type).write.parquet(f"{place}/first")
    tried = spark.read.parquet(f"{place}/first")
    best = top_k(tried.filter("chunk_id IS NOT NULL"), "query_id", k, *S.best()).filter(F.col("rank") == k).select("query_id", "score").toArrow()
    at = {q: i for i, q in enumerate(block.column("query_id").to_pylist())}
    for q, score in zip(best.column("query_id").to_pylist(), best.column("score").to_pylist(), strict=True):
        bars[at[q]] = score - SLACK
    rest = (most >= bars[:, None]) & ~first
    return tried.unionByName(_scored(index, block, wanted, towards, aside, known, rest, bars, k, q_type))


def _scored(index: VectorLists, block: pa.Table, wanted: np.ndarray, towards: np.ndarray, aside: np.ndarray, known: np.ndarray,
            chosen: np.ndarray, bars: np.ndarray, k: int, q_type: str) -> DataFrame:
    """Best ``k`` of every task among the ``chosen`` lists of each query, and, without chunk, how
    many vectors it scored. Only partitions that any query chose are read."""
    lists = known[chosen.any(axis=0)]
    asking = {int(x): np.flatnonzero(chosen[:, i]) for i, x in enumerate(known) if chosen[:, i].any()}
    shared = index.spark.sparkContext.broadcast((block.column("query_id").combine_chunks(), wanted, towards, aside, bars, asking))
    rows = index.vectors().filter(F.col("list").isin([int(x) for x in lists]))
    c_type = rows.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, along_all, over_all, floor, readers = shared.value
        best: dict[int, tuple[np.ndarray, pa.Array]] = {}
        work = np.zeros(len(vectors), np.int64)
        for part in batches:
            part = pa.Table.from_batches([part]).sort_by([("list", "ascending"), ("chunk_id", "ascending")]).combine_chunks()
            if not part.num_rows:
                continue
            members, ids = part["list"].to_numpy(), part["chunk_id"].combine_chunks()
            matrix, along, left = S._as_matrix(part["vector"].combine_chunks()), part["along"].to_numpy(), part["left"].to_numpy()
            for own in np.unique(members):
                a, b = np.searchsorted(members, (own, own + 1))
                for ask in readers.get(int(own), ()):
                    reach = along_all[ask, own] * along[a:b] + over_all[ask, own] * left[a:b]
                    inside = a + np.flatnonzero(reach >= floor[ask])
                    work[ask] += len(inside)
                    scores = np.round(matrix[inside] @ vectors[ask], 6)
                    place = np.argsort(-scores, kind="stable")[:k]
                    scores, chunk = scores[place], ids.take(pa.array(inside[place]))
                    if ask in best:
                        table = pa.table({"s": pa.array(np.concatenate((best[ask][0], scores))), "c": pa.concat_arrays([best[ask][1], chunk])})
                        table = table.sort_by([("s", "descending"), ("c", "ascending")]).slice(0, k)
                        scores, chunk = table["s"].to_numpy(), table["c"].combine_chunks()
                    best[ask] = scores, chunk
        counted = np.flatnonzero(work)
        for ask, (scores, chunk) in best.items():
            yield pa.RecordBatch.from_arrays([names.take(pa.array([ask] * len(chunk), pa.int64())), chunk, pa.array(scores)], names=["query_id", "chunk_id", "score"])
        if len(counted):
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(counted)), pa.nulls(len(counted), ids.type), pa.array(work[counted].astype(float))], names=["query_id", "chunk_id", "score"])

    return rows.select("list", "chunk_id", "vector", "along", "left").mapInArrow(run, f"query_id {q_type}, chunk_id {c_type}, score double")
