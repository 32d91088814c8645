"""Exact top-k by inner product over vector-approximation segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import stored
from folioframe.session import ship_package

SCALE, CELLS, SEGMENT, ASKED, READ = 1024, 64, 16_384, 128, 64
#: Components are held within this, so that the sums of 128 products fit in a long.
LARGEST = 1 << 28


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """The components as floor(1024 x), a row per vector of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64).reshape(len(vectors), -1)


class Segment:
    """A vector-approximation file: for each vector the number of its cell in each dimension,
    and apart from them the exact vectors, which are read for candidates only."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], exact[order]
        low, high = self.exact.min(axis=0), self.exact.max(axis=0)
        self.edges = low + np.ceil((high - low + 1) * np.arange(CELLS + 1)[:, None] / CELLS).astype(np.int64)
        cells = np.empty(self.exact.shape, np.uint8)
        for d in range(cells.shape[1]):
            cells[:, d] = np.searchsorted(self.edges[:, d], self.exact[:, d], "right") - 1
        self.cells = cells

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with any vector of each cell."""
        dims = np.arange(self.cells.shape[1])
        low = self.edges[self.cells, dims].astype(float)
        high = self.edges[self.cells.astype(int) + 1, dims].astype(float) - 1
        up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T

    def search(self, asked: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query id, vector id, score) of the k best of each query; ties go to smaller ids.

        Candidates are those whose upper bound reaches the k-th greatest lower bound. They are
        read from the highest upper bound on, until the k-th score is above all that is left.
        """
        lower, upper = self.bounds(queries)
        slack = 1e-9 * np.abs(upper).max(initial=1.0)
        for number, query_id in enumerate(asked.tolist()):
            others = self.ids != query_id
            low, high = lower[number], upper[number]
            n = int(others.sum())
            if not n:
                continue
            floor = np.partition(low[others], n - k)[n - k] if n > k else -np.inf
            chosen = np.flatnonzero(others & (high >= floor - slack))
            chosen = chosen[np.argsort(-high[chosen], kind="stable")]
            best = np.zeros((0, 2), np.int64)
            for at in range(0, len(chosen), READ):
                part = chosen[at:at + READ]
                if len(best) == k and high[part[0]] + slack < -best[-1, 0]:
                    break
                scores = self.exact[part] @ queries[number]
                best = np.concatenate((best, np.stack((-scores, self.ids[part]), axis=1)))
                best = best[np.lexsort((best[:, 1], best[:, 0]))][:k]
            for score, vec_id in best.tolist():
                yield query_id, vec_id, -score


def top_k(vectors: DataFrame, k: int, every: int = 100, segment: int = SEGMENT) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of each query among all other vectors.

    Queries are the rows of ``vectors(vec_id, embedding)`` whose id ``every`` divides. Vectors
    that are null, empty or hold null or non-finite components, and rows without id, take no
    part; vectors of different lengths do not meet; rows of the query's own id are not its
    candidates, other repeated rows each are. The vectors are dealt to segments of bounded
    size; each query block meets each segment once, and a query's segments' best are merged.
    """
    ship_package(vectors.sparkSession)
    valid = stored(
        vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
            F.size("embedding").alias("dim")), "vectors")
    segments = max(1, -(-valid.count() // segment))
    place = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(segments)).cast("int")
    stored_side = valid.select("dim", place.alias("segment"), F.lit(0).alias("asks"), "vec_id", "embedding")
    asking = valid.filter(F.col("vec_id") % every == 0).select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("segment"), F.lit(1).alias("asks"), "vec_id", "embedding")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, exact, file = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("dim", "segment", "asks")], axis=1)
            cuts = np.flatnonzero(np.any(np.diff(keys, axis=0, prepend=keys[:1] - 1, append=keys[-1:] + 1), axis=1)) if len(keys) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                dim, number, asks = keys[a].tolist()
                if (dim, number) != now:
                    now, ids, exact, file = (dim, number), [], [], None
                part = batch.slice(a, b - a)
                own, rows = part.column("vec_id").to_numpy(), whole_numbers(part.column("embedding"))
                if not asks:
                    ids.append(own)
                    exact.append(rows)
                    continue
                if not ids:
                    continue
                file = file or Segment(np.concatenate(ids), np.concatenate(exact))
                for at in range(0, len(own), ASKED):
                    found = list(file.search(own[at:at + ASKED], rows[at:at + ASKED], k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    dealt = stored_side.unionByName(asking).repartition("dim", "segment").sortWithinPartitions("dim", "segment", "asks")
    found = dealt.mapInArrow(searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
