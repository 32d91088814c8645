"""The stored vector lists against exact search, batches added later, and what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.operators import search as S
from folioframe.operators import vector_lists as V
from folioframe.sources.tables import Corpus
from tests.conftest import ROOT

DIM = 16


def rows(run):
    return sorted(tuple(r) for r in run.select("query_id", "chunk_id", "score", "rank").collect())


def clustered(spark, n, seed, ids=str):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, DIM))
    made = centres[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, DIM))
    made[::97] = 0.0
    made[1::101] = made[1]
    return spark.createDataFrame([(ids(i), v.tolist()) for i, v in enumerate(made)], f"chunk_id {'string' if ids is str else 'long'}, vector array<double>")


@pytest.fixture(scope="module")
def vectors(spark):
    return clustered(spark, 4000, 1).persist()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.filter("cast(chunk_id AS int) % 100 < 2").withColumnRenamed("chunk_id", "query_id")


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return V.build_lists(vectors, str(tmp_path_factory.mktemp("lists") / "ix"), DIM)


def test_exact_and_few_vectors_scored(vectors, queries, index):
    found = V.search_lists(queries, index, 10)
    assert rows(found.run) == rows(S.dense_search(queries, vectors, 10, DIM))
    scored = {r.query_id: r.scored for r in found.work.collect()}
    # The zero query is as near to one vector as to another and is scored against all.
    clear = [n for q, n in scored.items() if int(q) % 97]
    assert np.mean(clear) < 0.25 * 4000


@pytest.mark.parametrize("k", [1, 37, 5000])
def test_any_k(vectors, queries, index, k):
    some = queries.filter("cast(query_id AS int) < 1000")
    assert rows(V.search_lists(some, index, k).run) == rows(S.dense_search(some, vectors, k, DIM))


def test_added_batches_are_found_and_nothing_is_rewritten(spark, vectors, queries, tmp_path):
    index = V.build_lists(vectors.filter("cast(chunk_id AS int) % 2 = 0"), str(tmp_path / "ix"), DIM)
    before = {r.path for r in index.vectors().select(F.input_file_name().alias("path")).distinct().collect()}
    V.add_vectors(index, vectors.filter("cast(chunk_id AS int) % 2 = 1"))
    after = {r.path for r in index.vectors().select(F.input_file_name().alias("path")).distinct().collect()}
    assert before < after
    assert rows(V.search_lists(queries, V.open_lists(spark, index.path), 10).run) == rows(S.dense_search(queries, vectors, 10, DIM))


def test_lists_that_no_query_needs_are_not_read(vectors, queries, index):
    one = queries.filter("query_id = '500'")
    found = V.search_lists(one, index, 150)
    plan = found.run._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert any("list#" in f for f in filters)
    assert found.work.first().scored < 2000


def test_invalid_vectors_and_other_seeds(spark, tmp_path):
    bad = [("a", None), ("b", [1.0]), ("c", [float("nan")] * DIM), ("d", [1.0] * DIM), ("e", [0.0] * DIM), ("f", [-1.0] * DIM)]
    corpus = spark.createDataFrame(bad, "chunk_id string, vector array<double>")
    queries = corpus.withColumnRenamed("chunk_id", "query_id")
    found = V.search_lists(queries, V.build_lists(corpus, str(tmp_path / "ix"), DIM), 2)
    assert rows(found.run) == rows(S.dense_search(queries, corpus, 2, DIM))


def test_one_list_holds_most_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "FILE_ROWS", 100)
    same = spark.range(1500).select(F.col("id").alias("chunk_id"), F.array(*[F.lit(0.25)] * DIM).alias("vector"))
    other = clustered(spark, 300, 4, int).withColumn("chunk_id", F.col("chunk_id") + 2000)
    corpus = same.unionByName(other)
    index = V.build_lists(corpus, str(tmp_path / "ix"), DIM)
    assert index.vectors().groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).first()[0] < 400
    queries = corpus.filter("chunk_id IN (0, 2000, 2001)").withColumnRenamed("chunk_id", "query_id")
    assert rows(V.search_lists(queries, index, 12).run) == rows(S.dense_search(queries, corpus, 12, DIM))


def test_given_embeddings(spark, tmp_path):
    c = Corpus(spark, ROOT)
    found = V.search_lists(c.centroids, V.build_lists(c.vectors, str(tmp_path / "ix"), 64), 10)
    assert rows(found.run) == rows(S.dense_search(c.centroids, c.vectors, 10, 64))
