"""Costly rows that several steps use are computed once."""

import pytest
from pyspark.sql import functions as F

from folioframe.operators import resolve as D
from folioframe.operators import search as S


@pytest.fixture
def counted(spark):
    """A column passed through unchanged, and the number of values that have passed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(value):
        seen.add(1)
        return value

    return passed, seen


def test_every_round_searches_once(spark):
    searched = spark.sparkContext.accumulator(0)

    def counted(batches):
        for part in batches:
            searched.add(part.num_rows)
            yield part

    queries = spark.createDataFrame([(i, "a") for i in range(6)], "query_id long, text string")

    def search(pending):
        return pending.selectExpr("query_id", "query_id AS chunk_id", "1.0D AS score", "1 AS rank").mapInArrow(
            counted, "query_id long, chunk_id long, score double, rank int")

    found = S.iterative_search(queries, search, threshold=2.0, rounds=3)
    assert sorted(map(tuple, found.select("query_id", "iterations", "results").collect())) == [(i, 3, 1) for i in range(6)]
    assert searched.value == 18


def test_words_of_a_text_are_read_once(spark, counted):
    passed, seen = counted
    words = " ".join(f"w{i:02}" for i in range(20))
    rows = spark.createDataFrame([(1, 1, words), (1, 2, words), (1, 3, words + " more"), (1, 4, "other text"), (2, 5, words)], "query_id long, chunk_id long, text string")
    found = D.pairwise_jaccard(rows.withColumn("text", passed("text"))).select("query_id", "items", "duplicate_pairs").collect()
    assert sorted(map(tuple, found)) == [(1, 4, 3), (2, 1, 0)]
    assert seen.value == 5
