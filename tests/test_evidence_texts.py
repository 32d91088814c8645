"""Texts of found chunks: only they are shuffled, and they are put together once."""

from pyspark.sql import functions as F

from folioframe.operators import search as S
from folioframe.plans import base as B
from folioframe.session import cut_lineage
from folioframe.sources.tables import Corpus
from tests.conftest import ROOT


def test_texts_meet_a_written_run_where_they_are_read(spark):
    run = cut_lineage(spark.createDataFrame([(1, 3, 1), (1, 4, 2), (2, 3, 1)], "query_id long, chunk_id long, rank int"))
    texts = spark.range(200, numPartitions=4).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("word "), 5000).alias("text"))
    found = S.with_texts(run, texts)
    assert sorted(map(tuple, found.select("query_id", "chunk_id", "rank").collect())) == [(1, 3, 1), (1, 4, 2), (2, 3, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" not in plan and plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(xxhash64") > 0


def test_evidence_reads_the_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(text):
        seen.add(1)
        return text

    c = Corpus(spark, ROOT)
    c.__dict__["chunks"] = c.chunks.withColumn("text", passed("text"))
    first = sorted(map(tuple, B.evidence(c).select("query_id", "chunk_id", "text").collect()))
    read = seen.value
    again = sorted(map(tuple, B.evidence(c).select("query_id", "chunk_id", F.upper("text")).collect()))
    assert seen.value == read
    assert [(q, k) for q, k, _ in first] == [(q, k) for q, k, _ in again] and len(first) > 0
