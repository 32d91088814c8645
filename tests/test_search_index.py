"""The stored index with bounds, and requests with filters of their own."""

import re

import pytest
from pyspark.sql import functions as F

from folioframe.operators import impact_index as P
from folioframe.operators import requests as R
from folioframe.operators import search as S
from folioframe.sources.tables import Corpus
from tests.conftest import ROOT


def rows(run):
    return sorted(tuple(r) for r in run.select("query_id", "chunk_id", "score", "rank").collect())


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark, ROOT)


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return P.build_impacts(corpus.chunks, str(tmp_path_factory.mktemp("index") / "impacts"))


def test_reopened_index_gives_the_same_run(spark, corpus, index):
    again = P.open_impacts(spark, index.path)
    for k in (1, 10, 500):
        assert rows(P.search_impacts(corpus.queries, again, k).run) == rows(S.bm25_search(corpus.queries, corpus.chunks, k))


def test_few_pairs_are_scored(spark, tmp_path):
    larger = Corpus(spark, ROOT.replace("0.001", "0.01"))
    found = P.search_impacts(larger.queries, P.build_impacts(larger.chunks, str(tmp_path / "ix")), 10)
    assert rows(found.run) == rows(S.bm25_search(larger.queries, larger.chunks, 10))
    assert found.scored.count() < 0.1 * larger.queries.count() * larger.chunks.count()


def test_bounds_are_added_up_without_a_shuffle(spark, corpus, index):
    asked = S.query_terms(corpus.queries).join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "head")
    asked.write.mode("overwrite").parquet(f"{index.path}/asked")
    plan = P.bounds(spark.read.parquet(f"{index.path}/asked"), index)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange (hash|range|single)", plan), plan


TINY = [(str(i), t) for i, t in enumerate(["a b", "a b c", "a", "a a a b", "", None, "d a", "b b", "c a b"])]


@pytest.mark.parametrize("k", [1, 2, 5, 50])
def test_weights_below_zero_and_string_ids(spark, tmp_path, k):
    chunks = spark.createDataFrame(TINY, "chunk_id string, text string")
    queries = spark.createDataFrame([("x", "a b"), ("y", "b"), ("z", "c d d"), ("n", "nothing"), ("e", None)], "query_id string, text string")
    found = P.search_impacts(queries, P.build_impacts(chunks, str(tmp_path / "ix"), buckets=2), k)
    assert rows(found.run) == rows(S.bm25_search(queries, chunks, k))


def test_groups_of_queries(spark, corpus, index, monkeypatch):
    monkeypatch.setattr(P, "TERMS_AT_ONCE", 300)
    assert rows(P.search_impacts(corpus.queries, index, 10).run) == rows(S.bm25_search(corpus.queries, corpus.chunks, 10))


def test_restricted_before_the_cut(spark, corpus, index):
    allowed = corpus.chunks.filter("lang = 'de'").select("chunk_id")
    found = P.search_impacts(corpus.queries, index, 5, lambda df: df.join(allowed, "chunk_id", "left_semi"))
    assert rows(found.run) == rows(S.bm25_search(corpus.queries, corpus.chunks, 5, {"lang": "de"}))


def test_predicates_of_bitmaps(spark, corpus):
    filters = spark.createDataFrame(
        [(1, "lang", "en"), (1, "lang", "de"), (2, "lang", "fr"), (2, "source", "src1"), (3, "lang", "xx"), (4, "no", "key")],
        "query_id long, key string, value string")
    bitmaps = R.metadata_bitmaps(corpus.chunks)
    predicates = R.predicates_of(filters)
    told = R.Filters(predicates, R.compiled(predicates, bitmaps), bitmaps.numbers)
    ids = [(q, r.chunk_id, r.lang, r.source) for r in corpus.chunks.collect() for q in range(1, 6)]
    kept = told.keep(spark.createDataFrame(ids, "query_id long, chunk_id long, lang string, source string")).collect()
    rule = {1: lambda lang, source: lang in ("en", "de"), 2: lambda lang, source: lang == "fr" and source == "src1",
            3: lambda *_: False, 4: lambda *_: False, 5: lambda *_: True}
    assert sorted(map(tuple, kept)) == sorted(x for x in ids if rule[x[0]](x[2], x[3]))


def test_requests_with_string_ids(spark, corpus):
    settings = [("a", "hybrid", 5, 0.3, 0.7, True), ("b", "dense", 4, 0.0, 0.0, False), ("c", "sparse", 300, 1.0, 0.0, False), ("d", "hybrid", 3, 0.0, 0.0, False)]
    text = {name: r.text for name, r in zip("abcd", corpus.queries.orderBy("query_id").collect(), strict=False)}
    requests = spark.createDataFrame(
        [(q, text[q], *rest) for q, *rest in settings], "query_id string, text string, mode string, top_k int, vector_weight double, keyword_weight double, rerank boolean")
    chunks = corpus.chunks.withColumn("chunk_id", F.concat(F.lit("c"), F.lpad(F.col("chunk_id").cast("string"), 6, "0")))
    filters = spark.createDataFrame([("a", "lang", "en"), ("c", "lang", "de")], "query_id string, key string, value string")
    answers = R.search_requests(requests, chunks, filters)
    got = answers.results.collect()
    lang = {r.chunk_id: r.lang for r in chunks.collect()}
    assert {lang[r.chunk_id] for r in got if r.query_id == "a"} == {"en"}
    german = [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == "c"]
    plain = S.bm25_search(requests.filter("query_id = 'c'"), chunks, 300, {"lang": "de"}).orderBy("rank").collect()
    assert german == [r.chunk_id for r in plain]
    stages = {r.query_id: r for r in answers.stages.collect()}
    assert stages.keys() == set("abcd")
    assert stages["b"].sparse_candidates == 0 and stages["b"].dense_candidates == 8 and stages["b"].final_results == 4
    assert stages["c"].dense_candidates == 0 and stages["c"].eligible == sum(v == "de" for v in lang.values())
    assert stages["a"].reranked_candidates == stages["a"].fused_candidates and stages["b"].eligible == len(lang)


def test_no_requests_and_no_chunks(spark, corpus):
    schema = "query_id long, text string, mode string, top_k int, vector_weight double, keyword_weight double, rerank boolean"
    none = spark.createDataFrame([], "query_id long, key string, value string")
    assert R.search_requests(spark.createDataFrame([], schema), corpus.chunks, none).results.collect() == []
    one = spark.createDataFrame([(1, "a b", "hybrid", 3, 0.5, 0.5, True)], schema)
    answers = R.search_requests(one, corpus.chunks.limit(0), none)
    assert answers.results.collect() == [] and answers.stages.first().eligible == 0


def test_bm25_scores_are_finished_where_chunks_are_read(spark, capsys):
    chunks = spark.createDataFrame(
        [(f"d{i:02}", None if i % 9 == 8 else " ".join(["Blue", "red", "green"][i % 3:] + ["red"] * (i % 4) + [f"w{i % 5}"]), {"lang": "en" if i % 2 else "de"})
         for i in range(40)], "chunk_id string, text string, metadata map<string,string>").repartition(3)
    queries = spark.createDataFrame([(1, "blue red red"), (2, "w3 absent"), (3, "absent"), (4, None)], "query_id long, text string")
    for wanted in (None, {"lang": "de"}):
        scored = S.bm25_over_texts(queries, chunks).join(S.I.metadata_filter(chunks, wanted or {}).select("chunk_id"), "chunk_id")
        plain = S.top_k(scored, "query_id", 7, *S.best()).select("query_id", "chunk_id", "score", "rank")
        found = S.bm25_search(queries, chunks, 7, wanted)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    found.explain()
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", capsys.readouterr().out)
    assert dealt and not any("chunk_id" in keys for keys in dealt)


def test_papers_of_equal_texts_are_scored_k_at_a_time(spark, monkeypatch):
    sizes = []
    original = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: (lambda kept: sizes.append(kept.count()) or kept)(original(df)))
    papers = spark.range(300).selectExpr(
        "id AS paper_id", "'large ring' AS title", "concat('steel ', id % 2) AS abstract", "id % 7 AS citation_count", "2000 AS year",
        "CAST(NULL AS string) AS arxiv_id", "CAST(NULL AS string) AS doi", "CAST(NULL AS string) AS pmid", "concat('part-', id) AS provider_paper_id")
    queries = spark.createDataFrame([("a", "ring part-299"), ("b", "steel"), ("c", "large ring")], "query_id string, text string")
    found = {}
    for r in S.keyword_paper_search(queries, papers, [], 3).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append(r["paper_id"])
    assert found == {"a": [299, 293, 286], "b": [293, 286, 279], "c": [293, 286, 279]} and sizes[1] == 7
