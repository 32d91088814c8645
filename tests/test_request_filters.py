"""Filters of each request, and results by group, met where the chunks are read."""

import re

import pytest
from pyspark.sql import functions as F

from folioframe.operators import requests as R
from folioframe.operators import search as S

FILTERS = {
    1: [("lang", "en")], 2: [("lang", "en"), ("lang", "de"), ("source", "s1")], 3: [("lang", "xx")], 4: [("size", "9")],
    5: [("lang", None)], 6: [("lang", None), ("lang", "de")], 7: [(None, "en")], 8: [(None, "en"), ("lang", "en")], 9: [("no such key", "en")],
}


@pytest.fixture(scope="module")
def chunks(spark):
    maps = [{"lang": "en", "source": "s1"}, {"lang": "de", "source": "s1"}, {"lang": "de"}, {"lang": None, "source": "s1"}, None, {}, {"lang": "en", "size": "9"}]
    return spark.createDataFrame(
        [(f"d{i:02}", None if i % 13 == 12 else f"blue w{i % 4} " + "red " * (i % 5), maps[i % len(maps)], ["x", "y", None][i % 3]) for i in range(80)],
        "chunk_id string, text string, metadata map<string,string>, origin string").repartition(3)


def rows(run):
    return sorted(map(str, run.collect()))


def test_filters_are_met_before_the_cut(spark, chunks, capsys):
    queries = spark.createDataFrame([(i, "blue red w2" if i % 2 else "w3 red red") for i in range(11)], "query_id long, text string")
    filters = spark.createDataFrame([(q, k, v) for q, fs in FILTERS.items() for k, v in fs], "query_id long, key string, value string")
    predicates = R.predicates_of(filters)
    bitmaps = R.metadata_bitmaps(chunks)
    told = R.Filters(predicates, R.compiled(predicates, bitmaps), bitmaps.numbers)
    plain = S.top_k(told.keep(S.bm25_over_texts(queries, chunks)), "query_id", 6, *S.best()).select("query_id", "chunk_id", "score", "rank")
    found = S.bm25_search(queries, chunks, 6, predicates=predicates)
    assert rows(found) == rows(plain)
    assert {r["query_id"] for r in found.select("query_id").distinct().collect()} == {0, 1, 2, 4, 6, 8, 10}
    found.explain()
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", capsys.readouterr().out)
    assert dealt and not any("chunk_id" in keys for keys in dealt)


def test_groups_are_cut_where_chunks_are_read(spark, chunks, capsys):
    queries = spark.createDataFrame([(1, "blue red w2"), (2, "w3"), (3, "absent")], "query_id long, text string")
    scored = S.bm25_over_texts(queries, chunks).join(chunks.select("chunk_id", "origin"), "chunk_id")
    plain = S.top_k(scored, ["query_id", "origin"], 4, *S.best()).select("query_id", "chunk_id", "score", "origin", "rank")
    found = S.federated_by_column(queries, chunks, "origin", 4)
    assert rows(found.select(*plain.columns)) == rows(plain) and found.filter(F.col("origin").isNull()).count()
    found.explain()
    dealt = re.findall(r"hashpartitioning\((.*?), \d+\)", capsys.readouterr().out)
    assert dealt and not any("chunk_id" in keys for keys in dealt)
