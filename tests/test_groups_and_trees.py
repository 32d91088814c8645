"""Contradictions in small and large groups, claims of long texts, and deep trees."""

import random

import pytest
from pyspark.sql import functions as F

from folioframe.functions.lexicon import ASSERTION, NEGATION
from folioframe.operators import chunk as K
from folioframe.operators import evidence as V


def expected(rows, similarity):
    folded = {}
    for query, chunk, text in rows:
        tokens = frozenset(text.split())
        least, copies = folded.get((query, tokens), (chunk, 0))
        folded[query, tokens] = min(least, chunk), copies + 1
    out = set()
    items = [(q, t, i, n) for (q, t), (i, n) in folded.items()]
    for q, t, i, n in items:
        for q2, t2, i2, n2 in items:
            if q == q2 and i < i2 and bool(t & set(NEGATION)) != bool(t2 & set(NEGATION)):
                alike = len(t & t2) / len(t | t2)
                if alike >= similarity:
                    level = 0.9 if bool(t & set(ASSERTION)) != bool(t2 & set(ASSERTION)) else 0.7
                    out.add((q, i, i2, round(alike, 6), level, n * n2))
    return out


@pytest.mark.parametrize("similarity", [0.1, 0.35])
def test_contradictions_of_small_and_large_groups(spark, similarity):
    rng = random.Random(4)
    rows, number = [], 0
    for query, size in ((1, 3), (2, 32), (3, 33), (4, 150), (5, 1)):
        for _ in range(size):
            words = [f"w{rng.randrange(12)}" for _ in range(6)]
            words += rng.choice([[], ["not"], ["supports"], ["not", "supports"]])
            rows.append((query, number, " ".join(words)))
            number += 1
    frame = spark.createDataFrame(rows, "query_id long, chunk_id long, text string")
    got = {tuple(r) for r in V.contradiction_pairs(frame, similarity).collect()}
    assert got == expected(rows, similarity) and got


def test_confidence_is_not_computed_for_each_claim(spark):
    sentence = "This sentence is long enough to stand as a claim of its own, number "
    text = ". ".join(f"{sentence}{i}" for i in range(2000)) + "."
    frame = spark.createDataFrame([(1, 1, 7, 0.5, "s", text)], "query_id long, rank int, chunk_id long, relevance double, source string, text string")
    claims = V.extract_claims(frame)
    assert claims.count() == 2000
    assert claims.select("confidence").distinct().collect()[0][0] == pytest.approx(0.65)


def test_a_chain_takes_logarithmic_rounds(spark, monkeypatch):
    from folioframe import session

    cuts = []
    original = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: cuts.append(1) or original(df))
    n = 2000
    chain = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    tree = K.document_tree(chain)
    assert tree.filter("depth <> node_id + 1").isEmpty() and tree.count() == n
    assert len(cuts) < 2 * 13


def test_circles_and_orphans(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 9), (5, 4), (6, 6), (7, 8), (8, 7), (10, 7)]
    tree = K.document_tree(spark.createDataFrame(rows, "node_id long, parent_id long")).collect()
    assert {(r.node_id, r.parent_id, r.depth) for r in tree} == {(1, None, 1), (2, 1, 2), (3, 2, 3), (4, None, 1), (5, 4, 2), (6, None, 1)}
    assert K.document_tree(spark.createDataFrame([], "node_id long, parent_id long")).collect() == []


def test_no_round_of_resolving_broadcasts_a_table(spark, monkeypatch, capsys):
    from folioframe.operators import resolve

    original = resolve.cut_lineage

    def shown(df):
        df.explain()
        return original(df)

    monkeypatch.setattr(resolve, "cut_lineage", shown)
    links = spark.range(40).selectExpr("id AS record", "explode(array(id DIV 2, 100 + (id + 1) DIV 2)) AS n").selectExpr("record", "CAST(n AS string) AS value")
    assert {r["entity"] for r in resolve.resolve_entities(links).collect()} == {0}
    assert "Broadcast" not in capsys.readouterr().out


def test_a_section_without_any_id_has_null_ids(spark):
    items = spark.createDataFrame(
        [(1, 0, None, "first", "a"), (1, 1, "x", "second", "b"), (1, 2, None, "third", "b")], "query_id long, position long, id string, claim string, topic string")
    found = {r["topic"]: (r["content"], r["evidence_ids"]) for r in V.group_findings(items, ("topic",)).collect()}
    assert found == {"a": ("first", None), "b": ("second third", "x")}
