"""Near copies: token sets are put in a common order where their rows are read."""

from itertools import combinations

from pyspark.sql import functions as F

from folioframe.operators import resolve as R


def told(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id int, tokens array<string>")


def test_one_order_and_frequent_tokens_last(spark, monkeypatch):
    monkeypatch.setattr(R, "COMMON", 2)
    sets = [{"a", "b", "c"}, {"a", "b", "d"}, {"a", "e"}, set(), {"a", "b", "c", "z"}]
    got = {r["id"]: (r["tokens"], r["n"]) for r in R.common_last(told(spark, sets), ["id"], told(spark, sets)).collect()}
    assert got == {0: (["c", "b", "a"], 3), 1: (["d", "b", "a"], 3), 2: (["e", "a"], 2), 3: ([], 0), 4: (["c", "z", "b", "a"], 4)}
    place = {t: i for i, t in enumerate(["c", "d", "e", "z", "b", "a"])}
    assert all(place[x] < place[y] for tokens, _ in got.values() for x, y in combinations(tokens, 2))


def test_words_are_not_shuffled_one_by_one(spark, monkeypatch):
    """The words of a text stand in one row until counted; each used to be shuffled with its count."""
    written = []
    keep = R.cut_lineage

    def noted(df):
        written.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df)

    monkeypatch.setattr(R, "cut_lineage", noted)
    rows = spark.range(60).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(30)], (F.col("id") % 6).cast("string")).alias("text"),
                                  F.col("id").alias("score"))
    got = {r["chunk_id"]: r["kept_id"] for r in R.dedup_near_text(rows, 0.9).collect()}
    assert set(got.values()) == {59} and len(got) == 60
    assert not any("collect_list" in plan for plan in written)
