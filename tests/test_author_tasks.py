"""Authors without an ORCID are dealt to many tasks."""

from pyspark.sql import functions as F

from folioframe.operators import resolve as R


def test_rows_without_orcid_do_not_meet_in_one_task(spark):
    """The rows of papers used to be joined by ORCID, which put all rows without one into one task."""
    rows = spark.range(4000).select(
        F.col("id").alias("paper_id"), F.lit(1).alias("position"), F.concat(F.lit("Ann "), (F.col("id") % 500).cast("string")).alias("name"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("0-"), (F.col("id") % 500).cast("string"))).alias("orcid"), F.lit(None).cast("string").alias("affiliation"))
    stored = spark.createDataFrame([(1, "ann 0", None, None)], "author_id long, name string, orcid string, affiliation string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        people, links = R.sync_authors(rows, stored)
        found = {r["paper_id"]: r["author_id"] for r in links.collect()}
        known = people.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: "1" if i % 500 == 0 else f"new:ann {i % 500}" for i in range(4000)} and known == 500
    sizes = [r["count"] for r in R._left_join_known(rows.repartition(4), rows.select("orcid", F.lit(1).alias("x")).distinct(), "orcid").groupBy(
        F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3600


def test_first_spelling_orcid_and_place(spark):
    rows = [(2, 1, "ANN", None, "late"), (1, 2, "Ann", "0-1", None), (1, 1, "Bob", None, None), (3, 1, "A. Nn", "0-1", "last"), (1, 3, "ann", None, "early")]
    incoming = spark.createDataFrame(rows, "paper_id int, position int, name string, orcid string, affiliation string")
    stored = spark.createDataFrame([(7, "bob", None, None)], "author_id long, name string, orcid string, affiliation string")
    people, links = R.sync_authors(incoming, stored)
    assert {tuple(r) for r in people.collect()} == {("7", "bob", None, None), ("new:ann", "Ann", "0-1", "early")}
    assert {tuple(r) for r in links.collect()} == {(1, "7", 1), (1, "new:ann", 2), (2, "new:ann", 1), (3, "new:ann", 1)}
