"""Helpers that the operators of this folder share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


#: Folders handed out by this driver and not freed yet, oldest first.
made: list[str] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new place below the shared checkpoint folder."""
    made.append(f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}")
    return made[-1]


def free(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders that nothing reads any more."""
    for path in folders:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if path in made:
            made.remove(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    It cuts the lineage, so that a lost executor costs one stage at most, keeps results that
    are used twice from being computed twice, and gives the optimizer the true size.
    """
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, also where ``use`` has lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lowered(words: Column) -> Column:
    """A-Z of each word in lower case, all other letters as they are."""
    return F.transform(
        words, lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, LOWER)))


def id_key(doc_id: Column) -> Column:
    """A document id that joins also where it is null."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """``v, root``: the smallest vertex that each vertex of ``edges(a, b)`` is linked with.

    Each round takes the smallest root among the neighbours and then the root's own root, so
    that the number of rounds grows with the logarithm of the longest path. Every round is
    written out; nothing but the number of changed vertices reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{label}-edges")
    lowest = both.groupBy("a").agg(F.min("b").alias("b"))
    state = stored(lowest.select(F.col("a").alias("v"), F.least("a", "b").alias("root")), f"{label}-roots")
    while True:
        near = both.join(state, both.b == state.v).groupBy("a").agg(F.min("root").alias("near"))
        hooked = stored(
            state.join(near, state.v == near.a).select("v", F.col("root").alias("old"), F.least("root", "near").alias("root")),
            f"{label}-hooked")
        up = hooked.select(F.col("v").alias("root"), F.col("root").alias("above"))
        state = stored(
            hooked.join(up, "root").select("v", F.least("root", "above").alias("root"), "old"), f"{label}-roots")
        if state.filter("root <> old").isEmpty():
            return state.select("v", "root")
        state = state.select("v", "root")



def contracted(edges: DataFrame, label: str) -> DataFrame:
    """``v, root`` as ``components`` gives them, by contraction.

    Every vertex points to its least neighbour, pointers are followed to their ends by doubling,
    and only edges between different ends are left for the next level, so the edges inside a
    crowd are read once.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{label}-edges")
    state = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("root")), f"{label}-roots")
    while True:
        up = state.select(F.col("v").alias("root"), F.col("root").alias("above"))
        state = stored(state.join(up, "root").select("v", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), f"{label}-roots")
        still = state.filter("moved").isEmpty()
        state = state.select("v", "root")
        if still:
            break
    ends = [state.select(F.col("v").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b")]
    rest = stored(
        both.filter("a > b").join(ends[0], "a").join(ends[1], "b").filter("root_a <> root_b")
        .select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b")).distinct(), f"{label}-rest")
    if rest.isEmpty():
        return state
    above = contracted(rest, label).select(F.col("v").alias("root"), F.col("root").alias("top"))
    return stored(state.join(above, "root", "left").select("v", F.coalesce("top", "root").alias("root")), f"{label}-roots")


def held_out(doc_id: str, parts: int) -> Column:
    """Whether a document is kept from training: its crc32 leaves 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 2, F.lit(False))
