"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import stored

# A rate above PIECE is drawn as a sum of equal parts, each of them inverted by a table of
# STEPS cumulative chances; at PIECE the rest beyond the table is below the smallest double.
PIECE, STEPS, DIGITS = 16.0, 80, 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    head = F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS)
    return F.conv(head, 16, 10).cast("double") / float(16 ** DIGITS)


def source_key(source: Column) -> Column:
    """Sources as keys that join also where they are null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def cumulative(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ..., STEPS - 1."""
    def add(state: Column, k: Column) -> Column:
        term = F.when(k == 0, F.exp(-rate)).otherwise(state["term"] * rate / k)
        total = state["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    zero = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), zero, add, lambda s: s["cdf"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """``_llm_source, rate``: the mean number of times that a document of a source comes out.

    A source's size is the characters of its texts and one per document. The mix has
    ``epochs`` times the size of the input; a source gets the part of its weight, by default
    its size to the power ``temperature``. With given weights, sources without one get none.
    """
    size = F.length(F.coalesce(F.col("text"), F.lit(""))) + 1
    sizes = stored(
        docs.select(source_key(F.col("source")).alias("_llm_source"), size.alias("size"))
        .groupBy("_llm_source").agg(F.sum("size").cast("double").alias("size")), "mixture-sizes")
    if weights is None:
        weight = F.pow("size", F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("_llm_source") == source_key(F.lit(name)), float(value)).otherwise(weight)
    weighted = sizes.withColumn("weight", weight)
    total = weighted.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    scale = epochs * total.size / total.weight if total.weight else 0.0
    return weighted.select("_llm_source", (F.col("weight") / F.col("size") * scale).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """``docs`` with each row as often as its hash draws from its source's Poisson rate.

    Adds ``copy`` (from 1), in place of an input column of that name. Rows of one id draw alike, so the result does not depend on how
    rows are dealt to tasks, and a lost task draws the same again. A null source is a source;
    a null id draws as an empty one; null texts count as empty. The rows are dealt to tasks and
    sorted within them by a hash of id and copy: a global shuffle. An empty table stays empty.
    """
    rates = source_rates(docs, weights, temperature, epochs)
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1))
    drawn = stored(
        rates.withColumn("_llm_pieces", pieces.cast("int"))
        .select("_llm_source", "_llm_pieces", cumulative(F.col("rate") / F.col("_llm_pieces")).alias("_llm_cdf")), "mixture-rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def draw(piece: Column) -> Column:
        u = uniform(F.lit(str(seed)), key, piece.cast("string"))
        return F.size(F.filter("_llm_cdf", lambda c: c <= u))

    times = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_llm_pieces")), draw), F.lit(0), lambda a, n: a + n)
    counted = docs.withColumn("_llm_source", source_key(F.col("source"))).join(drawn, "_llm_source").withColumn("_llm_times", times)
    copies = counted.filter("_llm_times > 0").select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "copy"], F.explode(F.sequence(F.lit(1), F.col("_llm_times"))).alias("copy"))
    place = F.xxhash64(F.lit(seed), key, F.col("copy"))
    return copies.withColumn("_llm_place", place).repartition("_llm_place").sortWithinPartitions("_llm_place").drop("_llm_place")
