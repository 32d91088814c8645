"""Fitting retrieved chunks into a context. Inputs are runs cut to k rows per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.scores import r6


def top_sentences(rows: DataFrame, limit: int = 3) -> DataFrame:
    """The ``limit`` longest sentences of each chunk in their original order."""
    def pick(ss: Column) -> Column:
        sized = F.transform(ss, lambda s, i: F.struct((-F.size(X.words(s))).alias("w"), i.alias("i"), F.array_position(ss, s).alias("p"), s.alias("s")))
        chosen = F.transform(F.slice(F.array_sort(sized), 1, limit), lambda x: F.struct(x["p"].alias("p"), x["i"].alias("i"), x["s"].alias("s")))
        return F.array_join(F.transform(F.array_sort(chosen), lambda x: x["s"]), " ")

    ss = X.sentences(F.col("text"))
    packed = rows.withColumn("ss", ss).withColumn(
        "compressed", F.when(F.size("ss") <= limit, X.squeeze(F.col("text"))).otherwise(X.let(F.col("ss"), pick)))
    return packed.withColumn("tokens", X.tokens_by_matches(F.col("compressed"))).drop("ss")


def similarity_cut(run: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Rows whose vector is at least ``threshold`` close to the query's."""
    dot = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    joined = run.join(query_vectors.select("query_id", F.col("vector").alias("qv")), "query_id").join(
        chunk_vectors.select("chunk_id", F.col("vector").alias("cv")), "chunk_id")
    return joined.withColumn("similarity", r6(dot)).filter(F.col("similarity") >= threshold).drop("qv", "cv")


def pack_budget(rows: DataFrame, budget: int = 4096) -> DataFrame:
    """Chunks by score while they fit; one that does not fit is skipped, not the end.

    ``rows``: ``query_id, chunk_id, score, tokens``. Each choice depends on the ones before,
    so a query's rows, k at most, are folded in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "tokens")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("flags"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(0)).cast("long").alias("used"), F.array_append(acc["flags"], fits).alias("flags"))

    per_query = rows.groupBy("query_id").agg(ordered.alias("xs"))
    flagged = per_query.select("query_id", F.explode(X.let(F.col("xs"), lambda xs: F.arrays_zip(
        xs.alias("x"), F.aggregate(xs, start, step)["flags"].alias("kept")))).alias("z"))
    return flagged.select("query_id", F.col("z.x.chunk_id").alias("chunk_id"), F.col("z.x.tokens").alias("tokens"), F.col("z.kept").alias("kept"))


def order_context(rows: DataFrame) -> DataFrame:
    """Sources by their best score, inside a source by position in the text."""
    best = F.max("score").over(Window.partitionBy("query_id", "source"))
    place = Window.partitionBy("query_id").orderBy(F.desc("best"), F.asc("source"), F.asc("chunk_index"))
    return rows.withColumn("source", F.coalesce("source", F.lit("unknown"))).withColumn("best", best).withColumn("place", F.row_number().over(place))


def truncate_characters(text: Column, limit: int = 1000) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def truncate_tokens(text: Column, limit: int) -> Column:
    return F.when(X.tokens_by_matches(text) <= limit, text).otherwise(
        F.array_join(F.slice(X.words(text), 1, max(1, int(limit * 0.75))), " "))


def compression_report(packed: DataFrame) -> DataFrame:
    """Tokens before and after packing, their ratio and the number of chunks left out."""
    before, after = F.sum("tokens"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0))
    return packed.groupBy("query_id").agg(
        before.alias("tokens_before"), after.alias("tokens_after"),
        F.when(before > 0, r6(after / before)).otherwise(1.0).alias("ratio"), F.count_if(~F.col("kept")).alias("removed"))
