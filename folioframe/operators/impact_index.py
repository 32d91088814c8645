"""A stored BM25 index whose searches leave out what cannot reach the k-th score.

The folder of an index holds

- ``terms``: ``term, df, raw_idf, idf, head``; a head term is in more than HEAD of all chunks;
- ``impacts``: ``block, term, chunk_id, impact``, the share of a term in a chunk's score but for
  its idf. Rows of other terms stand for themselves; of a head term there is one row for each
  block, without chunk, that holds the greatest impact in the block;
- ``heads``: ``block, chunk_id, entries``: the head terms of each chunk with their impacts.

A block is about BLOCK chunks of nearly one length. ``impacts`` and ``heads`` are bucketed by
block, so that scores are added up without a shuffle. A search adds up the rare terms exactly and
the common ones by their greatest impact in the block; with the k-th score of some chunks that
look best it then knows which chunks can be among the k best, and only those are scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.scores import r6, top_k
from folioframe.operators import index as I
from folioframe.operators import search as S
from folioframe.session import checkpoint_dir

HEAD, BLOCK = 0.2, 64
#: Steps of chunk length per doubling that share blocks.
STEPS = 16
#: Query terms sent to all tasks at once, and chunks scored first, as a multiple of k.
TERMS_AT_ONCE, SEEDS = 200_000, 3
#: Scores are rounded to six places, so a bound this far below may still tie.
SLACK = 2e-6


@dataclass
class ImpactIndex:
    """An index opened in a session: its tables and how many chunks it has."""

    spark: SparkSession
    path: str
    terms: DataFrame
    impacts: DataFrame
    heads: DataFrame


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucketed(spark: SparkSession, path: str, schema: str, buckets: int, order: str) -> str:
    """A table over ``path`` bucketed by block; nothing is written or read."""
    name = f"impacts_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (block) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def _open(spark: SparkSession, path: str, chunk_type: str, buckets: int) -> tuple[str, str]:
    impacts = _bucketed(spark, f"{path}/impacts", f"block BIGINT, term STRING, chunk_id {chunk_type}, impact DOUBLE", buckets, "term")
    heads = _bucketed(
        spark, f"{path}/heads", f"block BIGINT, chunk_id {chunk_type}, entries ARRAY<STRUCT<term: STRING, impact: DOUBLE>>", buckets, "block")
    return impacts, heads


def _write(df: DataFrame, name: str, buckets: int) -> None:
    """Insert into a bucketed table with one file to a bucket."""
    df.repartition(buckets, "block").select(*df.sparkSession.table(name).columns).write.insertInto(name)


def build_impacts(chunks: DataFrame, path: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, buckets: int | None = None) -> ImpactIndex:
    """Write the index of ``chunks(chunk_id, text)`` to ``path`` and open it.

    Texts are split once. The head terms that are sent to all tasks are at most the mean number
    of different words of a chunk over HEAD.
    """
    spark = chunks.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk_type = chunks.schema["chunk_id"].dataType.simpleString()
    words = chunks.select("chunk_id", X.tokens(F.col("text")).alias("words")).select(
        "chunk_id", F.size("words").alias("dl"), F.explode_outer("words").alias("term"))
    counted = _stored(
        words.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")), f"{path}/counts")
    lengths = counted.groupBy("chunk_id").agg(F.first("dl").alias("dl"))
    step = F.floor(F.log2(F.greatest(F.col("dl"), F.lit(1)).cast("double")) * STEPS)
    sizes = _stored(lengths.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count("dl").alias("told"), F.sum("dl").alias("length"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), f"{path}/lengths")
    # Texts that are null count as chunks but have no length.
    size = sizes.agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("told")).alias("mean"))
    n, mean = size.select("n").scalar(), size.select("mean").scalar()
    df = counted.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).withColumn("head", F.col("df") > HEAD * n)
    raw = _stored(raw, f"{path}/counted_terms")
    floor = epsilon * raw.agg(F.avg("raw_idf")).scalar()
    terms = _stored(raw.withColumn("idf", F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf"))), f"{path}/terms")

    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    placed = (
        counted.filter("term IS NOT NULL").withColumn("step", step).join(F.broadcast(sizes.select("step", "parts")), "step")
        .withColumn("block", F.shiftleft("step", 40) + F.pmod(F.xxhash64("chunk_id"), "parts"))
        .join(F.broadcast(terms.filter("head").select("term", "head")), "term", "left")
        .select("block", "term", "chunk_id", impact.alias("impact"), F.coalesce("head", F.lit(False)).alias("head"))
    )
    impacts, heads = _open(spark, path, chunk_type, buckets)
    greatest = placed.filter("head").groupBy("block", "term").agg(F.max("impact").alias("impact")).withColumn("chunk_id", F.lit(None).cast(chunk_type))
    _write(placed.filter("NOT head").drop("head").unionByName(greatest), impacts, buckets)
    _write(placed.filter("head").groupBy("block", "chunk_id").agg(F.collect_list(F.struct("term", "impact")).alias("entries")), heads, buckets)
    spark.createDataFrame([(buckets, chunk_type)], "buckets int, chunk_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return ImpactIndex(spark, path, terms, spark.table(impacts), spark.table(heads))


def open_impacts(spark: SparkSession, path: str) -> ImpactIndex:
    """The index that ``build_impacts`` wrote to ``path``."""
    buckets, chunk_type = spark.read.parquet(f"{path}/layout").first()
    impacts, heads = _open(spark, path, chunk_type, buckets)
    return ImpactIndex(spark, path, spark.read.parquet(f"{path}/terms"), spark.table(impacts), spark.table(heads))


def _keys(query: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(query), F.lit(groups))


@dataclass
class Pruned:
    """What a search came to: the run, and the (query, chunk) pairs that were scored in full."""

    run: DataFrame
    scored: DataFrame


#: Keeps those of some rows (query_id, chunk_id, ...) that a query may return.
Allow = Callable[[DataFrame], DataFrame]


def search_impacts(queries: DataFrame, index: ImpactIndex, k: int = 10, allow: Allow | None = None) -> Pruned:
    """Exact BM25 top-k of ``queries(query_id, text)`` over a stored index.

    ``allow`` restricts the candidates before the cut. Query terms are counted first and sent to all tasks in groups of at most TERMS_AT_ONCE.
    """
    spark = index.spark
    folder = f"{checkpoint_dir(spark).rstrip('/')}/impacts-{uuid.uuid4().hex}"
    asked = _stored(
        S.query_terms(queries).join(index.terms.select("term", "idf", "head"), "term")
        .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "head"), f"{folder}/asked")
    groups = max(1, -(-asked.count() // TERMS_AT_ONCE))
    parts = [_search_group(asked.filter(_keys(F.col("query_id"), groups) == g), index, k, allow, f"{folder}/{g}") for g in range(groups)]
    run, scored = parts[0]
    for other_run, other_scored in parts[1:]:
        run, scored = run.unionByName(other_run), scored.unionByName(other_scored)
    return Pruned(run, scored)


def bounds(asked: DataFrame, index: ImpactIndex) -> DataFrame:
    """``query_id, block, chunk_id, value, most, bound`` of every chunk that has a rare term of a
    query, and, without chunk, of every block that has a common one.

    ``value`` adds up the rare terms, ``most`` is the most that the block's common terms can
    give, negative weights giving nothing. The buckets hold whole blocks, so nothing is shuffled.
    """
    blank = F.col("chunk_id").isNull()
    weighed = F.when(blank, F.greatest(F.col("w"), F.lit(0.0))).otherwise(F.col("w")) * F.col("impact")
    sums = index.impacts.join(F.broadcast(asked.select("query_id", "term", "w")), "term").groupBy("query_id", "block", "chunk_id").agg(
        F.sum(weighed).alias("value"))
    most = F.coalesce(F.max(F.when(blank, F.col("value"))).over(Window.partitionBy("query_id", "block")), F.lit(0.0))
    return sums.withColumn("most", most).withColumn("bound", F.when(blank, F.col("value")).otherwise(F.col("value") + F.col("most")))


def _search_group(asked: DataFrame, index: ImpactIndex, k: int, allow: Allow | None, folder: str) -> tuple[DataFrame, DataFrame]:
    heads_asked = F.broadcast(asked.filter("head").select("query_id", "term", "w"))
    bounded = bounds(asked, index)
    if allow is not None:
        bounded = allow(bounded.filter("chunk_id IS NOT NULL")).unionByName(bounded.filter("chunk_id IS NULL"))

    def opened(blocks: DataFrame) -> DataFrame:
        """Chunks of whole blocks."""
        own = index.heads.select("block", "chunk_id").join(blocks.select("query_id", "block"), "block").select("query_id", "block", "chunk_id")
        return own if allow is None else allow(own)

    def in_full(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """Scores of ``pairs(query_id, block, chunk_id)``, whose rare terms are in ``rows``."""
        common = (
            pairs.join(index.heads, ["block", "chunk_id"]).select("query_id", "chunk_id", F.inline("entries"))
            .join(heads_asked, ["query_id", "term"]).select("query_id", "chunk_id", (F.col("w") * F.col("impact")).alias("value"))
        )
        return rows.select("query_id", "chunk_id", "value").unionByName(common).groupBy("query_id", "chunk_id").agg(r6(F.sum("value")).alias("score"))

    # Chunks that look best, by bound, and those of the best blocks, give a k-th score to beat.
    first = _stored(top_k(bounded.filter("chunk_id IS NOT NULL"), "query_id", SEEDS * k, F.desc("bound"), F.asc("chunk_id")), f"{folder}/first")
    blocks = _stored(top_k(bounded.filter("chunk_id IS NULL"), "query_id", 1 + -(-k // BLOCK), F.desc("bound"), F.asc("block")), f"{folder}/blocks")
    tried = first.select("query_id", "block", "chunk_id").unionByName(opened(blocks)).distinct()
    seeds = top_k(in_full(first, tried), "query_id", k, F.desc("score"), F.asc("chunk_id"))
    # A chunk of an opened block may lack its rare terms here: its score is too low then, if
    # no weight is negative; only what is known in full may raise the bar.
    known = seeds.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi") if _negative(asked) else seeds
    bar = _stored(known.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).filter(F.col("n") >= k), f"{folder}/bar")
    reaches = bounded.join(F.broadcast(bar.select("query_id", "bar")), "query_id", "left").filter(
        F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - SLACK) | (F.col("most") >= F.col("bar") - SLACK))
    left = _stored(reaches.select("query_id", "block", "chunk_id", "value"), f"{folder}/left")
    rows = left.filter("chunk_id IS NOT NULL")
    pairs = rows.select("query_id", "block", "chunk_id").unionByName(opened(left.filter("chunk_id IS NULL"))).distinct()
    scored = in_full(rows, pairs)
    run = top_k(scored, "query_id", k, F.desc("score"), F.asc("chunk_id")).select("query_id", "chunk_id", "score", "rank")
    return run, pairs.select("query_id", "chunk_id")


def _negative(asked: DataFrame) -> bool:
    return not asked.filter("w < 0").isEmpty()
