"""Operators over the table of queries: one row in, one or a few rows out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.lexicon import (
    CONNECTORS, EXPANSIONS, INTENT_KEYWORDS, INTENT_PATTERNS, PART_SUFFIX, QUERY_STOP, SEMANTIC_PATTERNS,
)
from folioframe.functions.scores import r6


def _count(flags: list[Column]) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + flag.cast("int")
    return total


def classify_queries(queries: DataFrame) -> DataFrame:
    """Intent by number of patterns met, then by priority, with confidence and needs."""
    t = X.squeeze(F.lower("text"))
    ranked = F.array_max(F.array(*[
        F.struct(_count([t.rlike(p) for p in patterns]).alias("hits"), F.lit(len(INTENT_PATTERNS) - i).alias("priority"), F.lit(name).alias("name"))
        for i, (name, patterns) in enumerate(INTENT_PATTERNS.items())
    ]))
    base = queries.select("query_id", (t == "").alias("blank"), ranked.alias("top"))
    intent = F.when(F.col("blank"), "general").when(F.col("top.hits") == 0, "factual").otherwise(F.col("top.name"))
    confidence = F.when(F.col("blank"), 0.0).when(F.col("top.hits") == 0, 0.55).otherwise(
        F.least(F.lit(0.95), r6(0.60 + 0.08 * F.col("top.hits"))))
    return base.select("query_id", intent.alias("intent"), confidence.alias("confidence"), F.col("top.hits").alias("signals")).withColumns({
        "needs_many_documents": F.col("intent").isin("comparative", "literature", "multi_hop"),
        "needs_broad_search": F.col("intent").isin("comparative", "literature"),
        "needs_many_steps": F.col("intent") == "multi_hop",
    })


def score_intents(queries: DataFrame) -> DataFrame:
    """Request kind by keyword counts and its share of all hits."""
    t = F.lower("text")
    scores = F.array(*[
        F.struct(_count([F.contains(t, F.lit(w)) for w in words]).alias("hits"), F.lit(-i).alias("place"), F.lit(name).alias("name"))
        for i, (name, words) in enumerate(INTENT_KEYWORDS.items())
    ])
    base = queries.select("query_id", scores.alias("s"))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x["hits"])
    top = base.select("query_id", F.array_max("s").alias("top"), total.alias("total"))
    return top.select(
        "query_id", F.when(F.col("total") == 0, "factual").otherwise(F.col("top.name")).alias("intent"), F.col("top.hits").alias("hits"),
        F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("top.hits") / F.col("total"), 2)).alias("confidence"))


TERM = r"[\p{L}\p{N}]+(?:[./-][\p{L}\p{N}]+)*"


def _first_spellings(values: Column) -> Column:
    """Distinct without regard to case, first spelling kept, blank ones dropped."""
    def keep(vs: Column) -> Column:
        return X.let(F.transform(vs, lambda v: F.lower(v)), lambda low: F.filter(vs, lambda v, i: F.array_position(low, F.lower(v)) == i + 1))

    return X.let(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""), keep)


def query_terms(queries: DataFrame) -> DataFrame:
    """Terms without stop words, distinct keywords, quoted phrases."""
    terms = F.filter(X.matches(F.col("text"), TERM), lambda t: ~F.lower(t).isin(*QUERY_STOP) & (F.length(t) > 1))
    phrases = F.filter(F.transform(X.matches(F.col("text"), r'"([^"]+)"', 1), lambda p: F.trim(p)), lambda p: p != "")
    return queries.withColumn("terms", terms).withColumn("keywords", _first_spellings(F.col("terms"))).withColumn("phrases", phrases)


def route_queries(queries: DataFrame) -> DataFrame:
    """Dense, bm25 or hybrid by the wording of the query."""
    t = X.squeeze(F.col("text"))
    low = F.lower(t)
    base = queries.select("query_id", t.alias("t"), X.matches(low, X.HYPHEN_WORD).alias("ws"),
                          _count([low.rlike(p) for p in SEMANTIC_PATTERNS]).alias("hits"))
    semantic = F.when(F.col("hits") == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.45 + 0.12 * F.col("hits")))
    named = F.size(F.filter("ws", lambda w: w.rlike(r"[\p{N}_-]")))
    n = F.size("ws")
    keyword = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), (
        F.least(F.lit(0.45), named * 0.15) + F.when(F.col("t").rlike("[\"']"), 0.25).otherwise(0.0)
        + F.when(n <= 3, 0.30).when(n <= 5, 0.15).otherwise(0.0))))
    scored = base.select("query_id", (F.col("t") == "").alias("blank"), n.alias("n"), r6(semantic).alias("semantic"), r6(keyword).alias("keyword"))
    dense = F.col("semantic") >= 0.60
    sparse = (F.col("n") <= 4) & (F.col("keyword") >= 0.75)
    return scored.select(
        "query_id", "semantic", "keyword",
        F.when(F.col("blank"), "hybrid").when(dense, "dense").when(sparse, "bm25").otherwise("hybrid").alias("mode"),
        F.when(F.col("blank"), 1.0).when(dense, F.col("semantic")).when(sparse, F.col("keyword"))
        .otherwise(F.greatest("semantic", "keyword", F.lit(0.5))).alias("confidence"))


def expand_queries(queries: DataFrame) -> DataFrame:
    """The different search texts of each query: as given, keywords, expansions, phrases first."""
    table = F.create_map(*[x for k, vs in EXPANSIONS.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
    named = query_terms(queries)
    extra = F.flatten(F.filter(F.transform("keywords", lambda k: F.try_element_at(table, F.lower(k))), lambda v: v.isNotNull()))
    base = named.withColumn("extra", _first_spellings(extra))
    texts = F.array(
        X.squeeze(F.col("text")), F.array_join("keywords", " "),
        F.array_join(_first_spellings(F.concat("keywords", "extra")), " "), F.array_join(_first_spellings(F.concat("phrases", "keywords")), " "))
    return base.select("query_id", F.posexplode(_first_spellings(texts)).alias("variant", "search_text"))


def multi_queries(queries: DataFrame) -> DataFrame:
    """Each query with an explanation and an evidence variant."""
    variants = F.array("text", F.concat("text", F.lit(" explanation")), F.concat("text", F.lit(" evidence")))
    return queries.select("query_id", F.posexplode(variants).alias("variant", "search_text"))


def decompose_queries(queries: DataFrame) -> DataFrame:
    """Parts of a compound question, each with background words, and a comparing one."""
    t = F.trim("text")
    low = F.lower(t)
    parts = F.array(t)
    for connector in reversed(CONNECTORS):
        cut = F.filter(F.transform(F.split(low, connector), lambda p: F.trim(p)), lambda p: p != "")
        parts = F.when(F.contains(low, F.lit(connector)), cut).otherwise(parts)
    split = F.lit(False)
    for connector in CONNECTORS:
        split = split | F.contains(low, F.lit(connector))
    compared = split & (F.contains(low, F.lit("compare")) | F.contains(low, F.lit("difference")) | F.contains(low, F.lit(" vs ")))
    subs = F.concat(
        F.transform(parts, lambda p: F.concat(p, F.lit(" " + PART_SUFFIX))),
        F.when(compared, F.array(F.concat(F.lit("Compare: "), t))).otherwise(F.array().cast("array<string>")))
    return queries.select("query_id", F.posexplode(subs).alias("part", "sub_query"))
