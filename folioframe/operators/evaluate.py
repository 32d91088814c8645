"""Retrieval and answer quality.

``runs``: ``run, query_id, chunk_id, rank``; ``qrels``: ``query_id, chunk_id``; ``qa``:
``query_id, question, answer``; ``evidence``: the k best rows per query with text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.lexicon import ANSWER_STOP, CLAIM_STOP, GAP_STOP
from folioframe.functions.scores import clamp01, r6, ratio
from folioframe.operators.resolve import pairwise_jaccard, prefix_diversity
from folioframe.operators.search import run_confidence


# -- ranking metrics ----------------------------------------------------------------------


def judged(runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of every run, one row per distinct id at its best rank, marked relevant or not.

    The shuffle on (query, chunk) serves both the distinct step and the join.
    """
    best = runs.filter(F.col("rank") <= k).groupBy("query_id", "chunk_id", "run").agg(F.min("rank").alias("rank"))
    return best.join(qrels.distinct().withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left").fillna(0, ["hit"])


def query_metrics(runs: DataFrame, queries: DataFrame, qrels: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG of every query in each of the runs ``names``.

    A query a run returned nothing for counts with zeros.
    """
    rel = qrels.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    got = judged(runs, qrels, k).groupBy("run", "query_id").agg(
        F.count(F.lit(1)).alias("retrieved"), F.sum("hit").alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.col("hit") * gain).alias("dcg"))
    wanted = queries.select("query_id").distinct().withColumn("run", F.explode(F.array(*[F.lit(n) for n in names])))
    full = wanted.join(got, ["run", "query_id"], "left").join(rel, "query_id", "left").fillna(0, ["retrieved", "hits", "relevant"]).fillna(0.0, ["dcg"])
    best = F.least(F.col("relevant"), F.lit(k))
    ideal = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= best), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return full.select(
        "run", "query_id", r6(ratio(F.col("hits"), F.col("retrieved"))).alias("precision"), r6(ratio(F.col("hits"), F.col("relevant"))).alias("recall"),
        r6(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), r6(F.when(F.col("relevant") == 0, 0.0).otherwise(F.col("dcg") / ideal)).alias("ndcg"))


def evaluate_run(metrics: DataFrame, by: str | None = None) -> DataFrame:
    """Means per run; with ``by``, also per subgroup, in one pass."""
    means = [r6(F.avg(m)).alias(m) for m in ("precision", "recall", "mrr", "ndcg")]
    if by is None:
        return metrics.groupBy("run").agg(F.count(F.lit(1)).alias("queries"), *means)
    return metrics.rollup("run", by).agg(F.count(F.lit(1)).alias("queries"), *means)


# -- answers against contexts -------------------------------------------------------------


def _supported(qa: DataFrame, evidence: DataFrame, words: Column) -> DataFrame:
    """``qa`` with ``found``: those of its words that any context holds as a part of its text."""
    wanted = qa.select("query_id", F.array_distinct(words).alias("ws"))
    own = evidence.join(wanted, "query_id").select(
        "query_id", X.let(F.lower("text"), lambda body: F.filter("ws", lambda w: F.contains(body, w))).alias("own"))
    found = own.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("found"))
    return qa.join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def _share(words: Column, known: Column, empty: float = 0.0) -> Column:
    return X.let(F.struct(words.alias("w"), known.alias("k")), lambda s: ratio(
        F.size(F.filter(s["w"], lambda w: F.array_contains(s["k"], w))), F.size(s["w"]), empty))


def faithfulness_words(qa: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of answer words that occur in the contexts."""
    words = X.tokens(F.col("answer"))
    return _supported(qa, evidence, words).select("query_id", r6(_share(words, F.col("found"))).alias("faithfulness"))


def faithfulness_claims(qa: DataFrame, evidence: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Share of sentences of which at least 30 % of the words occur in the contexts."""
    parts = F.array_remove(F.transform(F.split("answer", r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), "")
    known = _supported(qa, evidence, X.tokens(F.regexp_replace("answer", r"\.", " ")))
    good = X.let(F.struct(parts.alias("p"), F.col("found").alias("k")), lambda s: F.size(F.filter(
        s["p"], lambda p: _share(X.tokens(p), s["k"]) >= threshold)))
    return known.select("query_id", F.size(parts).alias("claims"), good.alias("supported"), F.round(good / F.greatest(F.size(parts), F.lit(1)), 3).alias("faithfulness"))


def answer_relevance(qa: DataFrame) -> DataFrame:
    """Share of the question's distinct words found among the answer's, with its grade."""
    q, a = F.array_distinct(X.tokens(F.col("question"))), F.array_distinct(X.tokens(F.col("answer")))
    share = ratio(F.size(F.array_intersect(q, a)), F.size(q))
    base = qa.select("query_id", share.alias("s"))
    return base.select("query_id", r6(F.col("s")).alias("relevance"), F.round("s", 3).alias("relevance_rounded"),
                       F.when(F.col("s") >= 0.7, "most").when(F.col("s") >= 0.3, "partial").otherwise("low").alias("grade"))


def contextual_precision(qa: DataFrame, evidence: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Mean share of question words per context, and how many contexts reach the threshold."""
    q = qa.select("query_id", F.array_distinct(X.tokens(F.col("question"))).alias("q"))
    own = evidence.join(q, "query_id").select(
        "query_id", (F.size(F.array_intersect("q", X.tokens(F.col("text")))) / F.greatest(F.size("q"), F.lit(1))).alias("s"))
    return own.groupBy("query_id").agg(
        F.round(F.least(F.lit(1.0), F.avg("s")), 3).alias("precision"), F.count_if(F.col("s") >= threshold).alias("relevant"), F.count_if(F.col("s") < threshold).alias("irrelevant"))


def contextual_recall(qa: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of the expected answer's words of three letters or more found in the contexts."""
    words = F.filter(F.transform(X.tokens(F.col("answer")), lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", "")), lambda w: F.length(w) >= 3)
    known = _supported(qa, evidence, words)
    return known.select("query_id", F.size(words).alias("total"), F.round(_share(words, F.col("found")), 3).alias("recall"))


# -- answer checks ------------------------------------------------------------------------


def split_claims(answer: Column) -> Column:
    return X.sentences(answer, r"(?<=[.!?])[ \n\t\r]+|\n+|;[ \n\t\r]+")


def hallucination(qa: DataFrame, evidence: DataFrame, min_overlap: float = 0.12, high_risk: float = 0.8, min_words: int = 5) -> DataFrame:
    """Claims of an answer without lexical support, the highest risk among them, supported share.

    Each evidence row scores all claims of its query at once; only the best scores are kept.
    """
    claims = qa.select("query_id", F.filter(split_claims(F.col("answer")), lambda c: F.size(X.words(c)) >= min_words).alias("cs"))
    sets = claims.select("query_id", F.transform("cs", lambda c: X.term_set(c, CLAIM_STOP)).alias("ts"))
    usable = evidence.filter(F.length(X.squeeze(F.col("text"))) > 0).select("query_id", X.term_set(F.col("text"), CLAIM_STOP).alias("et"))
    scored = usable.join(sets, "query_id").select(
        "query_id", F.posexplode_outer(X.let(F.struct("et", "ts"), lambda s: F.transform(
            s["ts"], lambda t: ratio(F.size(F.array_intersect(t, s["et"])), F.size(t))))).alias("claim", "overlap")).filter("claim IS NOT NULL")
    best = scored.groupBy("query_id", "claim").agg(F.max("overlap").alias("overlap"))
    risk = F.when(F.col("overlap") < min_overlap, 1.0 - F.col("overlap"))
    per = best.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count(risk).alias("unsupported"), F.max(risk).alias("worst"))
    grounded = evidence.filter(F.length(X.squeeze(F.col("text"))) > 0).select("query_id").distinct().withColumn("grounded", F.lit(True))
    blank = X.squeeze(F.col("answer")) == ""
    joined = qa.select("query_id", blank.alias("blank")).join(grounded, "query_id", "left").join(per, "query_id", "left").fillna(0, ["claims", "unsupported"])
    nothing = F.col("blank") | F.col("grounded").isNull()
    score = F.when(nothing, 1.0).otherwise(F.coalesce("worst", F.lit(0.0)))
    return joined.select(
        "query_id", "claims", "unsupported", r6(score).alias("hallucination"),
        F.when(nothing, 0.0).otherwise(r6((F.col("claims") - F.col("unsupported")) / F.greatest(F.col("claims"), F.lit(1)))).alias("supported_ratio"),
        (nothing | F.coalesce(F.col("worst") >= high_risk, F.lit(False))).alias("has_hallucinations"))


def answer_check(qa: DataFrame, evidence: DataFrame, min_relevance: float = 0.45, min_completeness: float = 0.45) -> DataFrame:
    """Question terms answered, answer terms grounded in evidence, and whether both suffice."""
    base = qa.select("query_id", X.term_set(F.col("question"), ANSWER_STOP).alias("q"), X.term_set(F.col("answer"), ANSWER_STOP).alias("a"),
                     (X.squeeze(F.col("question")) == "").alias("no_q"), (X.squeeze(F.col("answer")) == "").alias("no_a"))
    own = evidence.join(base.select("query_id", "a"), "query_id").select(
        "query_id", X.let(X.term_set(F.col("text"), ANSWER_STOP), lambda e: F.struct(F.array_intersect("a", e).alias("hit"), (F.size(e) > 0).alias("any"))).alias("o"))
    grounded = own.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("o.hit"))).alias("hit"), F.max("o.any").alias("any"))
    j = base.join(grounded, "query_id", "left")
    relevance = F.when(F.col("no_q") | F.col("no_a"), 0.0).otherwise(ratio(F.size(F.array_intersect("q", "a")), F.size("q"), 1.0))
    complete = F.when(F.col("no_q") | F.col("no_a") | ~F.coalesce("any", F.lit(False)), 0.0).otherwise(ratio(F.size(F.coalesce("hit", F.array().cast("array<string>"))), F.size("a")))
    scored = j.select("query_id", relevance.alias("r"), complete.alias("c"), F.array_sort(F.array_except("q", "a")).alias("missing"))
    return scored.select(
        "query_id", r6(F.col("r")).alias("relevance"), r6(F.col("c")).alias("completeness"), (F.col("c") >= min_completeness).alias("grounded"),
        "missing", ((F.col("r") >= min_relevance) & (F.col("c") >= min_completeness)).alias("acceptable"))


def retrieval_check(queries: DataFrame, evidence: DataFrame, min_items: int = 1, min_relevance: float = 0.45, min_diversity: float = 0.20) -> DataFrame:
    """Mean score, usable rows and diversity per query; a missing score counts as 1."""
    s = F.when(F.col("relevance").isNull(), 1.0).otherwise(clamp01(F.col("relevance")))
    per = evidence.groupBy("query_id").agg(F.avg(s).alias("m"), F.count(F.lit(1)).alias("items"), F.count_if(s >= min_relevance).alias("usable"))
    j = queries.select("query_id").join(per, "query_id", "left").join(prefix_diversity(evidence).select("query_id", "diversity"), "query_id", "left").fillna(
        0, ["items", "usable"]).fillna(0.0, ["m", "diversity"])
    reasons = F.concat_ws("|", F.when(F.col("items") < min_items, "too few"), F.when(F.col("m") < min_relevance, "low relevance"), F.when(F.col("diversity") < min_diversity, "low diversity"))
    return j.select("query_id", "items", "usable", r6(F.col("m")).alias("relevance"), "diversity", reasons.alias("reasons"),
                    ((F.col("items") >= min_items) & (F.col("m") >= min_relevance) & (F.col("diversity") >= min_diversity) & (F.col("usable") > 0)).alias("sufficient"))


def coverage_gaps(queries: DataFrame, evidence: DataFrame, min_items: int = 1, min_coverage: float = 0.55, min_relevance: float = 0.30) -> DataFrame:
    """Query terms no usable evidence holds, as part of its text, and how severe that is."""
    terms = queries.select("query_id", X.term_set(F.col("text"), GAP_STOP).alias("ts"))
    usable = evidence.filter((clamp01(F.col("relevance")) >= min_relevance) & (F.length(X.squeeze(F.col("text"))) > 0))
    own = usable.join(terms, "query_id").select(
        "query_id", X.let(X.squeeze(F.lower("text")), lambda body: F.filter("ts", lambda t: F.contains(body, t))).alias("own"))
    hits = own.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("hit"), F.count(F.lit(1)).alias("usable"))
    sizes = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"))
    j = terms.join(sizes, "query_id", "left").join(hits, "query_id", "left").fillna(0, ["items", "usable"]).withColumn("hit", F.coalesce("hit", F.array().cast("array<string>")))
    bare = (F.col("items") < min_items) | (F.col("usable") == 0)
    cov = F.when(bare, 0.0).when(F.size("ts") == 0, F.least(F.lit(1.0), F.col("usable") / 3.0)).otherwise(F.size("hit") / F.size("ts"))
    scored = j.select("query_id", bare.alias("bare"), cov.alias("cov"), F.array_except("ts", "hit").alias("missing"))
    severity = F.when(F.col("bare"), "high").when(F.col("cov") >= min_coverage, None).when(F.col("cov") < 0.20, "critical").when(F.col("cov") < 0.35, "high").otherwise("medium")
    return scored.select("query_id", r6(F.col("cov")).alias("coverage"), F.array_sort("missing").alias("missing"), severity.alias("severity"), severity.isNotNull().alias("has_gaps"))


def critic_score(queries: DataFrame, qa: DataFrame, evidence: DataFrame, threshold: float = 0.72) -> DataFrame:
    """One verdict per answer: weighted quality, severity, next action."""
    j = (
        queries.select("query_id")
        .join(hallucination(qa, evidence).select("query_id", "hallucination", "has_hallucinations"), "query_id")
        .join(retrieval_check(queries, evidence).select("query_id", F.col("relevance").alias("r_rel"), "diversity", "sufficient"), "query_id")
        .join(answer_check(qa, evidence).select("query_id", F.col("relevance").alias("a_rel"), "completeness", "acceptable"), "query_id")
        .join(coverage_gaps(queries, evidence).select("query_id", "coverage", F.col("severity").alias("gap"), "has_gaps"), "query_id")
    )
    score = 0.40 * (1.0 - F.col("hallucination")) + 0.20 * (0.6 * F.col("r_rel") + 0.4 * F.col("diversity")) + 0.25 * (
        0.55 * F.col("a_rel") + 0.45 * F.col("completeness")) + 0.15 * F.col("coverage")
    critical = F.coalesce(F.col("gap") == "critical", F.lit(False))
    scored = j.withColumn("score", r6(clamp01(score))).withColumn("critical", critical)
    accepted = (F.col("score") >= threshold) & ~F.col("has_hallucinations") & F.col("acceptable") & ~F.col("critical")
    severity = F.when(accepted, "pass").when(F.col("critical"), "critical").when(F.col("has_hallucinations"), "high").when(
        F.col("score") < 0.45, "high").when(F.col("score") < 0.60, "medium").otherwise("low")
    again = ~F.col("sufficient") | F.col("has_gaps")
    redo = F.col("has_hallucinations") | ~F.col("acceptable")
    action = F.when(accepted, "accept").when(again, "retrieve").when(redo, "regenerate").otherwise("stop")
    return scored.select("query_id", "score", accepted.alias("accepted"), severity.alias("severity"), again.alias("needs_retrieval"), redo.alias("needs_regeneration"), action.alias("action"))


# -- retrieval quality --------------------------------------------------------------------


def lexical_relevance(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of the query's words in each result."""
    q = queries.select("query_id", X.word_set(F.col("text")).alias("q"))
    j = evidence.join(q, "query_id").select("query_id", "chunk_id", F.size("q").alias("query_terms"), F.size(F.array_intersect("q", X.word_set(F.col("text")))).alias("matched_terms"))
    return j.withColumn("lexical_relevance", r6(ratio(F.col("matched_terms"), F.col("query_terms"))))


def retrieval_quality(queries: DataFrame, evidence: DataFrame, quality: float = 0.65, coverage: float = 0.55, confidence: float = 0.60,
                      rerank: float = 0.60, replan: float = 0.35) -> DataFrame:
    """Relevance, confidence, coverage and diversity in one quality, and what to do next."""
    from folioframe.operators.evidence import coverage_tokens

    rel = lexical_relevance(queries, evidence).groupBy("query_id").agg(F.avg("lexical_relevance").alias("relevance"))
    conf = run_confidence(evidence.select("query_id", F.col("relevance").alias("score"))).select("query_id", "confidence")
    cov = coverage_tokens(queries, evidence).select("query_id", "coverage")
    div = pairwise_jaccard(evidence).select("query_id", "diversity")
    counts = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    j = queries.select("query_id")
    for part in (rel, conf, cov, div, counts):
        j = j.join(part, "query_id", "left")
    j = j.fillna(0.0, ["relevance", "confidence", "coverage", "diversity"]).fillna(0, ["results"])
    scored = j.withColumn("quality", r6(clamp01(0.40 * F.col("relevance") + 0.25 * F.col("confidence") + 0.25 * F.col("coverage") + 0.10 * F.col("diversity"))))
    ok = (F.col("results") > 0) & (F.col("quality") >= quality) & (F.col("coverage") >= coverage) & (F.col("confidence") >= confidence)
    reason = F.when(F.col("results") == 0, "no_retrieved_evidence").when(ok, "evidence_sufficient").when(F.col("coverage") < coverage, "insufficient_query_coverage").when(
        F.col("confidence") < confidence, "low_retrieval_confidence").otherwise("low_evidence_quality")
    return scored.select(
        "query_id", "results", r6(F.col("relevance")).alias("relevance"), "confidence", "coverage", "diversity", "quality", ok.alias("sufficient"), reason.alias("reason"),
        r6(F.when(F.col("results") == 0, 0.0).otherwise(0.45 * F.col("quality") + 0.35 * F.col("coverage") + 0.20 * F.col("confidence"))).alias("sufficiency"),
        ((F.col("results") > 0) & ~ok & (F.col("quality") >= rerank)).alias("rerank"), (~ok).alias("retrieve_again"),
        ((F.col("quality") < replan) | (F.col("coverage") < coverage * 0.5) | (F.col("results") == 0)).alias("replan"))


def score_spread(run: DataFrame, minimum: float = 0.3, strong: float = 0.7, min_chunks: int = 2, score: str = "relevance") -> DataFrame:
    """Best, mean and spread of a query's scores and the decision they lead to."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score)))
    a = run.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(s).alias("best"), F.avg(s).alias("mean"), (F.max(s) - F.min(s)).alias("spread"))
    enough = F.when(F.col("best") < minimum, False).when(F.col("n") < min_chunks, F.col("best") >= strong).otherwise(F.col("mean") >= minimum)
    rerank = (F.col("n") >= 3) & (F.col("best") < strong) & (F.col("mean") >= minimum) & (F.col("best") > F.col("mean"))
    return a.select(
        "query_id", "n", r6(F.col("best")).alias("best"), r6(F.col("mean")).alias("mean"), r6(F.col("spread")).alias("spread"),
        r6(F.least(F.lit(1.0), 0.6 * F.col("best") + 0.4 * F.col("mean") + F.least(F.lit(0.1), F.col("n") / 100.0))).alias("confidence"),
        enough.alias("sufficient"), rerank.alias("needs_rerank"), (~enough & ~rerank).alias("needs_replan"))


# fixed values: weights of the final confidence
POLICY = {"retrieval": 0.20, "relevance": 0.25, "coverage": 0.20, "consistency": 0.15, "groundedness": 0.20}


def confidence_policy(signals: DataFrame, threshold: float = 0.80) -> DataFrame:
    total = F.lit(0.0)
    for name, weight in POLICY.items():
        total = total + weight * clamp01(F.col(name))
    return signals.withColumn("confidence", F.round(total, 4)).withColumn("confident", F.col("confidence") >= threshold)


def latency_summary(rows: DataFrame, stage: str = "stage", value: str = "duration_ms") -> DataFrame:
    """Count, mean, extremes and quantiles per stage. Quantiles are exact at these percentages
    up to the accuracy of Spark's sketch, whose size is fixed."""
    return rows.groupBy(stage).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(value)).alias("mean_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"),
        F.percentile_approx(value, [0.5, 0.95], 100000).alias("q"))


def latency_by_stage(rows: DataFrame, key: str, stages: list[str], stage: str = "stage", value: str = "duration_ms") -> DataFrame:
    """One column per stage with its total, and the total over all."""
    wide = rows.groupBy(key).pivot(stage, stages).agg(F.round(F.sum(value), 4))
    total = F.lit(0.0)
    for name in stages:
        total = total + F.coalesce(name, F.lit(0.0))
    return wide.withColumn("total", F.round(total, 4))
