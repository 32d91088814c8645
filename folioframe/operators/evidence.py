"""Evidence: claims, scores, coverage, agreement, references.

Evidence tables hold the k best rows of each query: ``query_id, chunk_id, rank, score,
relevance, text, source``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.lexicon import (
    ASSERTION, COVERAGE_STOP, CRITERIA, NEGATION, NEGATIVE_PHRASES, NOT_CLAIMS, POSITIVE_PHRASES, QUERY_STOP,
)
from folioframe.functions.scores import clamp01, r6, top_k
from folioframe.operators.resolve import fold_sets, jaccard_pairs
from folioframe.session import cut_lineage


# -- claims -------------------------------------------------------------------------------


def claim_sentences(text: Column, min_length: int = 30) -> Column:
    """Sentences that can stand as claims: long enough, no captions, links or questions.

    Closing punctuation goes first, as in the source of the rules, so a question mark at the
    end does not rule a sentence out.
    """
    cleaned = F.transform(X.sentences(text), lambda s: F.regexp_replace(X.squeeze(s), r"[.!?;:]+$", ""))

    def plausible(s: Column) -> Column:
        low = F.lower(s)
        ok = (F.length(s) >= min_length) & ~low.rlike(r"\?$")
        for start in NOT_CLAIMS:
            ok = ok & ~F.startswith(low, F.lit(start))
        return ok

    return F.filter(cleaned, plausible)


def extract_claims(evidence: DataFrame) -> DataFrame:
    """All different claims of each query, in the order of its documents.

    A claim belongs to the first document that makes it; spelling in capitals does not count.
    The confidence stands in the exploded rows: beside the generator it would be computed, from
    the whole text, once for each claim.
    """
    claims = X.let(claim_confidence(), lambda confidence: F.transform(
        claim_sentences(F.col("text")), lambda claim, place: F.struct(place.alias("place"), claim.alias("claim"), confidence.alias("confidence"))))
    said = evidence.select("query_id", "rank", "chunk_id", F.inline_outer(claims))
    first = said.filter("claim IS NOT NULL").groupBy("query_id", F.lower("claim").alias("said")).agg(
        F.min(F.struct("rank", "place", "chunk_id", "confidence", "claim")).alias("c")).select("query_id", "c.*")
    order = Window.partitionBy("query_id").orderBy("rank", "place")
    return first.withColumn("claim_index", F.row_number().over(order) - 1).select("query_id", "claim_index", "chunk_id", "claim", "confidence")


def claim_confidence(score: str = "relevance", source: str = "source") -> Column:
    n = F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))
    quality = F.when(n < 50, 0.5).when(n < 100, 0.75).otherwise(1.0)
    known = F.when(F.col(source).isNotNull(), 1.0).otherwise(0.5)
    return F.when(n == 0, 0.0).otherwise(F.round(clamp01(0.7 * clamp01(F.col(score)) + 0.2 * quality + 0.1 * known), 4))


# -- collection and scores ----------------------------------------------------------------


def length_class(text: Column) -> Column:
    n = F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(F.length(text) == 0, 0.0).when(n < 20, 0.2).when(n < 100, 0.5).when(n < 300, 0.75).otherwise(1.0)


PROVENANCE = ("document_id", "chunk_id", "paper_id", "source_uri", "title", "page_number", "section")


def score_evidence(rows: DataFrame) -> DataFrame:
    """Adds ``evidence_score``: search score, rerank score, length class, known provenance."""
    have = F.lit(0)
    for name in PROVENANCE:
        if name in rows.columns:
            have = have + F.col(name).isNotNull().cast("int")
    score = (
        0.30 * clamp01(F.col("retrieval_score")) + 0.35 * clamp01(F.col("rerank_score"))
        + 0.20 * length_class(F.coalesce("text", F.lit(""))) + 0.15 * F.least(F.lit(1.0), have / F.lit(4.0))
    )
    return rows.withColumn("evidence_score", r6(clamp01(score)))


def evidence_key(rows: DataFrame) -> Column:
    """Chunk, else document, else paper, else the text."""
    parts = [F.concat(F.lit(f"{n}:"), F.col(n).cast("string")) for n in ("chunk_id", "document_id", "paper_id") if n in rows.columns]
    return F.coalesce(*parts, F.concat(F.lit("content:"), F.sha2(X.squeeze(F.lower("text")), 256)))


def collect_evidence(rows: DataFrame, limit: int | None = None, min_score: float = 0.0) -> DataFrame:
    """Best rows of each query, one per chunk, document, paper or text.

    ``rows`` carry ``row_id`` and ``evidence_score``; only keys and scores are shuffled twice.
    """
    keyed = rows.filter((F.col("evidence_score") >= min_score) & (F.length(X.squeeze(F.col("text"))) > 0)).select(
        "query_id", "row_id", "evidence_score", evidence_key(rows).alias("key"))
    best = keyed.groupBy("query_id", "key").agg(F.min(F.struct((-F.col("evidence_score")).alias("s"), "row_id")).alias("b"))
    flat = best.select("query_id", "key", F.col("b.row_id").alias("row_id"), (-F.col("b.s")).alias("evidence_score"))
    return top_k(flat, "query_id", limit, F.desc("evidence_score"), F.asc("row_id"))


def collect_evidence_ordered(rows: DataFrame, limit: int | None = None, min_length: int = 10) -> DataFrame:
    """Distinct rows by score; with a ``limit``, the first so many in order of arrival."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    key = F.coalesce(F.concat(F.col("document_id").cast("string"), F.lit(":"), F.col("chunk_id").cast("string")), F.sha2(X.squeeze(F.lower("text")), 256))
    keyed = rows.filter(F.length(text) >= min_length).select("query_id", "arrival", "score", key.alias("key"))
    first = keyed.groupBy("query_id", "key").agg(F.min(F.struct("arrival", "score")).alias("f")).select("query_id", "key", "f.*")
    held = top_k(first, "query_id", limit, F.asc("arrival"), rank="seat")
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("arrival")))).drop("seat")


def provenance_completeness(rows: DataFrame, required: tuple[str, ...] = ("source",), extra: str | None = None) -> DataFrame:
    """Share of required fields present and the source key; ``extra`` present is one more check passed."""
    there = F.lit(0)
    for name in required:
        there = there + F.when(F.coalesce(F.length(F.col(name).cast("string")) > 0, F.lit(False)), 1).otherwise(0)
    checks = F.lit(len(required))
    if extra:
        bonus = F.when(F.col(extra).isNotNull(), 1).otherwise(0)
        there, checks = there + bonus, checks + bonus
    return rows.withColumn("completeness", r6(F.when(checks == 0, 1.0).otherwise(there / checks))).withColumn("source_key", source_key())


def source_key() -> Column:
    return F.coalesce(
        F.nullif(F.col("source"), F.lit("")), F.nullif(F.col("document_id").cast("string"), F.lit("")), F.col("evidence_id").cast("string"))


# -- coverage -----------------------------------------------------------------------------


def _hits(terms: DataFrame, evidence: DataFrame, present) -> DataFrame:
    """``query_id, hit, items``: which of a query's terms any of its evidence holds.

    Each evidence row reports its own terms; only those short arrays meet.
    """
    own = evidence.join(terms, "query_id").select(
        "query_id", X.let(F.lower("text"), lambda body: F.filter("terms", lambda t: present(body, t))).alias("own"))
    return own.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("hit"), F.count(F.lit(1)).alias("items"))


def coverage_quality(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Matched and missing terms; 0.7 lexical share plus 0.3 mean evidence score."""
    found = X.matches(F.lower("text"), r"[A-Za-z0-9][A-Za-z0-9_-]*")
    terms = queries.select("query_id", F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*QUERY_STOP))).alias("terms"))
    quality = evidence.groupBy("query_id").agg(F.avg("evidence_score").alias("quality"))
    base = terms.join(_hits(terms, evidence, X.has_term), "query_id", "left").join(quality, "query_id", "left").withColumns({
        "hit": F.coalesce("hit", F.array().cast("array<string>")), "items": F.coalesce("items", F.lit(0)), "quality": F.coalesce("quality", F.lit(0.0))})
    n = F.size("terms")
    score = F.when(n == 0, F.when(F.col("items") > 0, 1.0).otherwise(0.0)).otherwise(clamp01(0.7 * F.size("hit") / n + 0.3 * F.col("quality")))
    return base.select(
        "query_id", F.filter("terms", lambda t: F.array_contains("hit", t)).alias("matched"), F.filter("terms", lambda t: ~F.array_contains("hit", t)).alias("missing"),
        r6(score).alias("coverage"), (r6(score) >= 0.6).alias("sufficient"))


def _bounded(body: Column, term: Column) -> Column:
    return F.regexp_like(body, F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), term, F.lit(r"($|[^\p{L}\p{N}_])")))


def coverage_terms(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of the query's terms found as words; no terms count as not covered."""
    terms = queries.select("query_id", X.term_set(F.col("text"), COVERAGE_STOP, 1).alias("ts")).select(
        "query_id", F.filter("ts", lambda t: F.length(t) >= 2).alias("terms"))
    base = terms.join(_hits(terms, evidence, _bounded), "query_id", "left")
    covered = F.coalesce(F.size(F.coalesce("hit", F.array().cast("array<string>"))), F.lit(0))
    score = F.when(F.size("terms") == 0, 0.0).otherwise(covered / F.size("terms"))
    return base.select("query_id", F.size("terms").alias("terms"), covered.alias("covered"), r6(score).alias("coverage"), (r6(score) >= 0.7).alias("sufficient"))


def coverage_tokens(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of the query's word set in the union of the evidence's word sets."""
    q = queries.select("query_id", X.word_set(F.col("text")).alias("terms"))
    own = evidence.join(q, "query_id").select("query_id", F.array_intersect("terms", X.word_set(F.col("text"))).alias("own"))
    hit = own.groupBy("query_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("own")))).alias("covered"))
    base = q.join(hit, "query_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    score = F.when(F.size("terms") == 0, 0.0).otherwise(F.col("covered") / F.size("terms"))
    return base.select("query_id", F.size("terms").alias("total_terms"), F.col("covered").alias("covered_terms"), r6(score).alias("coverage"))


# -- agreement ----------------------------------------------------------------------------


def corroboration(rows: DataFrame, threshold: int = 2) -> DataFrame:
    """Distinct sources per query; ``threshold`` of them make it independently supported."""
    per = rows.select("query_id", source_key().alias("key")).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.count_distinct("key").alias("unique_sources"))
    return per.withColumn("corroboration", r6(F.least(F.lit(1.0), F.col("unique_sources") / F.lit(threshold)))).withColumn(
        "independent", F.col("unique_sources") >= threshold)


def stance_tokens(text: Column) -> Column:
    found = X.matches(F.lower(text), r"[\p{L}\p{N}_']+")
    return F.array_distinct(F.filter(found, lambda t: t.rlike(r"^[a-z0-9']+$")))


# rows of a query whose token sets are compared within one row; larger groups meet on tokens
ROWS_TOGETHER = 32


def _close_within_rows(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different sides of queries with few ``sets``, which fit in one row."""
    rows = sets.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("id", "copies", "denies", "asserts", "tokens"))).alias("xs"))

    def pair(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x["tokens"], y["tokens"]))
        return X.let(shared, lambda n: F.struct(
            x["id"].alias("a"), y["id"].alias("b"), (n / (F.size(x["tokens"]) + F.size(y["tokens"]) - n)).alias("similarity"),
            x["asserts"].alias("asserts_a"), y["asserts"].alias("asserts_b"), (x["copies"] * y["copies"]).alias("pairs")))

    pairs = X.let(F.col("xs"), lambda xs: F.flatten(F.transform(xs, lambda x, i: F.transform(
        F.filter(F.slice(xs, i + 2, F.size(xs)), lambda y: y["denies"] != x["denies"]), lambda y: pair(x, y)))))
    return rows.select("query_id", F.inline(pairs)).filter(F.col("similarity") >= threshold - 1e-9).withColumn("similarity", r6(F.col("similarity")))


def contradiction_pairs(rows: DataFrame, similarity: float = 0.35, threshold: float = 0.65) -> DataFrame:
    """Similar texts of a query of which one denies and the other does not.

    Denial must differ to reach the threshold, so only rows of different sides meet: within a
    row for queries of at most ROWS_TOGETHER rows, which any result list has, and on their rare
    tokens for larger ones. No limit on the number of pairs.
    """
    # Written once: the texts behind the tokens are costly and both ways read them.
    told = cut_lineage(rows.select("query_id", "chunk_id", F.array_sort(stance_tokens(F.col("text"))).alias("tokens"))).filter(F.size("tokens") > 0)
    few = told.groupBy("query_id").agg((F.count(F.lit(1)) <= ROWS_TOGETHER).alias("few"))
    placed = told.join(few, "query_id")

    def flagged(sets: DataFrame) -> DataFrame:
        return sets.withColumns({
            "denies": F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in NEGATION])),
            "asserts": F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in ASSERTION]))})

    folded = placed.filter("few").groupBy("query_id", "tokens").agg(F.min("chunk_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    within = _close_within_rows(flagged(folded), similarity)
    found = within if few.filter("NOT few").isEmpty() else within.unionByName(_close_across_rows(flagged, placed, similarity, within.columns))
    judged = found.withColumn("contradiction", F.round(0.7 + F.when(F.col("asserts_a") != F.col("asserts_b"), 0.2).otherwise(0.0), 6))
    return judged.filter(F.col("contradiction") >= threshold).select("query_id", "a", "b", "similarity", "contradiction", "pairs")


def _close_across_rows(flagged: Callable[[DataFrame], DataFrame], placed: DataFrame, similarity: float, columns: list[str]) -> DataFrame:
    """The same pairs of queries with many rows, which meet on their rare tokens."""
    crowded = flagged(fold_sets(placed.filter("NOT few"), ["query_id"], "chunk_id", F.col("tokens")))
    close = jaccard_pairs(crowded, similarity, ["query_id"], "id", side=F.col("denies"))

    def flags(tag: str) -> DataFrame:
        return crowded.select("query_id", F.col("id").alias(tag), F.col("asserts").alias(f"asserts_{tag}"), F.col("copies").alias(f"copies_{tag}"))

    return close.join(flags("a"), ["query_id", "a"]).join(flags("b"), ["query_id", "b"]).withColumn(
        "pairs", F.col("copies_a") * F.col("copies_b")).select(*columns)


def contradictions(rows: DataFrame, similarity: float = 0.35, threshold: float = 0.65) -> DataFrame:
    """Contradicting pairs per query and the consistency score."""
    found = contradiction_pairs(rows, similarity, threshold).groupBy("query_id").agg(F.sum("pairs").alias("pairs"))
    sizes = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"))
    n = F.coalesce("pairs", F.lit(0))
    return sizes.join(found, "query_id", "left").select(
        "query_id", "items", n.alias("contradictions"), r6(F.greatest(F.lit(0.0), 1.0 - n / F.col("items"))).alias("consistency"), (n > 0).alias("has_contradiction"))


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """Claims that speak of gain or loss with the number of claims of their query saying the opposite.

    The opposite of a claim is a whole class, so counts per class give every claim its number
    without pairing claims.
    """
    low = X.squeeze(F.lower("claim"))

    def any_of(phrases: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        return hit

    marked = claims.select("query_id", "claim_index", any_of(POSITIVE_PHRASES).alias("gain"), any_of(NEGATIVE_PHRASES).alias("loss")).filter("gain OR loss")
    sizes = marked.groupBy("query_id").agg(
        F.count_if("gain").alias("gains"), F.count_if("loss").alias("losses"), F.count_if(F.col("gain") & F.col("loss")).alias("both"))
    # opponents: losses for a gain, gains for a loss; a claim that is both meets either kind, itself excluded
    n = F.when(F.col("gain") & F.col("loss"), F.col("gains") + F.col("losses") - F.col("both") - 1).when(
        F.col("gain"), F.col("losses")).otherwise(F.col("gains"))
    return marked.join(sizes, "query_id").select("query_id", "claim_index", "gain", "loss", n.alias("opponents")).filter("opponents > 0")


def validate_evidence(rows: DataFrame, min_length: int = 10, min_score: float = 0.0, require_source: bool = False) -> DataFrame:
    """Adds ``errors`` and ``accepted``."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    checks = [
        F.when(F.col("evidence_id").isNull(), F.lit("missing evidence identifier")),
        F.when(body == "", F.lit("empty content")),
        F.when(F.length(body) < min_length, F.lit("content below minimum length")),
        F.when(F.col("score") < min_score, F.lit("score below minimum threshold")),
        F.when(F.col("rank") < 0, F.lit("negative rank")),
    ]
    if require_source:
        checks.append(F.when(F.col("source").isNull() & F.col("document_id").isNull(), F.lit("missing source")))
    return rows.withColumn("errors", F.array_compact(F.array(*checks))).withColumn("accepted", F.size("errors") == 0)


def acceptance_rate(validated: DataFrame) -> DataFrame:
    return validated.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("accepted").alias("accepted"), r6(F.count_if("accepted") / F.count(F.lit(1))).alias("acceptance"))


def evidence_confidence(confidence: Column, relevance: Column, text: Column) -> Column:
    n = F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    quality = F.when(n == 0, 0.0).when(n >= 500, 1.0).when(n >= 200, 0.8).when(n >= 100, 0.6).otherwise(0.4)
    return F.round(clamp01(0.4 * clamp01(confidence) + 0.4 * clamp01(relevance) + 0.2 * quality), 4)


def assess_evidence(queries: DataFrame, rows: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Relevance, coverage, corroboration, provenance and consistency in one score per query."""
    known = provenance_completeness(rows, ("source",))
    items = known.select("query_id", "chunk_id", "completeness", (0.75 * clamp01(F.col("score")) + 0.25 * F.col("completeness")).alias("item"))
    best = top_k(items, "query_id", 5, F.desc("item"), F.asc("chunk_id"), rank="place")
    relevance = best.groupBy("query_id").agg((F.sum(F.col("item") / F.col("place")) / F.sum(1.0 / F.col("place"))).alias("relevance"))
    provenance = known.groupBy("query_id").agg(F.avg("completeness").alias("provenance"))
    parts = (
        queries.select("query_id").join(relevance, "query_id", "left").join(provenance, "query_id", "left")
        .join(coverage_terms(queries, rows).select("query_id", "coverage", "sufficient"), "query_id", "left")
        .join(corroboration(rows).select("query_id", "corroboration"), "query_id", "left")
        .join(contradictions(rows).select("query_id", "consistency", "has_contradiction"), "query_id", "left")
        .fillna(0.0, ["relevance", "provenance", "coverage", "corroboration", "consistency"]).fillna(False, ["sufficient", "has_contradiction"])
    )
    overall = r6(clamp01(0.35 * F.col("relevance") + 0.25 * F.col("coverage") + 0.15 * F.col("corroboration") + 0.10 * F.col("provenance") + 0.15 * F.col("consistency")))
    enough = (F.col("overall") >= threshold) & F.col("sufficient") & ~F.col("has_contradiction")
    return parts.withColumn("overall", overall).select(
        "query_id", "overall", r6(F.col("relevance")).alias("relevance"), "coverage", "corroboration", r6(F.col("provenance")).alias("provenance"), "consistency",
        enough.alias("sufficient"), (~enough | (F.col("coverage") < 0.5) | F.col("has_contradiction")).alias("needs_refinement"))


# -- claims and their evidence ------------------------------------------------------------


def claim_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, claim_index, evidence_index, overlap``: evidence of the query sharing words with a claim."""
    a = claims.select("query_id", "claim_index", F.explode(F.array_distinct(X.tokens(F.col("claim")))).alias("word"))
    b = evidence.select("query_id", F.col("claim_index").alias("evidence_index"), F.explode(F.array_distinct(X.tokens(F.col("claim")))).alias("word"))
    return a.join(b, ["query_id", "word"]).groupBy("query_id", "claim_index", "evidence_index").agg(F.count(F.lit(1)).alias("overlap"))


def evidence_chain(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claim, its confidence and the source row behind it."""
    return claims.join(sources, "source_id", "left")


def group_findings(items: DataFrame, topics: tuple[str, ...], report: str = "query_id", default: str = "Findings") -> DataFrame:
    """Sections of every report: the claims of a topic joined in order, with their ids.

    ``items``: ``report, position, id, claim`` and topic columns, of which the first non-blank
    counts. Repeated ids are dropped; without an id, repeated claims. A section none of whose claims
    has an id has null for its ids. A report holds no more
    than the capped claims of one query, so a section is bounded.
    """
    blank = F.length(F.trim(F.coalesce("claim", F.lit("")))) == 0
    key = F.coalesce(F.concat(F.lit("id:"), F.nullif(F.trim(F.col("id").cast("string")), F.lit(""))), F.concat(F.lit("claim:"), X.squeeze(F.lower("claim"))))
    topic = F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in topics], F.lit(default))
    first = items.filter(~blank).select(
        report, key.alias("key"), F.struct("position", F.col("id").cast("string").alias("id"), F.trim("claim").alias("claim"), topic.alias("topic")).alias("r")
    ).groupBy(report, "key").agg(F.min_by("r", "r.position").alias("r")).select(report, "r.*")
    listed = F.array_sort(F.collect_list(F.struct("position", "id", "claim")))
    return first.groupBy(report, "topic").agg(listed.alias("xs")).select(
        report, "topic", F.size("xs").alias("statements"), F.array_join("xs.claim", " ").alias("content"),
        F.when(F.exists("xs.id", lambda i: i.isNotNull()), F.array_join("xs.id", ",")).alias("evidence_ids"))


def comparison_table(claims: DataFrame) -> DataFrame:
    """One row per claim and criterion."""
    return claims.withColumn("criterion", F.explode(F.array(*[F.lit(c) for c in CRITERIA])))


def render_references(sources: DataFrame) -> DataFrame:
    """APA, IEEE, MLA, BibTeX and plain entries. ``authors`` is an array."""
    year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
    names = F.array_join("authors", ", ")
    title = F.col("title")
    plain = F.concat(F.when(F.size("authors") > 0, names).otherwise("Unknown author"), F.lit(". "), title, F.lit(". "), year, F.lit("."),
                     F.coalesce(F.concat(F.lit(" "), F.nullif(F.col("url"), F.lit(""))), F.lit("")))
    return sources.withColumns({
        "apa": F.concat(names, F.lit(". ("), year, F.lit("). "), title, F.lit(".")),
        "ieee": F.concat(names, F.lit(', "'), title, F.lit('", '), year, F.lit(".")),
        "mla": F.concat(names, F.lit(". "), title, F.lit(". "), year, F.lit(".")),
        "bibtex": F.concat(F.lit("@article{"), F.replace(F.lower(title), F.lit(" "), F.lit("_")), F.lit(", title={"), title, F.lit("}, author={"),
                           F.array_join("authors", " and "), F.lit("}, year={"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("}}")),
        "plain": plain,
    })


# -- citation markers ---------------------------------------------------------------------

MARKER = r"(?i)\[E[0-9]+(?:\s*,\s*E[0-9]+)*\]"


def _ids(marker: Column) -> Column:
    """Ids of one marker in canonical form: E and the number without leading zeros."""
    return F.transform(F.regexp_extract_all(marker, F.lit(r"(?i)E0*([0-9]+)"), F.lit(1)), lambda n: F.concat(F.lit("E"), n))


def extract_citations(answers: DataFrame) -> DataFrame:
    """``query_id, position, evidence_id``: cited ids in order."""
    ids = F.flatten(F.transform(X.matches(F.col("answer"), MARKER), _ids))
    return answers.select("query_id", F.posexplode(ids).alias("position", "evidence_id"))


def validate_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Valid, invalid, missing and repeated ids of each answer.

    ``evidence``: ``query_id, evidence_id``.
    """
    cited = extract_citations(answers).groupBy("query_id", "evidence_id").agg(F.count(F.lit(1)).alias("times"))
    held = evidence.select("query_id", "evidence_id").distinct().withColumn("held", F.lit(True))
    both = cited.join(held, ["query_id", "evidence_id"], "full_outer")

    def ids(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("evidence_id")))), ",")

    per = both.groupBy("query_id").agg(
        ids(F.col("times").isNotNull() & F.col("held").isNotNull()).alias("valid_ids"), ids(F.col("held").isNull()).alias("invalid_ids"),
        ids(F.col("times").isNull()).alias("missing_ids"), ids(F.col("times") > 1).alias("duplicate_ids"), F.coalesce(F.sum("times"), F.lit(0)).alias("citations"))
    return answers.select("query_id").join(per, "query_id", "left").fillna("", ["valid_ids", "invalid_ids", "missing_ids", "duplicate_ids"]).fillna(
        0, ["citations"]).withColumn("valid", (F.col("invalid_ids") == "") & (F.col("citations") > 0))


def strip_invalid_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answers with every marker reduced to ids that exist; a marker without any goes."""
    held = evidence.groupBy("query_id").agg(F.collect_set("evidence_id").alias("held"))
    joined = answers.join(held, "query_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))

    def rebuilt(marker: Column, known: Column) -> Column:
        ids = F.array_distinct(F.filter(_ids(marker), lambda i: F.array_contains(known, i)))
        return F.when(F.size(ids) == 0, "").otherwise(F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")))

    texts = F.split("answer", MARKER)
    marks = F.concat(F.transform(X.matches(F.col("answer"), MARKER), lambda m: rebuilt(m, F.col("held"))), F.array(F.lit("")))
    return joined.select("query_id", F.array_join(F.zip_with(texts, marks, lambda t, m: F.concat(t, m)), "").alias("answer"))
