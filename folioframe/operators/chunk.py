"""Sections, sentences and chunks.

A text is one row, so cutting it is done inside the row with array functions: no shuffle.
Arrays are opened with the outer explode and nulls dropped after: for the plain one the
optimizer adds a filter that computes the array a second and a third time.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.lexicon import KNOWN_HEADINGS, STRUCTURAL_HEADINGS
from folioframe.operators.clean import normalize_lines

ENDS = r"^\s+|\s+$"


def chunk_id(document_id: Column, index: Column) -> Column:
    """Same document and place, same id."""
    return F.sha2(F.concat(document_id.cast("string"), F.lit(":"), index.cast("string")), 256)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, ENDS, "")


def split_sentences(documents: DataFrame) -> DataFrame:
    return documents.select("document_id", F.posexplode_outer(X.sentences(F.col("text"))).alias("sentence_index", "sentence")).filter(
        "sentence_index IS NOT NULL")


def estimate_tokens(documents: DataFrame) -> DataFrame:
    t = F.col("text")
    return documents.select("document_id", X.tokens_by_words(t).alias("by_words"), X.tokens_by_matches(t).alias("by_matches"))


def detect_headers(documents: DataFrame) -> DataFrame:
    """Markdown and numbered headings with level and line number."""
    lines = documents.select("document_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select(
        "document_id", "line", _strip(F.col("raw")).alias("t"))
    hashes = F.regexp_extract("t", r"^(#{1,6})\s+(.*)$", 1)
    number = F.regexp_extract("t", r"^([0-9]+(\.[0-9]+)*)\s+(.*)$", 1)
    found = lines.withColumns({"hashes": hashes, "number": number}).filter("hashes <> '' OR number <> ''")
    marked = F.col("hashes") != ""
    return found.select(
        "document_id", "line",
        F.when(marked, F.length("hashes")).otherwise(F.length("number") - F.length(F.replace("number", F.lit("."), F.lit(""))) + 1).alias("level"),
        F.when(~marked, F.col("number")).alias("number"),
        _strip(F.when(marked, F.regexp_extract("t", r"^#{1,6}\s+(.*)$", 1)).otherwise(F.regexp_extract("t", r"^[0-9]+(?:\.[0-9]+)*\s+(.*)$", 1))).alias("title"),
    )


# fixed values: shape of a heading line
HEADING_LINE = r"^(?:([0-9]+(?:\.[0-9]+)*)[.:\s-]+)?([A-Z][A-Za-z0-9][A-Za-z0-9\s,:&'()/-]{1,150})$"


def heading_level(line: Column) -> Column:
    """Level of a heading line, 0 for other lines. The line is stripped already."""
    number = F.regexp_extract(line, HEADING_LINE, 1)
    title = _strip(F.regexp_extract(line, HEADING_LINE, 2))
    plausible = (title != "") & (F.size(F.split(title, r"\s+")) <= 15) & (title != F.lower(title))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return (
        F.when(F.length(line) > 180, 0)
        .when(F.lower(line).isin(*KNOWN_HEADINGS), 1)
        .when(plausible, dots + 1)
        .otherwise(0)
    ).cast("int")


def parse_sections(documents: DataFrame) -> DataFrame:
    """Headings with the lines below them; lines before the first heading form "Document".

    A section runs from its start to the next start, found as positions in the line array.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), _strip), lambda l: l != "")

    def cut(ls: Column) -> Column:
        return X.let(F.transform(ls, heading_level), lambda lv: X.let(
            F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: (i == 1) | (F.get(lv, i - 1) > 0)),
            lambda st: F.transform(st, lambda s, i: section(ls, lv, s, i, F.coalesce(F.get(st, i + 1), F.size(ls) + 1)))))

    def section(ls: Column, lv: Column, s: Column, i: Column, stop: Column) -> Column:
        headed = F.get(lv, s - 1) > 0
        skip = F.when(headed, 1).otherwise(0)
        return F.struct(
            (i + 1).alias("section_index"),
            F.when(headed, F.get(ls, s - 1)).otherwise("Document").alias("title"),
            F.when(headed, F.get(lv, s - 1)).otherwise(1).alias("level"),
            F.array_join(F.slice(ls, s + skip, stop - s - skip), "\n").alias("content"),
        )

    rows = documents.select("document_id", lines.alias("ls")).filter(F.size("ls") > 0)
    return rows.select("document_id", F.inline_outer(X.let(F.col("ls"), cut))).filter("section_index IS NOT NULL")


def structural_heading(line: Column) -> tuple[Column, Column]:
    """Title (null for other lines) and level of a line, by the structural chunker's rules."""
    known = rf"(?i)^(?:[0-9]+(?:\.[0-9]+)*\s+)?({STRUCTURAL_HEADINGS})\s*$"
    numbered = r"^\s*([0-9]+(?:\.[0-9]+)*)\s+(.+?)\s*$"
    word = F.regexp_extract(line, known, 1)
    number = F.regexp_extract(line, numbered, 1)
    rest = F.regexp_extract(line, numbered, 2)
    short = F.size(X.words(rest)) <= 12
    title = F.when(F.length(line) <= 120, F.when(word != "", word).when((number != "") & short, rest))
    level = F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(1)
    return title, level


def structural_chunks(documents: DataFrame, max_tokens: int = 500) -> DataFrame:
    """Headings and paragraphs as chunks; a paragraph over ``max_tokens`` is cut by words."""
    def marked(line: Column) -> Column:
        title, level = structural_heading(line)
        return F.struct(line.alias("t"), title.alias("hd"), level.alias("lv"))

    def begins(ls: Column, i: Column) -> Column:
        here, before = F.get(ls, i - 1), F.get(ls, i - 2)
        after_break = (i == 1) | (before["t"] == "") | before["hd"].isNotNull()
        return (here["t"] != "") & (here["hd"].isNotNull() | after_break)

    def block(ls: Column, heads: Column, s: Column, stop: Column) -> Column:
        first = F.get(ls, s - 1)
        owner = F.try_element_at(F.filter(heads, lambda h: h <= s), F.lit(-1))
        body = F.array_join(F.filter(F.transform(F.slice(ls, s, stop - s), lambda l: l["t"]), lambda t: t != ""), " ")
        return F.struct(
            first["hd"].isNotNull().alias("is_head"), F.coalesce(first["hd"], body).alias("body"),
            F.get(ls, owner - 1)["hd"].alias("section_title"), F.coalesce(F.get(ls, owner - 1)["lv"], F.lit(0)).alias("section_level"),
        )

    def pieces(b: Column) -> Column:
        return X.let(X.words(b["body"]), lambda ws: cut(b, ws, ~b["is_head"] & (F.floor(F.size(ws) * F.lit(1.3)) > max_tokens)))

    def cut(b: Column, ws: Column, long: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1)), F.lit(max_tokens))
        parts = F.when(long, F.transform(starts, lambda p: F.array_join(F.slice(ws, p, max_tokens), " "))).otherwise(F.array(b["body"]))
        kind = F.when(b["is_head"], "heading").when(long, "structural_split").otherwise("structural")
        return F.transform(parts, lambda t: F.struct(
            t.alias("text"), kind.alias("chunk_type"), b["section_title"].alias("section_title"), b["section_level"].alias("section_level")))

    def chunks(ls: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(ls))
        return X.let(F.filter(at, lambda i: begins(ls, i)), lambda st: X.let(
            F.filter(at, lambda i: F.get(ls, i - 1)["hd"].isNotNull()),
            lambda heads: F.flatten(F.transform(st, lambda s, i: pieces_of(ls, heads, s, F.coalesce(F.get(st, i + 1), F.size(ls) + 1))))))

    def pieces_of(ls: Column, heads: Column, s: Column, stop: Column) -> Column:
        return X.let(block(ls, heads, s, stop), pieces)

    lines = F.transform(F.split(normalize_lines(F.col("text")), "\n"), marked)
    return documents.select("document_id", F.posexplode_outer(X.let(lines, chunks)).alias("chunk_index", "c")).filter(
        "chunk_index IS NOT NULL").select("document_id", "chunk_index", "c.*")


def fixed_chunks(documents: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` words that step by ``size - overlap``."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    rows = documents.select("document_id", X.words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.size("ws"), F.lit(size - overlap))
    return rows.select("document_id", "ws", F.posexplode(starts).alias("chunk_index", "p")).select(
        "document_id", "chunk_index", F.array_join(F.slice("ws", F.col("p"), F.lit(size)), " ").alias("text"),
        F.least(F.lit(size), F.size("ws") - F.col("p") + 1).alias("token_count"))


def sentence_pack_chunks(documents: DataFrame, max_words: int = 300) -> DataFrame:
    """Sentences packed in order until the next would exceed ``max_words``."""
    empty = F.struct(F.lit(0).alias("no"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("nos"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["used"] + n > max_words) & (acc["used"] > 0)
        no = acc["no"] + F.when(full, 1).otherwise(0)
        return F.struct(no.alias("no"), F.when(full, n).otherwise(acc["used"] + n).alias("used"), F.array_append(acc["nos"], no).alias("nos"))

    def join(ss: Column, nos: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.element_at(nos, -1)),
            lambda k: F.array_join(F.slice(ss, F.array_position(nos, k).cast("int"), F.size(F.filter(nos, lambda x: x == k))), " "))

    def pack(ss: Column) -> Column:
        counts = F.transform(ss, lambda s: F.size(X.words(s)))
        return X.let(F.aggregate(counts, empty, step)["nos"], lambda nos: join(ss, nos))

    rows = documents.select("document_id", X.sentences(F.col("text")).alias("ss")).filter(F.size("ss") > 0)
    packed = rows.select("document_id", F.posexplode_outer(X.let(F.col("ss"), pack)).alias("chunk_index", "text")).filter("chunk_index IS NOT NULL")
    return packed.withColumn("token_count", F.size(X.words(F.col("text"))))


def code_chunks(documents: DataFrame, max_lines: int = 80) -> DataFrame:
    """Windows of ``max_lines`` lines."""
    body = F.regexp_replace("text", r"(\r\n|\r|\n)$", "")
    rows = documents.filter(F.length("text") > 0).select("document_id", F.split(body, r"\r\n|\r|\n").alias("ls"))
    starts = F.sequence(F.lit(1), F.size("ls"), F.lit(max_lines))
    cut = rows.select("document_id", "ls", F.posexplode(starts).alias("chunk_index", "p")).select(
        "document_id", "chunk_index", F.array_join(F.slice("ls", F.col("p"), F.lit(max_lines)), "\n").alias("text"))
    return cut.withColumn("token_count", F.size(X.words(F.col("text"))))


def char_chunks(documents: DataFrame, size: int = 1000) -> DataFrame:
    """Cuts of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(size))
    return documents.filter(F.length("text") > 0).select("document_id", "text", F.posexplode(starts).alias("chunk_index", "p")).select(
        "document_id", "chunk_index", F.substr("text", F.col("p"), F.lit(size)).alias("text"))


# -- semantic chunks: two folds over sentence sizes, within the row -------------------------

# fixed values: where sentences end, and tokens per word
SENTENCE_END = r"(?<=[.!?])[\"'”’)]*\s+|\n"
TOKENS_PER_WORD = 1.3
_SPANS = "array<struct<first: int, stop: int>>"


def _cost(words: Column) -> Column:
    """Estimated tokens of a number of words."""
    return F.when(words > 0, F.greatest(F.lit(1), F.floor(words * F.lit(TOKENS_PER_WORD)).cast("int"))).otherwise(0)


def _sums(values: Column) -> Column:
    """0 and all running totals."""
    return F.aggregate(values, F.array(F.lit(0)), lambda out, v: F.array_append(out, F.element_at(out, -1) + v))


def _spans(sizes: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Chunks as spans of word numbers. A chunk is always a run of words: whole sentences, from
    as far back as the overlap allows, or a window of a sentence that is too long by itself.
    """
    def fold(costs: Column, words: Column, spent: Column) -> Column:
        def close(out: Column, lo: Column, i: Column) -> Column:
            span = F.struct(F.get(words, lo).alias("first"), F.get(words, i).alias("stop"))
            return F.when(lo < i, F.array_append(out, span)).otherwise(out)

        def windows(i: Column) -> Column:
            first, stop = F.get(words, i), F.get(words, i + 1)
            return F.transform(F.sequence(first, stop - 1, F.lit(max_tokens)), lambda at: F.struct(
                at.alias("first"), F.least(at + max_tokens, stop).alias("stop")))

        def back(lo: Column, i: Column) -> Column:
            # The earliest sentence from which the rest fits in the overlap; one at least.
            fits = F.filter(F.sequence(lo, i - 1), lambda j: F.get(spent, i) - F.get(spent, j) <= overlap_tokens)
            return F.coalesce(F.get(fits, F.lit(0)), i - 1) if overlap_tokens > 0 else i

        def step(state: Column, i: Column) -> Column:
            cost, lo, out = F.get(costs, i), state["lo"], state["out"]
            held = F.get(spent, i) - F.get(spent, lo)
            long, full = cost > max_tokens, (lo < i) & (held + cost > max_tokens)
            return F.struct(
                F.when(long, i + 1).when(full, back(lo, i)).otherwise(lo).alias("lo"),
                F.when(long, F.concat(close(out, lo, i), windows(i))).when(full, close(out, lo, i)).otherwise(out).alias("out"))

        start = F.struct(F.lit(0).alias("lo"), F.array().cast(_SPANS).alias("out"))
        return F.when(F.size(costs) > 0, F.aggregate(
            F.sequence(F.lit(0), F.size(costs) - 1), start, step, lambda s: close(s["out"], s["lo"], F.size(costs))))

    costs = F.transform(sizes, _cost)
    return X.let(F.struct(costs.alias("c"), _sums(sizes).alias("w")), lambda s: X.let(
        _sums(s["c"]), lambda spent: fold(s["c"], s["w"], spent)))


def _grouped(spans: Column, max_tokens: int, min_tokens: int) -> Column:
    """Spans gathered to chunks: a small one joins the chunk before where both fit."""
    def step(out: Column, span: Column) -> Column:
        n = span["stop"] - span["first"]
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (_cost(n) < min_tokens) & (_cost(F.try_element_at(out, F.lit(-1))["n"] + n) <= max_tokens)
        alone = F.struct(n.alias("n"), F.array(span).alias("spans"))
        return F.when(joins, F.array_append(F.slice(out, 1, F.size(out) - 1), F.struct(
            (last["n"] + n).alias("n"), F.array_append(last["spans"], span).alias("spans")))).otherwise(F.array_append(out, alone))

    return F.aggregate(spans, F.array().cast(f"array<struct<n: int, spans: {_SPANS}>>"), step)


def semantic_chunks(documents: DataFrame, max_tokens: int = 500, overlap_tokens: int = 50, min_tokens: int = 50) -> DataFrame:
    """Sentence-aware chunks, cut within the row by folds over sentence sizes.

    Sentences fill a chunk to ``max_tokens``; the next begins with those last ones that fit in
    ``overlap_tokens``; a longer sentence is cut into windows of ``max_tokens`` words. Chunks
    below ``min_tokens`` join the one before if both fit. Texts without words give no rows.
    """
    said = F.filter(F.transform(F.split("text", SENTENCE_END), lambda s: X.words(s)), lambda ws: F.size(ws) > 0)

    def texts(sentences: Column) -> Column:
        sizes = F.transform(sentences, lambda ws: F.size(ws))
        chunks = X.let(_spans(sizes, max_tokens, overlap_tokens), lambda spans: _grouped(spans, max_tokens, min_tokens))
        return X.let(F.flatten(sentences), lambda words: F.transform(chunks, lambda c: F.struct(
            F.array_join(F.flatten(F.transform(
                c["spans"], lambda s: F.slice(words, s["first"] + 1, s["stop"] - s["first"]))), " ").alias("text"),
            _cost(c["n"]).alias("token_count"))))

    # A filter on the sentences here would be pushed below them and split every text twice.
    rows = documents.select("document_id", normalize_lines(F.col("text")).alias("text")).select("document_id", said.alias("ss"))
    made = rows.select("document_id", F.posexplode_outer(X.let(F.col("ss"), texts)).alias("chunk_index", "c"))
    return made.filter("chunk_index IS NOT NULL").select("document_id", "chunk_index", "c.text", "c.token_count")


# -- links and trees ----------------------------------------------------------------------


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Neighbours and sizes of chunks numbered from 0.

    The neighbours follow from the number of chunks of the document, an aggregate, so a very
    long document is never gathered in one task.
    """
    sizes = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    i = F.col("chunk_index")
    return chunks.join(sizes, "document_id").select(
        "document_id", "chunk_index", chunk_id(F.col("document_id"), i).alias("chunk_id"),
        F.when(i > 0, i - 1).alias("previous_index"), F.when(i < F.col("n_chunks") - 1, (i + 1)).alias("next_index"),
        F.length("text").alias("character_count"), X.tokens_by_words(F.col("text")).alias("token_count"))


def broken_sequences(chunks: DataFrame) -> DataFrame:
    """Documents whose chunk numbers are not exactly 0..n-1."""
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"),
        F.count_distinct("chunk_index").alias("distinct_n"),
    ).filter("low <> 0 OR high <> n - 1 OR distinct_n <> n")


def document_tree(nodes: DataFrame) -> DataFrame:
    """``node_id, parent_id, depth``: nodes below the root (null parent); orphans hang on the root.

    Pointer doubling: every node knows an ancestor and how far it is, and takes over that
    ancestor's own one, so that a chain of n nodes takes log2(n) rounds. Only nodes that have
    not reached the root go through a round. Nodes of a circle never reach it and are left out;
    they are what remains once the rounds have covered as many levels as there are nodes.
    """
    from folioframe.session import cut_lineage

    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    tied = cut_lineage(nodes.join(known, "parent_id", "left").select(
        "node_id", F.when(F.col("known") & (F.col("parent_id") != F.col("node_id")), F.col("parent_id")).alias("parent_id")))
    done = tied.filter("parent_id IS NULL").select("node_id", F.lit(1).alias("depth"))
    open_ = tied.filter("parent_id IS NOT NULL").select("node_id", F.col("parent_id").alias("above"), F.lit(1).alias("steps"))
    reached, most = 1, tied.count()
    while reached < 2 * most:
        ends = done.select(F.col("node_id").alias("above"), "depth")
        further = open_.select(F.col("node_id").alias("above"), F.col("above").alias("next"), F.col("steps").alias("more"))
        moved = cut_lineage(open_.join(ends, "above", "left").join(further, "above", "left").select(
            "node_id", F.coalesce("next", "above").alias("above"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            (F.col("steps") + F.col("depth")).alias("depth")))
        done = cut_lineage(done.unionByName(moved.filter("depth IS NOT NULL").select("node_id", "depth")))
        open_ = moved.filter("depth IS NULL").drop("depth")
        reached *= 2
        if open_.isEmpty():
            break
    return tied.join(done, "node_id").select("node_id", "parent_id", "depth")
