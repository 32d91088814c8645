"""Benchmark decontamination by winnowing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import id_key, let, lowered, stored

#: What is not part of a word; capitals are lowered word by word afterwards.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5


def words_of(text: Column) -> Column:
    """Words of letters, digits and all other characters above 7F; none for null."""
    return lowered(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), ""))


def n_words(text: Column) -> Column:
    pieces = F.split(F.coalesce(text, F.lit("")), BETWEEN)
    return F.size(F.array_remove(pieces, "")).cast("long")


def marks(words: Column, length: int) -> Column:
    """For each window of ``length`` words its mark: the least hash of a gram inside.

    A gram has GRAM words, or all words of a shorter window. The mark depends on the window's
    words alone, so that two texts which share a window share its mark, and neighbouring
    windows mostly share one mark: a text's distinct marks are its winnowed fingerprints.
    """
    gram = min(GRAM, length)
    width = length - gram + 1

    def grams(hashes: Column) -> Column:
        parts = lambda i: [F.get(hashes, i + j) for j in range(1, gram)]
        return F.transform(hashes, lambda h, i: F.xxhash64(h, *parts(i)))

    def least(found: Column) -> Column:
        parts = lambda i: [F.get(found, i + j) for j in range(1, width)]
        return F.transform(found, lambda g, i: F.least(g, *parts(i)) if width > 1 else g)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    every = let(hashes, lambda h: let(grams(h), least))
    return F.slice(every, 1, F.greatest(F.size(words) - (length - 1), F.lit(0)))


def windows(words: Column, found: Column, length: int, wanted: Column) -> Column:
    """Start, length and text of the windows whose mark is among ``wanted``."""
    at = F.filter(F.transform(found, lambda m, i: F.when(F.array_contains(wanted, m), i)), lambda i: i.isNotNull())
    return F.transform(at, lambda i: F.struct(
        i.alias("start"), F.lit(length).alias("length"),
        F.array_join(F.slice(words, i + 1, F.lit(length)), " ").alias("window")))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``window, length, mark, items`` of ``benchmark(item_id, text)``.

    Each run of ``window`` words; an item of fewer words, but not none, is one window. A window
    of several items comes once, with all their ids.
    """
    base = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    base = base.withColumn("length", F.least(F.size("words"), F.lit(window)))
    whole = F.when(F.col("length") == window, marks(F.col("words"), window))
    for length in range(1, window):
        whole = whole.when(F.col("length") == length, marks(F.col("words"), length))
    cut = base.withColumn("found", whole).select("item_id", "length", F.posexplode("found").alias("at", "mark"), "words")
    text = F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ")
    return (
        cut.select("item_id", "length", "mark", text.alias("window"))
        .groupBy("window", "length", "mark").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )


KEYS = ["_llm_id", "_llm_text"]


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with keys that tell rows apart also where the id is null."""
    return docs.withColumns({"_llm_id": id_key(F.col("doc_id")), "_llm_text": F.xxhash64("text")})


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_llm_id, _llm_text, n_hit, items`` of the keyed rows that hold a benchmark window."""
    items = stored(item_windows(benchmark, window), "winnow-items")
    # At most ``window`` numbers.
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    if not lengths:
        return docs.sparkSession.createDataFrame([], "_llm_id long, _llm_text long, n_hit long, items array<string>")
    keyed = docs.select(*KEYS, "text")
    words = words_of(F.col("text"))
    all_marks = let(words, lambda w: F.array_distinct(F.concat(*[marks(w, n) for n in lengths])))
    printed = keyed.select(*KEYS, F.explode(all_marks).alias("mark"))
    shared = printed.join(items.select("mark").distinct(), "mark", "left_semi")
    seeds = stored(shared.groupBy(*KEYS).agg(F.collect_set("mark").alias("seeds")), "winnow-seeds")
    near = keyed.join(seeds, KEYS).dropDuplicates(KEYS)
    cut = let(words, lambda w: F.concat(*[windows(w, marks(w, n), n, F.col("seeds")) for n in lengths]))
    spans = near.select(*KEYS, F.explode(cut).alias("cut")).select(*KEYS, "cut.*")
    met = spans.join(items.select("window", "length", "items"), ["window", "length"])

    def cover(state: Column, span: Column) -> Column:
        stop = span["start"] + span["length"]
        fresh = F.greatest(stop - F.greatest(span["start"], state["upto"]), F.lit(0))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["upto"], stop).alias("upto"))

    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), cover, lambda s: s["n"].cast("long"))
    together = met.groupBy(*KEYS).agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("items").alias("items"))
    return together.select(*KEYS, covered.alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document of ``docs(doc_id, text)``, how much of it stands in ``benchmark(item_id, text)``.

    Marks of documents and items are joined; the windows at the marks they share are then
    compared word by word and extended to all words they cover. Every shared window is found,
    since both sides give it the same mark; nothing else is reported. A shorter item is a
    window of its own length, and documents are marked for each such length that occurs.

    ``n_words, n_hit, n_items, items_sha256, contaminated``: a null or empty text has no words
    and no hits; the digest of no items is that of the empty string; items without id are not
    counted. Repeated rows each get their row. An empty benchmark hits nothing.
    """
    keyed = keyed_rows(docs.select("doc_id", "text"))
    told = keyed.select("doc_id", *KEYS, n_words(F.col("text")).alias("n_words"))
    return told.join(hits(keyed, benchmark, window), KEYS, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    keyed = keyed_rows(docs)
    hit = stored(hits(keyed, benchmark, window).select(*KEYS), "winnow-hit")
    return keyed.join(hit, KEYS, "left_anti").drop(*KEYS)
