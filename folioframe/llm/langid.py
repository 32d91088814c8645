"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import stored
from folioframe.session import ship_package

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
UNKNOWN = "und"
REMEMBERED = 100_000
PLACES = 1 << 30
BACKGROUND = 10.0


@dataclass(frozen=True)
class Model:
    """Log frequencies: one row per word or n-gram, one column per language (in order)."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray


def word_list(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    """The character n-grams of a word between its marks."""
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            by_lang.setdefault(lang, Counter()).update(word_list(text))
        for lang, words in by_lang.items():
            yield pd.DataFrame({"lang": lang, "gram": list(words), "n": list(words.values())})


def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        by_lang: dict[str, Counter] = {}
        for lang, word, n in zip(rows["lang"], rows["gram"], rows["n"], strict=True):
            mine = by_lang.setdefault(lang, Counter())
            for size in range(1, LONGEST + 1):
                for gram in grams_of(word, size):
                    mine[gram] += n
        for lang, grams in by_lang.items():
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` commonest entries of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= size).select("lang", "gram", "n")


def frequencies(rows: pd.DataFrame, langs: list[str], by_length: bool) -> tuple[dict[str, int], np.ndarray]:
    """Index and log frequencies, smoothed by BACKGROUND draws from the mean over languages;
    n-grams are counted among those of their length."""
    names = sorted(set(rows["gram"]))
    at = {g: i for i, g in enumerate(names)}
    column = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(names), len(langs)))
    np.add.at(counts, ([at[g] for g in rows["gram"]], [column[x] for x in rows["lang"]]), rows["n"].to_numpy(float))
    logs = np.zeros_like(counts)
    kind = np.array([len(g) for g in names]) if by_length else np.zeros(len(names), int)
    for k in np.unique(kind):
        mine = kind == k
        part = counts[mine] + 1e-9
        shares = (part / part.sum(axis=0)).mean(axis=1, keepdims=True)
        logs[mine] = np.log((counts[mine] + BACKGROUND * shares) / (counts[mine].sum(axis=0) + BACKGROUND))
    return at, logs.astype(np.float32)


def train(docs: DataFrame, per_language: int = 2_000, vocabulary: int = 30_000) -> Model:
    """A model from ``docs(doc_id, text, lang)``; rows without a language are left out.

    Fitted on a bounded sample of labelled rows: of each language about ``per_language``
    documents, chosen by the hash of their ids (all, if there are no more). The model holds at
    most ``vocabulary`` words and as many n-grams of each language, which bounds what reaches
    the driver and the workers. Priors count all labelled rows. An empty table gives a model
    without languages.
    """
    spark = docs.sparkSession
    ship_package(spark)
    labelled = docs.filter(F.col("lang").isNotNull())
    prior = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(prior)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, per_language / prior[lang])).otherwise(share)
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(PLACES)) / PLACES
    sample = labelled.filter(place < share).select("lang", "text")
    schema = "lang string, gram string, n long"
    words = stored(sample.mapInPandas(counted, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-words")
    grams = words.mapInPandas(gram_counts, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    word_at, word_logs = frequencies(most_frequent(words, vocabulary).toPandas(), langs, False)
    gram_at, gram_logs = frequencies(most_frequent(grams, vocabulary).toPandas(), langs, True)
    total = sum(prior.values())
    return Model(langs, np.log([prior[x] / total for x in langs]), word_at, gram_at, word_logs, gram_logs)


def backed_off(model: Model, word: str) -> np.ndarray:
    """Log frequencies of an unseen word: the mean over its known n-grams of the greatest
    length that has any; nothing if no length has."""
    for n in range(LONGEST, 0, -1):
        found = [i for i in map(model.grams.get, grams_of(word, n)) if i is not None]
        if found:
            return model.gram_logs[found].mean(axis=0)
    return np.zeros(len(model.langs), np.float32)


class Predictor:
    """Scores texts with a model; remembers what unseen words scored, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.unseen = model, {}

    def of(self, text: str | None) -> tuple[str, float]:
        model = self.model
        words = Counter(word_list(text))
        if not words or not model.langs:
            return UNKNOWN, 0.0
        total = model.prior.copy()
        known, times = [], []
        for word, n in words.items():
            at = model.words.get(word)
            if at is None:
                logs = self.unseen.get(word)
                if logs is None:
                    if len(self.unseen) >= REMEMBERED:
                        self.unseen.clear()
                    logs = self.unseen[word] = backed_off(model, word)
                total += n * logs
            else:
                known.append(at)
                times.append(n)
        if known:
            total += np.array(times, float) @ model.word_logs[known]
        best = int(total.argmax())
        return model.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    The language is that of the greatest sum of log frequencies over all words of the whole
    text, priors included; equal sums go to the language that comes first. Score is the
    posterior, 0 to 1. A null text, an empty one or one without letters gets ``und`` and 0.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for texts in batches:
            yield pd.DataFrame([predictor.of(t) for t in texts], columns=["lang_pred", "score"])

    told = docs.withColumn("_llm_language", language("text"))
    return told.withColumns({"lang_pred": F.col("_llm_language.lang_pred"), "score": F.col("_llm_language.score")}).drop("_llm_language")
