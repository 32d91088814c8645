"""Quality by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import held_out
from folioframe.session import ship_package

WORD_SLOTS, SOURCE_SLOTS, LANG_SLOTS, SIZE_SLOTS = 256, 64, 16, 24
STATS = 14
TEXT_WIDTH, META_WIDTH = STATS + WORD_SLOTS + 1, SOURCE_SLOTS + LANG_SLOTS + SIZE_SLOTS + 1
UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = bytes(set(range(33, 127)) - set(UPPER) - set(DIGIT) - set(range(97, 123)))
PLACES = 1 << 30
VIEWS = ("text", "meta")


def text_features(text: str | None) -> np.ndarray:
    """The content view: shape of the whole text, then its hashed words."""
    out = np.zeros(TEXT_WIDTH, np.float32)
    out[-1] = 1
    if not text:
        return out
    data = text.encode()
    counts = Counter(data.split())
    total, size = sum(counts.values()), len(data)
    if not total:
        return out
    without = lambda chars: 1 - len(data.translate(None, chars)) / size
    lines = [x for x in data.split(b"\n") if x]
    times = sorted(counts.values(), reverse=True)
    marked = sum(n for w, n in counts.items() if w[-1] in MARKS)
    doubled = sum(n for w, n in counts.items() if len(w) > 1 and w[-1] in MARKS and w[-2] in MARKS)
    shouted = sum(n for w, n in counts.items() if len(w) > 2 and w == w.upper() and w.translate(None, UPPER + MARKS) != w)
    out[:STATS] = (
        math.log1p(total) / 10, size / total / 10, without(UPPER) * 5, without(DIGIT) * 5, without(MARKS) * 5, len(counts) / total,
        times[0] / total, sum(times[:5]) / total, marked / total, doubled / total, shouted / total, len(set(lines)) / max(1, len(lines)),
        math.log1p(total / max(1, len(lines))) / 5, sum(n for w, n in counts.items() if not w.translate(None, MARKS)) / total)
    slots = np.fromiter((zlib.crc32(w) % WORD_SLOTS for w in counts), np.int64, len(counts))
    words = np.bincount(slots, weights=np.fromiter(counts.values(), float, len(counts)), minlength=WORD_SLOTS)
    out[STATS:-1] = np.sqrt(words / total)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """The metadata view: source, language and size as single marks; null is a value."""
    out = np.zeros(META_WIDTH, np.float32)
    out[-1] = 1
    out[zlib.crc32(str(source).encode()) % SOURCE_SLOTS] = 1
    out[SOURCE_SLOTS + zlib.crc32(str(lang).encode()) % LANG_SLOTS] = 1
    known = n_chars is not None and n_chars == n_chars and n_chars > 0
    out[SOURCE_SLOTS + LANG_SLOTS + (min(SIZE_SLOTS - 1, 1 + int(math.log2(n_chars))) if known else 0)] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    x = x.astype(float)
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass(frozen=True)
class Model:
    """Weights of the views, their calibration (slope, offset) and of the combination."""

    views: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]
    combination: np.ndarray

    def scores(self, features: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of either view, and of both."""
        single = [sigmoid(c[0] * (x @ w) + c[1]) for x, w, c in zip(features, self.views, self.calibration, strict=True)]
        a, b, c = self.combination
        return *single, sigmoid(a * logit(single[0]) + b * logit(single[1]) + c)


def co_train(
    features: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = 5,
    certain: float = 0.95, each: int = 500,
) -> Model:
    """Fit both views on labelled rows, then let each label pool rows for the other.

    A fifth of the labelled rows calibrates. In a round each view names up to ``each`` rows of
    either class of which it is ``certain``, the surest first; they join the other's training
    rows. With one class only, or no rows, all scores are that class's share.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2 or len(y) < 20:
        flat = tuple(np.zeros(x.shape[1]) for x in features)
        only = np.array([1.0, float(logit(share))])
        return Model(flat, (only, only), np.array([1.0, 0.0, 0.0]))
    tuning = np.arange(len(y)) % 5 == 0
    rows = [[x[~tuning]] for x in features]
    said = [[y[~tuning].astype(float)] for _ in features]
    free = [np.ones(len(x), bool) for x in pool]
    for turn in range(rounds + 1):
        weights = [fit(np.concatenate(x), np.concatenate(t)) for x, t in zip(rows, said, strict=True)]
        if turn == rounds or not len(pool[0]):
            break
        for view, other in ((0, 1), (1, 0)):
            p = sigmoid(pool[view] @ weights[view])
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                chosen = np.flatnonzero((sure >= certain) & free[other])
                chosen = chosen[np.argsort(-sure[chosen], kind="stable")][:each]
                free[other][chosen] = False
                rows[other].append(pool[other][chosen])
                said[other].append(np.full(len(chosen), label))
    calibration = []
    for x, w in zip(features, weights, strict=True):
        raw = (x[tuning] @ w).astype(float)
        calibration.append(fit(np.stack([raw, np.ones_like(raw)], axis=1), y[tuning].astype(float), 0.1))
    single = [logit(sigmoid(c[0] * (x[tuning] @ w) + c[1])) for x, w, c in zip(features, weights, calibration, strict=True)]
    both = fit(np.stack([*single, np.ones(len(single[0]))], axis=1), y[tuning].astype(float), 0.1)
    return Model(tuple(weights), tuple(calibration), both)


def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({
            "doc_id": rows["doc_id"], "quality": rows["quality"], "text": [text_features(t) for t in rows["text"]],
            "meta": [meta_features(*r) for r in zip(rows["source"], rows["lang"], rows["n_chars"], strict=True)]})


def train(docs: DataFrame, labels: DataFrame, labelled: int = 10_000, unlabelled: int = 10_000) -> Model:
    """A model from ``labels(doc_id, quality)`` and documents of ``docs``.

    Fitted on bounded samples, chosen by the hash of the id: about ``labelled`` labelled rows
    and ``unlabelled`` documents without label. Null labels and ids are left out; of several
    labels of one document the smallest counts.
    """
    ship_package(docs.sparkSession)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("cotrain")), F.lit(PLACES)) / PLACES
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    n_told, n_docs = told.count(), docs.count()
    some = told.filter(place < min(1.0, labelled / max(1, n_told))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    columns = ["doc_id", "text", "source", "lang", "n_chars"]
    # Each of the two small sides holds ids of about ``labelled`` rows.
    known = docs.select(*columns).join(F.broadcast(some), "doc_id").select(*columns, "quality")
    others = docs.select(*columns).filter(place < min(1.0, unlabelled / max(1, n_docs))).join(
        F.broadcast(some.select("doc_id")), "doc_id", "left_anti").withColumn("quality", F.lit(None).cast("double"))
    schema = "doc_id long, quality double, text array<float>, meta array<float>"
    rows = known.unionByName(others).mapInPandas(featured, schema).orderBy("doc_id").toPandas()

    def matrices(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        wide = zip(VIEWS, (TEXT_WIDTH, META_WIDTH), strict=True)
        return tuple(np.stack(part[v].tolist()).astype(np.float32) if len(part) else np.zeros((0, n), np.float32) for v, n in wide)

    given = rows["quality"].notna()
    return co_train(matrices(rows[given]), rows["quality"][given].to_numpy(float), matrices(rows[~given]))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``text_score``, ``meta_score``, ``score`` (0 to 1) and ``keep`` (0.5 or more).

    Reads text, source, lang and n_chars, whole texts each. Nulls are values of their own; a
    text that is null, empty or blank has no shape and is judged by its metadata and the mean.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<text_score: double, meta_score: double, score: double>")
    def judged(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for text, source, lang, size in batches:
            if not len(text):
                yield pd.DataFrame({"text_score": [], "meta_score": [], "score": []}, dtype=float)
                continue
            views = np.stack([text_features(t) for t in text]), np.stack([meta_features(*r) for r in zip(source, lang, size, strict=True)])
            yield pd.DataFrame(dict(zip(("text_score", "meta_score", "score"), shared.value.scores(views), strict=True)))

    told = docs.withColumn("_llm_quality", judged("text", "source", "lang", "n_chars"))
    told = told.withColumns({x: F.col(f"_llm_quality.{x}") for x in ("text_score", "meta_score", "score")})
    return told.withColumn("keep", F.col("score") >= 0.5).drop("_llm_quality")


def quality(docs: DataFrame, labels: DataFrame, parts: int = 4) -> DataFrame:
    """Train on the labels of documents that are not held out; judge all documents."""
    model = train(docs, labels.filter(~held_out("doc_id", parts)))
    judged = judge(docs.select("doc_id", "text", "source", "lang", "n_chars"), model)
    return judged.select("doc_id", held_out("doc_id", parts).alias("held_out"), "text_score", "meta_score", "score", "keep")
