"""The training-data pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import langid, mixture, simhash, token_frames, winnow
from folioframe.llm.common import free, held_out, made, stored, table
from folioframe.llm.queries import tokenizer_file

#: A document whose language is less certain than this goes, as does one without letters.
LEAST_CERTAIN = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_former: list[str] = []


def staged(stage: Stage) -> Stage:
    """``stage``, which first frees what the stage before it has written for itself.

    A stage's result is stored before the next one starts, so nothing reads those folders.
    """
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free(spark, _former)
        before = set(made)
        out = stage(spark, docs, sf_dir)
        _former[:] = [path for path in made if path not in before]
        return out

    return run_stage


@staged
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; it learns from the given labels as the query does."""
    model = langid.train(docs.filter(~held_out("doc_id", 4)))
    told = langid.predict(docs, model)
    kept = told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN))
    return kept.select(*docs.columns)


@staged
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


@staged
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources asks for, in random order."""
    return mixture.mix(docs).select(*docs.columns)


@staged
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; one row per document read back from them."""
    read = token_frames.token_frames(docs, tokenizer_file())
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixture", mix_sources),
    ("token_frames", write_tokens),
]

#: Language models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
