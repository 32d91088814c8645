"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.session import ship_package
from folioframe.sources.tables import Corpus

QUERIES: dict[str, Callable[[Corpus], DataFrame]] = {}
ORACLES: dict[str, tuple[str, tuple[str, ...]]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """Declare a shared subquery of the oracle SQL."""
    CTES[name] = (needs, body)


def with_ctes(body: str, *names: str) -> str:
    """``body`` under a WITH clause holding ``names`` and all they need, in order."""
    placed: list[str] = []

    def place(name: str) -> None:
        if name not in placed:
            for other in CTES[name][0]:
                place(other)
            placed.append(name)

    for name in names:
        place(name)
    if not placed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in placed) + "\n" + body


def query(name: str, sql: str | None = None, *needs: str):
    """Register a query; without ``sql`` it is checked by tests only."""
    def keep(fn: Callable[[Corpus], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (sql, needs)
        return fn

    return keep


_corpora: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, root: str) -> Corpus:
    """One Corpus per application and folder, so that shared views are built once."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _corpora:
        _corpora.clear()
        _corpora[key] = Corpus(spark, root)
    return _corpora[key]


def runner(fn: Callable[[Corpus], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(corpus(spark, sf_dir))

    return run


def forget() -> None:
    """Drop what shared views have kept, so that the next query starts from the tables."""
    _corpora.clear()
