"""Score column expressions.

Scores are rounded before they are ranked or compared, so that ranks do not depend on the
order in which a shuffle happened to add numbers up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6


def r6(value: Column) -> Column:
    return F.round(value, PLACES)


def clamp01(value: Column) -> Column:
    """Into [0, 1]; null, NaN and infinities become 0."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom)


def top_k(df: DataFrame, group: str | list[str], k: int | Column | None, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group, all for None. Spark cuts each partition to ``k`` before the shuffle."""
    window = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)
