"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.session import stage_table

#: Rows of one key from which it counts as hot, and rows of a part of it: well under what a task takes, so that a part fits beside others.
HOT_ROWS = 8_000

_SALTS, _SALT = "__salts", "__salt"


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``rows`` rows and the number of parts to cut each into.

    Counted with a partial aggregate before the shuffle, so the hot keys themselves move one row a task.  The limit is the same at every size of
    ``df``; the table has a row for each ``rows`` rows of ``df`` at most.
    """
    counted = df.where(_all_known(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    return counted.select(*keys, F.ceil(F.col("__n") / rows).cast("int").alias(_SALTS))


def _all_known(keys: list[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def salted(big: DataFrame, other: DataFrame, keys: list[str], spread: list[Column], rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``__salt``: rows of hot keys of ``big`` are spread by the hash of ``spread``, the
    rows of ``other`` for those keys repeated once a part.  All other keys keep salt 0, unrepeated.

    The table of hot keys is written first, so that it is joined by its real size: broadcast where it is small, else by a shuffle in which
    adaptive execution splits the hot keys."""
    hot = stage_table(hot_keys(big, keys, rows), "hot-keys")
    left = big.join(hot, keys, "left").withColumn(_SALT, F.coalesce(F.pmod(F.xxhash64(*spread), F.col(_SALTS)), F.lit(0)).cast("int")).drop(_SALTS)
    parts = F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)
    right = other.join(hot, keys, "left").withColumn(_SALT, F.explode(parts)).drop(_SALTS)
    return left, right


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], spread: list[Column], rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """Equi-join of ``big`` with ``other`` on ``keys`` with hot keys of ``big`` spread over tasks.

    ``how``: inner, left, left_semi or left_anti, seen from ``big``.  Rows of ``big`` with a null key match nothing:
    a left or left_anti join keeps them, the others drop them.
    """
    left, right = salted(big, other.where(_all_known(keys)), keys, spread, rows)
    return left.join(right, [*keys, _SALT], how).drop(_SALT)
