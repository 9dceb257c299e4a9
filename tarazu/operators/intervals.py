"""Continuous periods and gaps of overlapping, nested or gapped intervals, per entity.

Method: starts and ends are ranked independently of each other.  The entity's k-th end closes a period exactly if the
(k+1)-th start lies beyond it; that start opens the next one.  Ranks are kept as running counts per (entity, day), so an
entity with any number of intervals needs no more rows than it has distinct boundary days: the counts are aggregated before
the shuffle, and no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Day that stands for an open end; later than any day of the calendar.
OPEN = 2_000_000_000


def periods_and_gaps(df: DataFrame, entity: str, start: Column, last: Column, at_least: int = 1) -> DataFrame:
    """``(entity, kind, d_from, d_to)``: ``period`` for every maximal stretch of covered days, ``gap`` for every stretch
    of uncovered days between two of them.  Days are integers; ``d_to`` is null for a period without an end.

    ``start`` and ``last``: first and last covered day; a null ``last`` is open.  Intervals that touch on consecutive days are
    one period.  Rows with a null entity or start, or that end before they start, cover nothing and are left out.
    ``at_least`` = 2 keeps only entities with two or more distinct intervals.  Repeated rows change nothing, other columns of
    ``df`` are not read, and an empty table gives an empty result.
    """
    given = df.select(F.col(entity).alias("__e"), start.cast("int").alias("__s"), (F.coalesce(last, F.lit(OPEN - 1)) + 1).cast("int").alias("__x"))
    given = given.where("__e IS NOT NULL AND __s IS NOT NULL AND __s < __x")
    marks = F.explode(F.array(*(F.struct(F.col(c).alias("d"), F.lit(a).alias("s"), F.lit(b).alias("x")) for c, a, b in (("__s", 1, 0), ("__x", 0, 1)))))
    days = given.select("__e", marks.alias("m")).groupBy("__e", "m.d").agg(F.sum("m.s").alias("n_s"), F.sum("m.x").alias("n_x"))
    whole = W.partitionBy("__e")
    run = whole.orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    ranked = days.select(
        "__e",
        "d",
        F.sum("n_s").over(run).alias("rank_s"),  # starts up to and on this day
        F.sum("n_x").over(run).alias("rank_x"),  # intervals over before this day
        F.lead("d").over(whole.orderBy("d")).alias("next_start"),
        F.min(F.when(F.col("n_s") > 0, F.col("d"))).over(whole).alias("s_lo"),
        F.max(F.when(F.col("n_s") > 0, F.col("d"))).over(whole).alias("s_hi"),
        F.min(F.when(F.col("n_x") > 0, F.col("d"))).over(whole).alias("x_lo"),
        F.max(F.when(F.col("n_x") > 0, F.col("d"))).over(whole).alias("x_hi"),
        (F.coalesce(F.lag("d").over(whole.orderBy("d")).isNull(), F.lit(True))).alias("first"),
    )
    if at_least > 1:  # two distinct intervals differ in a start or in an end
        ranked = ranked.where("s_lo <> s_hi OR x_lo <> x_hi")
    # A closing day: every start so far has ended, so the next-ranked start is beyond the current-ranked end.
    edges = ranked.where("first OR rank_s = rank_x")
    opened = F.when(F.col("first"), F.col("d")).otherwise(F.col("next_start"))
    order = whole.orderBy("d")
    paired = edges.select("__e", opened.alias("from"), F.lead("d").over(order).alias("to_x"), F.lag("d").over(order).alias("prev"), "d", "first")
    period = F.struct(F.lit("period").alias("kind"), F.col("from").alias("d_from"), F.when(F.col("to_x") < OPEN, F.col("to_x") - 1).alias("d_to"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("d").alias("d_from"), (F.col("from") - 1).alias("d_to"))
    out = F.when(F.col("first"), F.array(period)).otherwise(F.array(period, gap))
    return paired.where("from IS NOT NULL").select(F.col("__e").alias(entity), F.explode(out).alias("o")).select(entity, "o.*")
