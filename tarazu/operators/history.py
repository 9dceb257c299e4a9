"""Full history of changing attributes, from periodic snapshots, sparse updates or late corrections.

Method: the events are a log for each attribute on its own.  An event may carry one attribute or several; of the events that carry an attribute
at one time the latest correction counts, and only those where its value changes begin an interval of it.  The intervals of all attributes are
combined by splitting them at the union of their boundaries and coalescing neighbours that do not differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def change_log(df: DataFrame, entity: str, at: Column, attributes: dict[str, Column], rank: list[Column], carried: dict[str, Column] | None = None) -> DataFrame:
    """``(__e, attribute, __at, value)``: for each attribute and time at which an event carries it the value of the greatest ``rank``; values as text.

    ``carried``: for each attribute whether an event says anything about it; without it every event carries all of them.  Aggregated before the
    shuffle, so that an entity has at most as many rows as it has distinct times and attributes, however many events it was delivered with."""
    said = carried or {}
    entries = F.array(*(F.struct(F.lit(k).alias("attribute"), c.cast("string").alias("value"), said.get(k, F.lit(True)).alias("said")) for k, c in attributes.items()))
    known = df.select(F.col(entity).alias("__e"), at.alias("__at"), F.struct(*(c.alias(f"r{i}") for i, c in enumerate(rank))).alias("r"), F.explode(entries).alias("p"))
    known = known.where("__e IS NOT NULL AND __at IS NOT NULL AND p.said")
    best = F.max(F.struct("r", F.col("p.value").alias("value"))).alias("b")
    return known.groupBy("__e", F.col("p.attribute").alias("attribute"), "__at").agg(best).select("__e", "attribute", "__at", "b.value")


def attribute_intervals(df: DataFrame, entity: str, at: Column, attributes: dict[str, Column], rank: list[Column], carried: dict[str, Column] | None = None) -> DataFrame:
    """``(entity, attribute, value, valid_from, valid_to)``: each attribute's own intervals; ``valid_to`` is exclusive, null for the
    last.  Values are given as text; a change to null begins an interval too."""
    w = W.partitionBy("__e", "attribute").orderBy("__at")
    changed = F.lag("__at").over(w).isNull() | ~F.lag("value").over(w).eqNullSafe(F.col("value"))
    log = change_log(df, entity, at, attributes, rank, carried)
    # One shuffle by entity serves this and whatever combines the attributes.
    log = log.repartition("__e").withColumn("c", changed).where("c")
    return log.select(F.col("__e").alias(entity), "attribute", "value", F.col("__at").alias("valid_from"), F.lead("__at").over(w).alias("valid_to"))


def combine_intervals(intervals: DataFrame, entity: str, attributes: list[str], at_least: int = 1) -> DataFrame:
    """``(entity, <attributes>, valid_from, valid_to)`` of intervals as :func:`attribute_intervals` gives them: split at the union of all boundaries, each
    attribute's value where its interval covers the piece (null where none does), pieces that do not differ joined."""
    w = W.partitionBy("__e").orderBy("valid_from")
    # A boundary is where any attribute's interval begins; attributes that begin one there are put side by side.
    own = [F.max(F.when(F.col("attribute") == k, F.struct(F.col("value").alias("v")))).alias(k) for k in attributes]
    edges = intervals.select(F.col(entity).alias("__e"), "attribute", "value", "valid_from").groupBy("__e", "valid_from").agg(*own)
    # The intervals of an attribute follow one another without a gap: the one that covers a piece is the last that began.
    pieces = edges.select("__e", "valid_from", *(F.last(k, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))["v"].alias(k) for k in attributes))
    same = F.lit(True)
    for k in attributes:
        same = same & F.lag(k).over(w).eqNullSafe(F.col(k))
    versions = pieces.withColumn("__first", F.lag("valid_from").over(w).isNull()).withColumn("__keep", F.col("__first") | ~same).where("__keep")
    out = versions.select("__e", *attributes, "valid_from", F.lead("valid_from").over(w).alias("valid_to"), F.count(F.lit(1)).over(W.partitionBy("__e")).alias("__n"))
    return out.where(F.col("__n") >= at_least).select(F.col("__e").alias(entity), *attributes, "valid_from", "valid_to")


def attribute_history(df: DataFrame, entity: str, at: Column, attributes: dict[str, Column], rank: list[Column], at_least: int = 1, carried: dict[str, Column] | None = None) -> DataFrame:
    """``(entity, <attributes>, valid_from, valid_to)``: one row for each time the combination of the attributes held, from their own intervals.

    ``at``: the time an event takes effect; of several events for one (entity, at, attribute) the greatest ``rank`` counts (give the row's own
    number last for a total order).  ``carried``: which attributes an event says something about; an attribute it does not carry keeps its value.
    Nulls that are carried are values: a change to null starts a version; before its first event an attribute is null.  ``valid_to`` is exclusive and null
    for the last version.  Rows with a null entity or time are left out.  Attributes keep their types.  ``at_least`` = 2 keeps only entities with two
    versions or more.
    """
    types = df.select(*(c.alias(k) for k, c in attributes.items())).schema
    own = attribute_intervals(df.withColumn("__entity", F.col(entity)), "__entity", at, attributes, rank, carried)
    out = combine_intervals(own, "__entity", list(attributes), at_least)
    return out.select(F.col("__entity").alias(entity), *(F.col(k).cast(types[k].dataType).alias(k) for k in attributes), "valid_from", "valid_to")
