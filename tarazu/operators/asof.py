"""Each event with the version of its entity that was in force at the event's time.

Method: events and versions are co-grouped by entity and a vectorised binary search over each entity's sorted
boundaries finds the version.  Entities share groups (a hash bucket of about ``GROUP_ROWS`` events and versions), as a Python call for
each entity would cost more than the search; a hot entity is spread over several groups and its versions are repeated in each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarazu.operators.skew import salted
from tarazu.session import stage_table

#: Events and versions in one co-group, about.
GROUP_ROWS = 40_000
_FOREVER = 2_000_000_000


def _segments(code: np.ndarray, start: np.ndarray, end: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted boundaries ``(code, day)`` and the index of the version that counts from each on, or -1.

    The versions of a code come in ascending order of preference.  A version can be used from ``max(start, known)`` to ``end``.
    """
    codes, days, wins = [], [], []
    cut = np.flatnonzero(np.diff(code)) + 1
    begin = np.maximum(start, known)
    for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(code)]):
        if lo == hi:
            continue
        c = code[lo]
        if hi - lo == 1:
            codes += (c, c)
            days += (begin[lo], end[lo] + 1)
            wins += (lo, -1) if begin[lo] <= end[lo] else (-1, -1)
            continue
        opens: dict[int, list[int]] = {}
        for i in range(lo, hi):
            if begin[i] <= end[i]:
                opens.setdefault(int(begin[i]), []).append(i)
        live: list[int] = []  # negated indexes: the most preferred version first
        for day in sorted({*opens, *(int(e) + 1 for e in end[lo:hi])}):
            for i in opens.get(day, ()):
                heapq.heappush(live, -i)
            while live and end[-live[0]] < day:
                heapq.heappop(live)
            codes.append(c)
            days.append(day)
            wins.append(-live[0] if live else -1)
    return np.asarray(codes, np.int64), np.asarray(days, np.int64), np.asarray(wins, np.int64)


def _lookup(events: pa.Table, versions: pa.Table, keep: list[str], out: pa.Schema, left: bool) -> pa.Table:
    n = events.num_rows
    hit = np.full(n, -1, np.int64)
    order = np.empty(0, np.int64)
    if n and versions.num_rows:
        ids = pc.unique(versions["__e"].combine_chunks())
        v_code = pc.index_in(versions["__e"], value_set=ids).to_numpy().astype(np.int64)
        e_code = pc.fill_null(pc.index_in(events["__e"], value_set=ids), -1).to_numpy().astype(np.int64)
        start, end, known = (versions[c].to_numpy().astype(np.int64) for c in ("__from", "__to", "__known"))
        order = np.lexsort((versions["__pref"].to_numpy(), start, v_code))
        code, day, win = _segments(v_code[order], start[order], end[order], known[order])
        at = np.searchsorted((code << 33) + day, (e_code << 33) + events["__at"].to_numpy().astype(np.int64), "right") - 1
        found = (at >= 0) & (e_code >= 0)
        found[found] = code[at[found]] == e_code[found]
        hit[found] = win[at[found]]
    if not left:
        events = events.filter(pa.array(hit >= 0))
        hit = hit[hit >= 0]
    take = pa.array(order[hit] if len(order) else np.zeros(len(hit), np.int64), mask=hit < 0)
    columns = [events[f.name] for f in out if f.name in events.column_names and f.name not in keep]
    got = [versions[c].take(take) if versions.num_rows else pa.nulls(len(hit), out.field(c).type) for c in keep]
    return pa.table([c.cast(f.type) for c, f in zip([*columns, *got], out)], schema=out)


def as_known_at(
    events: DataFrame,
    versions: DataFrame,
    *,
    entity: str,
    at: Column,
    version_entity: str,
    valid_from: Column,
    valid_to: Column,
    prefer: list[Column],
    carry: dict[str, Column],
    attributes: dict[str, Column],
    known_from: Column | None = None,
    how: str = "inner",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(<carry>, <attributes>)``: each event with the version that holds at its time.

    Days are integers; ``valid_to`` is the last day, inclusive, null if open.  Of the versions that hold, the one with the
    latest ``valid_from`` counts, then the smallest ``prefer`` (ascending, nulls last; end it with a unique number).
    ``known_from``: the day a version was recorded; an event never gets a version recorded after it.  Without it, versions count as
    recorded at all times.
    ``carry`` and ``attributes`` name the result's columns, so columns of the same name on both sides cannot clash.
    ``how`` = left keeps events without a version, also those with a null entity or time; inner drops them.  Repeated
    events give repeated rows.  Either table may be empty.
    """
    if set(carry) & set(attributes):
        raise ValueError(f"the result would have columns twice: {sorted(set(carry) & set(attributes))}")
    e = events.select(F.col(entity).alias("__e"), at.cast("int").alias("__at"), *(c.alias(k) for k, c in carry.items()))
    lost = e.where("__e IS NULL OR __at IS NULL")
    e = e.where("__e IS NOT NULL AND __at IS NOT NULL")
    known = F.lit(-_FOREVER) if known_from is None else known_from.cast("int")
    v = versions.select(
        F.col(version_entity).alias("__e"),
        valid_from.cast("int").alias("__from"),
        F.coalesce(valid_to, F.lit(_FOREVER)).cast("int").alias("__to"),
        known.alias("__known"),
        *(c.alias(f"__p{i}") for i, c in enumerate(prefer)),
        *(c.alias(f"__v_{k}") for k, c in attributes.items()),
    ).where("__e IS NOT NULL AND __from <= __to AND __known IS NOT NULL")
    # Versions that differ in nothing but preference never count: they go before the shuffle, so that what is left of a hot
    # entity is at most its distinct periods.
    ranks = [F.struct(F.col(f"__p{i}").isNull().alias("n"), F.col(f"__p{i}").alias("v")) for i in range(len(prefer))]
    best = F.min(F.struct(*(r.alias(f"r{i}") for i, r in enumerate(ranks)), *(F.col(f"__v_{k}").alias(k) for k in attributes)))
    v = v.groupBy("__e", "__from", "__to", "__known").agg(best.alias("b"))

    # Versions of entities without events take no part.  The others are counted with the events: a group is about so large on both sides.
    v = stage_table(v.join(e.select("__e").distinct(), "__e", "left_semi"), "versions")
    parts = max(1, -(-(e.count() + v.count()) // group_rows))
    # A key with more than an eighth of a group is spread: its parts come on top of what else hashes to their group.
    left, right = salted(e, v, ["__e"], [F.col("__at"), *(F.col(k) for k in carry)], max(1, group_rows // 8))
    bucket = F.pmod(F.xxhash64("__e"), F.lit(parts)).cast("int").alias("__bucket")
    left = left.select("__e", "__at", *carry, bucket, "__salt")
    # The order of preference within one day, as a number: the search needs no other column of it.
    right = right.select("__e", "__from", "__to", "__known", *(F.col(f"b.{k}").alias(k) for k in attributes), bucket, "__salt", "b")
    worst_first = [F.col(f"b.r{i}").desc() for i in range(len(prefer))] or [F.lit(0)]
    right = right.repartition("__bucket", "__salt")  # the window below and the co-group share this shuffle
    right = right.withColumn("__pref", F.row_number().over(W.partitionBy("__bucket", "__salt", "__e", "__from").orderBy(*worst_first)).cast("long")).drop("b")

    schema = T.StructType([*(T.StructField(k, left.schema[k].dataType) for k in carry), *(T.StructField(k, right.schema[k].dataType) for k in attributes)])
    arrow, keep, outer = to_arrow_schema(schema), list(attributes), how == "left"

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        return _lookup(a, b, keep, arrow, outer)

    keys = ["__bucket", "__salt"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
    if outer:
        found = found.unionByName(lost.select(*carry, *(F.lit(None).cast(schema[k].dataType).alias(k) for k in attributes)))
    return found
