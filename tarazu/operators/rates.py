"""The version of an ID on a day, with an explicit status instead of a guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.functions import jalali
from tarazu.operators.asof import as_known_at

#: A day number before all days of the calendar.
_BEFORE_ALL = -1_000_000


def rate_at(lines: DataFrame, versions: DataFrame, status: DataFrame | None, *, key: str = "line_id", sstid: str = "sstid", day: str = "issue_date") -> DataFrame:
    """``(key, sstid, day, status, rate, valid_from, n_candidates, candidates)`` for each distinct line.

    status is OK, AMBIGUOUS (several versions with the same latest start hold: no rate, all of them in ``candidates``), NOT_IN_FORCE,
    QUARANTINED_ONLY, NOT_IN_CATALOG (also for a null ID) or INVALID_DATE.  ``status``: one row an ID as of
    :func:`tarazu.operators.catalog.id_status`; without it, the IDs of ``versions`` are the known ones.
    The versions of one ID and start are put together before the lookup, so a line meets one row, whatever an ID's history is.
    """
    held = F.struct(F.coalesce("valid_to", F.lit("9999-99-99")).alias("to"), F.col("rate"), F.col("title"))
    starts = versions.groupBy("sstid", "valid_from").agg(F.sort_array(F.collect_set(held)).alias("held"))
    # The last day on which any of them holds; open if one is.
    last = F.array_max(F.transform("held", lambda h: h["to"]))
    known = starts.select("sstid", "valid_from", "held", jalali.to_days(F.col("valid_from")).alias("from"), F.when(last != "9999-99-99", jalali.to_days(last) - 1).alias("last"), F.lit(None).cast("string").alias("else"))
    # Each known ID has one more version, before all others and without an end: it answers where none of them does, and says why.
    if status is None:
        status = versions.select("sstid", F.lit(True).alias("is_active")).distinct()
    why = F.when(F.col("is_active"), "NOT_IN_FORCE").otherwise("QUARANTINED_ONLY")
    always = status.select("sstid", F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast(known.schema["held"].dataType).alias("held"), F.lit(_BEFORE_ALL).alias("from"), F.lit(None).cast("int").alias("last"), why.alias("else"))
    asked = lines.select(key, sstid, day).distinct()
    found = as_known_at(
        asked,
        known.unionByName(always),
        entity=sstid,
        at=jalali.to_days(F.col(day)),
        version_entity="sstid",
        valid_from=F.col("from"),
        valid_to=F.col("last"),
        prefer=[],
        carry={key: F.col(key), sstid: F.col(sstid), day: F.col(day)},
        attributes={"valid_from": F.col("valid_from"), "held": F.col("held"), "else": F.col("else")},
        how="left",
    )
    holding = F.filter("held", lambda h: F.col(day) < h["to"])
    found = found.withColumn("candidates", F.coalesce(holding, F.array().cast(found.schema["held"].dataType))).drop("held")
    n = F.size("candidates")
    code = F.when(~jalali.is_day(F.col(day)), "INVALID_DATE").when(n == 1, "OK").when(n > 1, "AMBIGUOUS").otherwise(F.coalesce("else", F.lit("NOT_IN_CATALOG")))
    first = F.try_element_at("candidates", F.lit(1))
    return found.select(key, sstid, day, code.alias("status"), F.when(n == 1, first["rate"]).alias("rate"), F.when(n > 0, F.col("valid_from")).alias("valid_from"), n.alias("n_candidates"), "candidates")


def line_numbers(c: dict[str, Column] | None = None) -> dict[str, Column]:
    """A line's ``am``, ``fee``, ``vra`` and ``vam`` as exact decimals; null unless plain, not negative and of its type without rounding."""
    col = lambda k: (c or {}).get(k, F.col(k))
    number = r"\A[0-9]{1,14}(?:\.[0-9]{1,%d})?\z"
    whole = {"am": ("decimal(20,6)", 6), "fee": ("decimal(20,6)", 6), "vra": ("decimal(9,4)", 4), "vam": ("decimal(20,6)", 6)}
    good = {k: F.coalesce(col(k).rlike(number % n), F.lit(False)) & (F.length(F.regexp_extract(col(k), r"\A[0-9]*", 0)) <= (5 if k == "vra" else 14)) for k, (_, n) in whole.items()}
    return {k: F.when(good[k], col(k).try_cast(t)) for k, (t, _) in whole.items()}


def parse_line(c: dict[str, Column] | None = None) -> Column:
    """A struct with a line's numbers as exact decimals, its ID trimmed, and the first thing that is wrong with it (null if nothing).

    A number must be plain, not negative and fit its type without rounding.
    """
    col = lambda k: (c or {}).get(k, F.col(k))
    value = line_numbers(c)
    error = F.when(~jalali.is_day(col("issue_date")), "issue_date").when(F.coalesce(F.trim(col("sstid")), F.lit("")) == "", "sstid")
    for k in value:
        error = error.when(value[k].isNull(), k)
    return F.struct(F.trim(col("sstid")).alias("sstid"), *(value[k].alias(k) for k in value), (value["am"] * value["fee"]).alias("base"), error.alias("error"))


def percent_of(am: Column, fee: Column, vra: Column) -> Column:
    """A struct ``(half_up, down, up)``: ``am * fee * vra / 100`` of numbers as :func:`line_numbers` gives them, exact, rounded three ways to a
    whole number (``decimal(32,0)``); nulls if one of them is null.

    The product may have 31 digits before the point and 18 after it, more than a decimal holds: it is made of two parts, and only its whole
    part and what decides the rounding are kept.
    """
    whole = lambda c, n: c.cast(f"decimal({n},0)")
    units = lambda c, scale, n: whole(c * F.lit(10**scale), n)

    def cut(c: Column, digits: int) -> tuple[Column, Column]:
        """What is before and in the last ``digits`` digits."""
        low = c % F.lit(10**digits).cast(f"decimal({digits + 1},0)")
        return whole((c - low) / F.lit(10**digits).cast(f"decimal({digits + 1},0)"), 32), low

    high, low = cut(whole(units(am, 6, 20) * units(vra, 4, 9), 29), 15)
    fees = units(fee, 6, 20)
    carried, rest = cut(whole(whole(low, 15) * fees, 35), 15)
    down, last = cut(whole(whole(whole(high, 14) * fees, 35) + carried, 35), 3)
    more = (last > 0) | (rest > 0)
    add = lambda c: whole(down + c.cast("int"), 32)
    return F.struct(add(last >= 500).alias("half_up"), down.alias("down"), add(more).alias("up"))
