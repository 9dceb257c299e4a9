"""Metrics of rankings and predictions.  An undefined ratio is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.functions.text import ARABIC_DIGITS, LATIN_DIGITS, PERSIAN_DIGITS


def rank_of_any(results: Column, wanted: Column) -> Column:
    """1-based place of the first result that is wanted, counting distinct results only; null if none is."""
    distinct = F.array_distinct(results)
    places = F.filter(F.transform(wanted, lambda w: F.array_position(distinct, w)), lambda p: p > 0)
    return F.array_min(places)


def recall_at(rank: Column, k: int) -> Column:
    """Aggregate: the share of rows with a rank up to k; a null rank is a miss; null over no rows."""
    return F.avg(F.coalesce(rank <= k, F.lit(False)).cast("double"))


def mrr(rank: Column) -> Column:
    """Aggregate: mean reciprocal rank; a null rank counts as 0; null over no rows."""
    return F.avg(F.coalesce(1.0 / rank, F.lit(0.0)))


def split_ids(c: Column) -> Column:
    """A list of IDs written with semicolons: digits of other scripts in Latin, parts trimmed."""
    folded = F.translate(c, PERSIAN_DIGITS + ARABIC_DIGITS, LATIN_DIGITS * 2)
    return F.transform(F.split(folded, ";"), lambda x: F.trim(x))


def golden_reason(text: Column, ids: Column, tier: Column) -> Column:
    """Why a row of an evaluation set cannot be used; null if it can.  The first that applies."""
    parts = split_ids(F.coalesce(ids, F.lit("")))
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_query")
        .when(~F.coalesce(tier, F.lit("")).isin("S", "C"), "bad_tier")
        .when(~F.forall(parts, lambda x: x.rlike(r"\A[0-9]{13}\z")), "bad_id")
        .when(F.size(F.array_distinct(parts)) < F.size(parts), "duplicate_id")
        .when((tier == "S") & (F.size(parts) > 1), "multi_id_tier_s")
    )


def silver_tag(notes: Column) -> Column:
    """Whether a note marks a machine-made row."""
    return F.coalesce(notes.rlike(r"\Asilver(-[a-z0-9]+)*\|"), F.lit(False))


def tier_metrics(ranks: DataFrame, tier: str = "tier", rank: str = "rank") -> DataFrame:
    """``(tier, n, recall_1, recall_5, mrr)`` for each tier and combined."""
    out = ranks.groupingSets([[F.col(tier)], []], F.col(tier)).agg(F.count(F.lit(1)).alias("n"), recall_at(F.col(rank), 1).alias("recall_1"), recall_at(F.col(rank), 5).alias("recall_5"), mrr(F.col(rank)).alias("mrr"), F.grouping(tier).alias("g"))
    return out.select(F.when(F.col("g") == 1, "combined").otherwise(F.col(tier)).alias("tier"), "n", "recall_1", "recall_5", "mrr")


def exit_status(silver: Column, n: Column, recall: Column, least: int = 60, bar: float = 0.85) -> Column:
    """Whether a measured tier meets its bar; a machine-made set never does or does not."""
    return F.when(silver, "not_applicable").when(n < least, "not_yet_measurable").when(recall >= bar, "met").otherwise("not_met")


def confusion(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(code, tp, fp, fn, precision, recall)`` of two arrays of codes a row, rounded to 4 places."""
    truth_c, predicted_c = F.coalesce(F.col(truth), F.array()), F.coalesce(F.col(predicted), F.array())
    codes = pairs.select(F.explode(F.array_union(truth_c, predicted_c)).alias("code"), truth_c.alias("t"), predicted_c.alias("p"))
    t, p = F.array_contains("t", F.col("code")), F.array_contains("p", F.col("code"))
    by = codes.groupBy("code").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    ratio = lambda a, b: F.bround(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    return by.select("code", "tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))


def macro_micro(rows: DataFrame, slices: list[str], pair: str, value: Column) -> DataFrame:
    """``(<slices>, n_pairs, n, macro, micro)``: the mean over pairs of their means, and over all rows."""
    by_pair = rows.groupBy(*slices, pair).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return by_pair.groupBy(*slices).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("n").alias("n"), F.avg("m").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def random_hit(label: Column, n: Column, k: int) -> Column:
    """The chance that k results drawn from n without repetition hold one of ``label`` good ones."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(n - label - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    return F.lit(1.0) - miss


def nearest_rank(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row with the value whose place is round-half-even(q * (n - 1)): found by counting distinct values, never by
    collecting them, so no task holds all values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    if not total:
        return df.select(F.lit(None).cast(df.schema[value].dataType).alias(value)).limit(0)
    place = round(q * (total - 1))
    return distinct_at(counts, value, place)


def distinct_at(counts: DataFrame, value: str, place: int) -> DataFrame:
    """The value at a 0-based place of the sorted multiset given as distinct values with counts ``n``: ranges of values are counted
    first, then only the range with the place is ordered."""
    ranged = counts.select(value, "n").repartitionByRange(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), value)
    tagged = ranged.withColumn("part", F.spark_partition_id())
    sizes = sorted((r.part, r.n, r.lo) for r in tagged.groupBy("part").agg(F.sum("n").alias("n"), F.min(value).alias("lo")).collect())
    before = 0
    for i, (_, n, lo) in enumerate(sizes):
        if place < before + n:
            hi = sizes[i + 1][2] if i + 1 < len(sizes) else None
            inside = counts.where((F.col(value) >= F.lit(lo)) & (F.lit(True) if hi is None else F.col(value) < F.lit(hi)))
            run = F.sum("n").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
            return inside.select(value, run.alias("upto")).where(F.col("upto") > place - before).orderBy(value).limit(1).select(value)
        before += n
    raise ValueError("no such place")


def summary_by(rows: DataFrame, label: str, value: str) -> DataFrame:
    """``(label, n, mean, least, greatest)`` of a number; a label without values has n = 0 and nulls."""
    return rows.groupBy(label).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
