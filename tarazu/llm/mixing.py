"""Sources combined to target shares of the total size.

Method: Poisson replication.  A document is used as often as a Poisson variable says that is inverted from a hash of the document's id and a seed,
cut off at the source's cap; the variable's mean is such that the mean after the cut is the source's repetition rate.  As a document's count never
falls when the mean rises, each source's mean is then tuned by what it realises: of a grid of means the one whose tokens come nearest to the source's
goal is taken, and a finer grid laid around it.  Documents are exploded by their count and shuffled globally by another hash.  A document's count
depends on nothing but its id, its source and the seed, so any part can be computed again and gives the same.

Goals, means and tuning are tables with a row for each source: there may be any number of sources.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarazu.llm.tokens import DEFAULT_FILE, count_tokens
from tarazu.session import stage_table

#: Steps of the grid that means are tuned over, and passes; steps of the grid that the common level is solved for with.
GRID, ROUNDS, LEVELS = 256, 3, 4096
#: As ``total``: the largest total at which every source reaches its share.
REACHABLE = "reachable"


@dataclass(frozen=True)
class Mixture:
    """``rows``: (document columns, copy_n, order_key), globally shuffled; ``shares``: one row for each source; ``total``: the size aimed at."""

    rows: DataFrame
    shares: DataFrame
    total: float


def below(mean: float, cap: int) -> np.ndarray:
    """P(Poisson(mean) <= k) for k = 0 .. cap - 1, from where it is above 0 to where nothing is left above."""
    if mean <= 0:
        return np.ones(min(cap, 1))
    wide = 40 * math.sqrt(mean) + 60
    k = np.arange(min(cap, int(mean + wide)), dtype=np.float64)
    first = np.exp(np.cumsum(np.r_[-mean, np.log(mean) - np.log(k[1:])])) if len(k) else k
    return np.minimum(np.cumsum(first), 1.0)


def cut_mean(mean: float, cap: int) -> float:
    """Mean of min(Poisson(mean), cap): the sum of P(X > k) for k below the cap."""
    return float((1.0 - below(mean, cap)).sum())


def poisson_mean(rate: float, cap: int) -> float:
    """The mean of the Poisson variable that is ``rate`` on average when it is cut off at ``cap``; infinite from the cap on."""
    if rate <= 0 or cap < 1:
        return 0.0
    if rate >= cap:
        return math.inf
    lo, hi = 0.0, max(1.0, float(cap))
    while cut_mean(hi, cap) < rate and hi < 1e9:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid, cap) < rate else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def _poisson_mean(rates: pd.Series, caps: pd.Series) -> pd.Series:
    return pd.Series([poisson_mean(r, int(c)) for r, c in zip(rates, caps)], dtype="float64")


def _uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def copies(u: Column, mean: Column, cap: Column) -> Column:
    """The Poisson variable with that mean at the quantile ``u``, cut off at ``cap``."""
    start = F.struct((-mean).alias("log_p"), F.lit(0.0).alias("below"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        below = acc["below"] + F.exp(acc["log_p"])
        return F.struct((acc["log_p"] + F.ln(mean) - F.ln(k + 1)).alias("log_p"), below.alias("below"), (acc["n"] + (u >= below).cast("int")).alias("n"))

    # Nothing is left above forty deviations: a cap may be of any size.
    finite = F.least(mean, F.lit(1e9))
    most = F.least((cap - 1).cast("long"), F.ceil(finite + 40 * F.sqrt(finite) + 60).cast("long"))
    drawn = F.aggregate(F.sequence(F.lit(0).cast("long"), most), start, step, lambda acc: acc["n"])
    return F.when((mean <= 0) | (cap < 1), 0).when(mean == math.inf, cap).otherwise(drawn)


def _level(plan: DataFrame, total: float) -> float:
    """The level L at which the sources together give ``total`` tokens, each the smaller of what its cap allows and its part of L; infinite if they cannot."""
    most, lo, hi = plan.agg(F.sum("most"), F.lit(total), F.max(F.col("most") / F.col("part"))).first()
    if most is None or most <= total:
        return math.inf
    while hi - lo > 1e-9 * hi:
        steps = plan.select("most", "part", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("j"))
        given = steps.withColumn("level", F.lit(lo) + F.lit((hi - lo) / LEVELS) * F.col("j")).groupBy("level").agg(F.sum(F.least("most", F.col("part") * F.col("level"))).alias("given"))
        lo, hi = given.agg(F.max(F.when(F.col("given") <= total, F.col("level"))), F.min(F.when(F.col("given") >= total, F.col("level")))).first()
        if lo is None or hi is None or lo >= hi:
            return hi if lo is None else lo
    return hi


def _curves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(source, j, tokens)``: what each source realises at each step of its grid, summed up over a task's documents."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for source, own in batch.groupby("source"):
            lo, hi, cap = own["lo"].iloc[0], own["hi"].iloc[0], int(own["max_repeats"].iloc[0])
            order = np.argsort(own["u"].to_numpy(), kind="stable")
            u, tokens = own["u"].to_numpy()[order], own["n_tokens"].to_numpy()[order]
            above = np.r_[0, np.cumsum(tokens[::-1])][::-1]  # tokens of the documents from a place in this order on
            got = sums.setdefault(source, np.zeros(GRID + 1, np.int64))
            for j, mean in enumerate(lo + (hi - lo) * np.arange(GRID + 1) / GRID):
                # A document is used once more for each value of the distribution function up to its quantile.
                got[j] += above[np.searchsorted(u, below(mean, cap), "left")].sum()
        if len(sums) > 10_000:
            yield _curve_rows(sums)
            sums = {}
    if sums:
        yield _curve_rows(sums)


def _curve_rows(sums: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"source": np.repeat(list(sums), GRID + 1), "j": np.tile(np.arange(GRID + 1), len(sums)), "tokens": np.concatenate(list(sums.values()))})


def _tuned(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``plan`` with means whose realised tokens come nearest to the goal, in ``ROUNDS`` passes over the sizes, each over a finer grid."""
    fixed = plan.where("mean <= 0 OR mean = double('Infinity')")
    moving = stage_table(plan.where("mean > 0 AND mean < double('Infinity')").withColumn("lo", F.lit(0.0)).withColumn("hi", 2 * F.col("mean")), "means")
    mean_at = lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * j / GRID
    for _ in range(ROUNDS):
        drawn = sizes.where("n_tokens > 0").join(moving.select("source", "max_repeats", "lo", "hi"), "source").select("source", "n_tokens", "max_repeats", "lo", "hi", _uniform(seed, F.col("doc_id")).alias("u"))
        summed = drawn.mapInPandas(_curves, "source string, j int, tokens long").groupBy("source", "j").agg(F.sum("tokens").alias("tokens"))
        off = moving.join(summed, "source").select("source", F.struct(F.abs(F.col("tokens") - F.col("goal")), "j").alias("off"))
        best = moving.join(off.groupBy("source").agg(F.min("off")["j"].alias("j")), "source").withColumn("mean", mean_at(F.col("j")))
        nearer = best.withColumn("from", mean_at(F.greatest(F.col("j") - 1, F.lit(0)))).withColumn("hi", mean_at(F.least(F.col("j") + 1, F.lit(GRID)))).withColumn("lo", F.col("from"))
        moving = stage_table(nearer.select(*moving.columns), "means")
    return stage_table(fixed.unionByName(moving.drop("lo", "hi")), "rates")


def mix(docs: DataFrame, doc_id: str, source: str, text: str, targets: DataFrame, total: float | str | None = None, seed: int = 17, tokenizer_file: str = DEFAULT_FILE) -> Mixture:
    """A mixture in which each source has its ``target_share`` of all tokens as far as no document is used more than ``max_repeats`` times.

    ``targets``: ``source, target_share, max_repeats``; a null ``max_repeats`` counts as 1, a null share as 0, a null source is left out, a source
    named twice is an error.  ``total``: tokens aimed at.  Without it as many as the named sources hold: a source whose cap does not allow its share
    gives all it may, and what it lacks is shared out among the others by their shares.  ``REACHABLE``: the largest total at which every source that has
    tokens reaches its share; the source that has least for its share then bounds all others.

    ``shares`` has for every source: ``reachable_share`` (what goal and caps give), ``missing_tokens`` (what its cap takes from its share of the total),
    ``largest_doc``, what it has and what the mixture uses of it, and ``actual_share``.  A source's tokens come as near to its goal as its documents allow:
    within a document.  A source without tokens is reported with an actual share of 0; documents without a source, or of one that is not in ``targets``,
    are not used and reported with a null target.  Empty and null texts have size 0 and are copied like the others; repeated rows are documents of
    their own, drawn alike; documents without an id are drawn alike too.
    """
    if isinstance(total, str) and total != REACHABLE:
        raise ValueError(f"total must be a number, None or {REACHABLE!r}")
    spec = targets.where("source IS NOT NULL").select("source", F.coalesce("target_share", F.lit(0.0)).cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats"))
    twice = spec.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if spec.where("target_share < 0 OR max_repeats < 0").limit(1).union(twice.select(F.lit(""), F.lit(0.0), F.lit(0))).limit(1).collect():
        raise ValueError("targets must name each source once, and shares and repeats must not be negative")
    sizes = stage_table(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count_tokens(F.col(text), tokenizer_file).alias("n_tokens")), "sizes", compression="zstd")
    held = stage_table(sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"), F.max("n_tokens").alias("largest_doc")), "held")
    named = spec.join(held, "source", "left").withColumn("most", F.col("max_repeats") * F.coalesce("source_tokens", F.lit(0)).cast("double"))
    live = (F.col("target_share") > 0) & (F.col("most") > 0)
    sums = named.agg(F.sum(F.when(live, F.col("target_share"))).alias("shares"), F.sum(F.when(live, F.col("source_tokens"))).alias("tokens")).first()
    plan = named.withColumn("part", F.when(live, F.col("target_share") / F.lit(sums.shares)))
    if total == REACHABLE:
        level = plan.agg(F.min(F.col("most") / F.col("part"))).first()[0] or 0.0
        aim = level
    else:
        aim = float((sums.tokens or 0) if total is None else total)
        level = _level(plan.where("part IS NOT NULL"), aim)
    # An infinite level times a part is infinite: every source gives all it may.
    plan = plan.withColumn("goal", F.coalesce(F.least("most", F.col("part") * F.lit(level)), F.lit(0.0)))
    plan = plan.withColumn("rate", F.coalesce(F.try_divide("goal", "source_tokens"), F.lit(0.0)))
    # At the cap up to rounding: all copies.
    plan = plan.withColumn("mean", _poisson_mean(F.when(F.col("goal") > F.col("most") * (1 - 1e-12), F.col("max_repeats").cast("double")).otherwise(F.col("rate")), F.col("max_repeats")))
    columns = ["source", "target_share", "max_repeats", "part", "goal", "rate", "mean"]
    rates = _tuned(sizes, stage_table(plan.select(*columns), "plan"), seed)

    def used(df: DataFrame) -> DataFrame:
        # A row a source: small or not, the table's written size decides how it is joined.
        counted = df.join(rates.select("source", "mean", "max_repeats"), "source")
        return counted.withColumn("copies", copies(_uniform(seed, F.col("doc_id")), F.col("mean"), F.col("max_repeats"))).drop("mean", "max_repeats")

    given = used(sizes).groupBy("source").agg(F.sum("copies").alias("mixture_docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixture_tokens"))
    whole = given.agg(F.sum("mixture_tokens").alias("all_tokens")).crossJoin(rates.agg(F.sum("goal").alias("all_goals")))  # one row each
    everything = rates.join(held, "source", "full").join(given, "source", "left").crossJoin(F.broadcast(whole))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    shares = everything.select(
        "source", "target_share", "max_repeats", F.coalesce(F.try_divide("goal", "all_goals"), F.lit(0.0)).alias("reachable_share"),
        F.coalesce(F.greatest(F.lit(0.0), F.col("part") * F.lit(aim) - F.col("goal")), F.lit(0.0)).alias("missing_tokens"), F.coalesce("goal", F.lit(0.0)).alias("goal_tokens"), "rate",
        number("source_docs"), number("source_tokens"), number("largest_doc"), number("mixture_docs"), number("mixture_tokens"),
        F.coalesce(F.try_divide("mixture_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"),
    )
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    repeated = used(chosen).where("copies > 0").withColumn("copy_n", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    keyed = repeated.withColumn("order_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_n"))
    rows = keyed.repartition("order_key").sortWithinPartitions("order_key").select("doc_id", "source", "copy_n", "order_key", "text")
    return Mixture(rows, shares, aim)


def mixture_checks(mixture: Mixture, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(source, over_cap, changed, near_goal)`` for every source of the targets that has tokens: documents used more often than their source allows or
    with gaps in their numbers, copies whose text is not their document's, and whether the source is within 0.01 of the mixture, or within its largest
    document, of its goal.  Ids must be unique."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("own"))
    uses = mixture.rows.select("doc_id", "source", "copy_n", F.xxhash64("text").alias("digest")).join(texts, "doc_id", "left")
    uses = uses.groupBy("source", "doc_id").agg(F.max("copy_n").alias("most"), F.count(F.lit(1)).alias("n"), F.sum((~F.col("digest").eqNullSafe(F.col("own"))).cast("int")).alias("changed"))
    caps = mixture.shares.where("target_share > 0 AND max_repeats > 0 AND source_tokens > 0")
    found = uses.join(caps.select("source", "max_repeats"), "source").groupBy("source").agg(F.sum(((F.col("n") > F.col("max_repeats")) | (F.col("n") != F.col("most"))).cast("int")).alias("over_cap"), F.sum("changed").alias("changed"))
    near = (F.abs(F.col("actual_share") - F.col("reachable_share")) <= 0.01) | (F.abs(F.col("mixture_tokens") - F.col("goal_tokens")) <= F.col("largest_doc"))
    return caps.select("source", near.alias("near_goal")).join(found, "source", "left").select("source", F.coalesce("over_cap", F.lit(0)).cast("long").alias("over_cap"), F.coalesce("changed", F.lit(0)).cast("long").alias("changed"), "near_goal")
