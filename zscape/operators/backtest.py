"""Information coefficients, quantile portfolios, regimes, bootstrap and composite experiments.

Scores are long: ``t, ticker, score, fwd``, further columns (factor, variant, horizon) go in ``by``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio, weighted_sum
from ..functions.ranks import average_rank, quantile_label
from ..shared import written
from .scoring import covariances, equal_contribution

# Named periods, both ends included, and the literature's composite weights.
REGIMES = {
    "late_bull_2021H2": ("2021-08-01", "2021-12-31"),
    "bear_rate_shock_2022": ("2022-01-01", "2022-12-31"),
    "ai_bull_2023_plus": ("2023-01-01", "2100-01-01"),
}
#: Months that the standard error of a mean IC allows to depend on each other.
LAG = 3
LITERATURE = {"trend": 0.40, "quality": 0.30, "value": 0.15, "risk": 0.15}


def information_coefficients(slices: DataFrame, by: list[str]) -> DataFrame:
    """``<by>, n, ic``: rank correlation of score and forward return over names that have both.

    NULL below three names or where a side is constant.
    """
    both = slices.where("score IS NOT NULL AND fwd IS NOT NULL")
    ranked = both.withColumns({"_a": average_rank("score", by), "_b": average_rank("fwd", by)})
    n, total = F.count("*"), lambda x, y: F.sum(F.col(x) * F.col(y))
    # sums of half ranks are exact, so an IC of 0 is 0 and not a rounding error with a sign
    co = lambda x, y: n * total(x, y) - F.sum(x) * F.sum(y)
    return ranked.groupBy(*by).agg(n.alias("n"), F.when((n >= 3) & (co("_a", "_a") > 0) & (co("_b", "_b") > 0), co("_a", "_b") / F.sqrt(co("_a", "_a")) / F.sqrt(co("_b", "_b"))).alias("ic"))


def newey_west(ics: DataFrame, by: list[str], lag: int = LAG) -> DataFrame:
    """``<by>, se_nw``: Bartlett-weighted standard error of the mean IC; NULL below two or if not positive."""
    own, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("t")
    x = ics.where("ic IS NOT NULL").withColumn("x", F.col("ic") - F.avg("ic").over(own))
    lagged = x.withColumns({f"l{k}": F.col("x") * F.lag("x", k).over(order) for k in range(1, lag + 1)})
    gammas = [F.coalesce(F.sum(f"l{k}"), F.lit(0.0)) / F.count("*") * (2 * (1 - k / (lag + 1))) for k in range(1, lag + 1)]
    total = reduce(lambda a, b: a + b, gammas, F.sum(F.col("x") * F.col("x")) / F.count("*"))
    n = F.count("*")
    return lagged.groupBy(*by).agg(F.when((n >= 2) & (total > 0), F.sqrt(total / n)).alias("se_nw"))


def ic_summary(ics: DataFrame, by: list[str], lag: int = LAG) -> DataFrame:
    """``<by>, n, mean, std, t_stat, t_nw, pct_pos, ic_for_t2``; ``pct_pos`` is in percent."""
    known = ics.where("ic IS NOT NULL")
    n, mean, sd = F.count("*"), F.avg("ic"), F.stddev_samp("ic")
    sd = F.when(sd > 0, sd)
    base = known.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), sd.alias("std"), F.avg(F.when(F.col("ic") > 0, 100.0).otherwise(0.0)).alias("pct_pos"))
    return base.join(newey_west(ics, by, lag), by).select(*by, "n", "mean", "std", (F.col("mean") / (F.col("std") / F.sqrt("n"))).alias("t_stat"), ratio(F.col("mean"), F.col("se_nw")).alias("t_nw"), "pct_pos", (2 * F.col("std") / F.sqrt("n")).alias("ic_for_t2"))


def block_bootstrap(ics: DataFrame, by: list[str], block: int = 3, resamples: int = 2000, seed: int = 20260706) -> DataFrame:
    """``<by>, ci_lo, ci_hi``: circular block bootstrap of the mean IC, 2.5 and 97.5 percentiles.

    Block starts come from NumPy's generator in the driver (a few numbers for each length of a series);
    sums over circular blocks, resampled means and percentiles are DataFrame operations. NULL for series
    shorter than a block.
    """
    spark = ics.sparkSession
    own = Window.partitionBy(*by)
    x = ics.where("ic IS NOT NULL").withColumns({"pos": F.row_number().over(own.orderBy("t")) - 1, "n": F.count("*").over(own)})
    arrays = x.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "ic"))), lambda s: s["ic"]).alias("xs"))
    lengths = [r[0] for r in arrays.select("n").distinct().collect()]
    rows = []
    for n in lengths:
        if n >= block:
            starts = np.random.default_rng(seed).integers(0, n, size=(resamples, -(-n // block)))
            rows += [(n, i, s.tolist()) for i, s in enumerate(starts)]
    draws = spark.createDataFrame(rows, "n long, i int, starts array<int>")
    taken = F.slice(F.flatten(F.transform("starts", lambda s: F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda k: F.get(F.col("xs"), ((s + k) % F.col("n")).cast("int"))))), 1, F.col("n").cast("int"))
    mean = F.aggregate(taken, F.lit(0.0), lambda a, v: a + v) / F.col("n")
    ci = arrays.join(draws, "n").select(*by, mean.alias("m")).groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("ci_lo"), F.percentile("m", F.lit(0.975)).alias("ci_hi"))
    return arrays.select(*by).join(ci, by, "left")


def quintile_spreads(slices: DataFrame, by: list[str], q: int = 5) -> DataFrame:
    """``<by>, q1 ... q<q>, spread``: mean forward return of each label, and top less bottom.

    Labels come from the scores alone; names without a forward return leave afterwards. Dates on which
    a label is left without names are skipped.
    """
    labelled = slices.withColumn("label", quantile_label("score", by, "ticker", q)).where("label IS NOT NULL AND fwd IS NOT NULL")
    means = labelled.groupBy(*by).agg(*[F.avg(F.when(F.col("label") == k, F.col("fwd"))).alias(f"q{k}") for k in range(1, q + 1)], F.count_distinct("label").alias("labels"))
    return means.where(F.col("labels") == q).select(*by, *[f"q{k}" for k in range(1, q + 1)], (F.col(f"q{q}") - F.col("q1")).alias("spread"))


def annualised(series: DataFrame, by: list[str], value: str, periods: int = 12) -> DataFrame:
    """``<by>, n, ann_ret, ann_vol, max_drawdown`` of monthly returns."""
    own = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    known = series.where(F.col(value).isNotNull()).withColumn("equity", F.product(1 + F.col(value)).over(own))
    known = known.withColumn("peak", F.max("equity").over(own))
    n = F.count("*")
    return known.groupBy(*by).agg(n.alias("n"), (F.pow(F.product(1 + F.col(value)), F.lit(float(periods)) / n) - 1).alias("ann_ret"), (F.stddev_samp(value) * F.sqrt(F.lit(periods))).alias("ann_vol"), F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"))


def book_changes(slices: DataFrame, by: list[str], q: int = 5) -> DataFrame:
    """``<by>, t, ticker, was``: the top book of each date that has one before, and whether a name was in that.

    ``by`` without ``t``. Dates without a book keep the book before.
    """
    book = slices.withColumn("label", quantile_label("score", [*by, "t"], "ticker", q)).where(F.col("label") == q).select(*by, "t", "ticker")
    own = Window.partitionBy(*by).orderBy("t")
    dates = book.select(*by, "t").distinct().withColumn("prev", F.lag("t").over(own))
    before = book.select(*by, F.col("t").alias("prev"), "ticker", F.lit(1).alias("was"))
    kept = book.join(dates.where("prev IS NOT NULL"), [*by, "t"]).join(before, [*by, "prev", "ticker"], "left")
    return kept.select(*by, "t", "ticker", F.col("was").isNotNull().alias("was"))


def top_turnover(slices: DataFrame, by: list[str], q: int = 5) -> DataFrame:
    """``<by>, turnover``: mean share of the top book that was not in the book of the date before."""
    each = book_changes(slices, by, q).groupBy(*by, "t").agg((F.sum(F.when(F.col("was"), 0.0).otherwise(1.0)) / F.count("*")).alias("new"))
    return each.groupBy(*by).agg(F.avg("new").alias("turnover"))


def regime_means(ics: DataFrame, by: list[str], regimes: dict = REGIMES) -> DataFrame:
    """``<by>, <regime>_mean, <regime>_n`` for each regime."""
    inside = {k: F.when(F.col("t").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.col("ic")) for k, (a, b) in regimes.items()}
    return ics.groupBy(*by).agg(*[f(c).alias(f"{k}_{n}") for k, c in inside.items() for n, f in (("mean", F.avg), ("n", F.count))])


def decay(ics: DataFrame, by: list[str], near: int = 21, far: int = 63) -> DataFrame:
    """``<by>, mean_<h>, n_<h>`` for two horizons."""
    at = {h: F.when(F.col("horizon") == h, F.col("ic")) for h in (near, far)}
    return ics.groupBy(*by).agg(*[f(c).alias(f"{n}_{h}") for h, c in at.items() for n, f in (("mean", F.avg), ("n", F.count))])


def inclusion_bias(all_ics: DataFrame, member_ics: DataFrame, by: list[str]) -> DataFrame:
    """``<by>, unfiltered, filtered, bias``: how much the mean IC owes to names before they were members."""
    a = all_ics.groupBy(*by).agg(F.avg("ic").alias("unfiltered"))
    b = member_ics.groupBy(*by).agg(F.avg("ic").alias("filtered"))
    return a.join(b, by).select(*by, "unfiltered", "filtered", (F.col("unfiltered") - F.col("filtered")).alias("bias"))


def renormalised(weights: dict[str, float], present: list[str]) -> dict[str, float]:
    """``weights`` over the present names, to a sum of 1; equal if they have none."""
    own = {k: weights.get(k, 0.0) for k in present}
    total = sum(own.values())
    return {k: v / total for k, v in own.items()} if total > 0 else {k: 1 / len(present) for k in present}


def row_weights(weights: dict[str, float]) -> Column:
    """A struct of ``weights`` renormalised over the columns that a row has; equal parts if those weigh nothing, NULL without any."""
    own = {k: F.when(F.col(k).isNotNull(), F.lit(w)) for k, w in weights.items()}
    total = reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(0.0)) for w in own.values()])
    there = reduce(lambda a, b: a + b, [F.col(k).isNotNull().cast("int") for k in weights])
    return F.struct(*[F.when(F.col(k).isNotNull(), F.when(total > 0, w / total).otherwise(1 / there)).alias(k) for k, w in own.items()])


def composite(df: DataFrame, weights: dict[str, float]) -> Column:
    """The weighted sum of the buckets that are columns; NULL only if all of them are."""
    own = renormalised({k: v for k, v in weights.items() if k in df.columns}, [k for k in weights if k in df.columns])
    return weighted_sum([(w, F.col(k)) for k, w in own.items()])


def variance_shares(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``bucket, share``: what each bucket contributes to the composite's variance."""
    names = list(weights)
    cov = df.agg(*covariances(names))
    s = lambda i, j: F.col(f"{names[min(i, j)]}*{names[max(i, j)]}")
    sw = [reduce(lambda a, b: a + b, [s(i, j) * weights[n] for j, n in enumerate(names)]) for i in range(len(names))]
    total = reduce(lambda a, b: a + b, [weights[n] * sw[i] for i, n in enumerate(names)])
    return cov.select(F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), (weights[n] * sw[i] / total).alias("share")) for i, n in enumerate(names)])).alias("x")).select("x.*")


def solved_weights(df: DataFrame, names: list[str]) -> DataFrame:
    """``bucket, weight`` with equal variance shares over rows that have every bucket."""
    w = df.select(*names).dropna("any").agg(*covariances(names)).select(equal_contribution(names, None).alias("w"))
    return w.select(F.posexplode("w").alias("pos", "weight")).select(F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1).alias("bucket"), "weight")


def bucket_coverage(slices: DataFrame) -> DataFrame:
    """``bucket`` for those that every date has: ``slices`` is ``t, bucket, score``."""
    dates = slices.agg(F.count_distinct("t").alias("all"))
    own = slices.where("score IS NOT NULL").groupBy("bucket").agg(F.count_distinct("t").alias("n"))
    return own.join(F.broadcast(dates), F.col("n") == F.col("all")).select("bucket")  # one row


def experiment(slices: DataFrame, schemes: dict[str, dict[str, float]]) -> DataFrame:
    """``scheme, t, ic, n``: rank IC of the composite of each scheme. ``slices``: ``t, ticker, fwd`` and buckets."""
    parts = [slices.select(F.lit(k).alias("scheme"), "t", "ticker", composite(slices, w).alias("score"), "fwd") for k, w in schemes.items()]
    return information_coefficients(reduce(DataFrame.unionByName, parts), ["scheme", "t"])


def scheme_weights(slices: DataFrame, named: dict[str, dict[str, float]], present: list[str]) -> DataFrame:
    """``scheme, bucket, weight``: ``named`` weights over the present buckets, and ``variance_share``, solved in the plan.

    ``slices`` is ``t, ticker, bucket, score``; the solve takes the rows of all dates that have every bucket.
    """
    rows = [(k, b, float(w)) for k, own in named.items() for b, w in renormalised(own, present).items()]
    given = slices.sparkSession.createDataFrame(rows, "scheme string, bucket string, weight double")
    wide = slices.groupBy("t", "ticker").pivot("bucket", present).agg(F.first("score"))
    return given.unionByName(solved_weights(wide, present).select(F.lit("variance_share").alias("scheme"), "bucket", "weight"))


def weighted(slices: DataFrame, weights: DataFrame) -> DataFrame:
    """``scheme, t, ticker, score``: each scheme's weighted sum of the buckets that a name has."""
    both = slices.where("score IS NOT NULL").join(F.broadcast(weights), "bucket")  # schemes times buckets
    return both.groupBy("scheme", "t", "ticker").agg(F.sum(F.col("weight") * F.col("score")).alias("score"))


def scheme_results(slices: DataFrame, weights: DataFrame, forward: DataFrame) -> DataFrame:
    """``scheme, n, mean, t_stat, t_nw, ann_return`` of each scheme's composite; ``forward`` is ``t, ticker, fwd``."""
    scored = written(weighted(slices, weights).join(forward.select("t", "ticker", "fwd"), ["t", "ticker"], "left"), "composites")
    ics = ic_summary(information_coefficients(scored, ["scheme", "t"]), ["scheme"])
    returns = annualised(quintile_spreads(scored, ["scheme", "t"]), ["scheme"], "spread")
    return ics.join(returns.select("scheme", F.col("ann_ret").alias("ann_return")), "scheme", "left").select("scheme", "n", "mean", "t_stat", "t_nw", "ann_return")
