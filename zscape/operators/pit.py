"""Bitemporal facts: what was known at a date.

Facts are long: ``ticker, concept, period_start, period_end, filed, fy, value, seq``; ``filed`` is when
a value became known, ``seq`` the order of the input (the last of equals wins). Filters on ``filed`` go
first and reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import quarters_spanned, ratio

# What is a level and what is a flow.
STOCKS = ("stockholders_equity", "total_assets", "current_liabilities", "cash_and_equivalents", "total_debt", "shares_outstanding")
FLOWS = ("revenues", "gross_profit", "operating_income", "net_income", "depreciation_amortization", "operating_cash_flow", "capex", "buybacks", "dividends_paid")


def known_at(facts: DataFrame, as_of: Column) -> DataFrame:
    return facts.where(F.col("filed") <= as_of)


def latest(facts: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the last in ``order``, then by ``seq``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in (*order, "seq")])
    return facts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stocks(facts: DataFrame) -> DataFrame:
    """``ticker, concept, value``: the newest period's value, of its newest filing."""
    rows = facts.where(F.col("concept").isin(*STOCKS) & F.col("value").isNotNull() & F.col("period_end").isNotNull())
    return latest(rows, ["ticker", "concept"], "period_end", "filed").select("ticker", "concept", "value")


def quarters(facts: DataFrame) -> DataFrame:
    """``ticker, concept, period_end, value``: discrete quarters of flows.

    Quarters that were filed as such win; the rest are differences of year-to-date values within a
    fiscal year where no step of the ladder is missing. The first discrete quarter of a fiscal year
    (in the order of the input) is its first step; a period end that two fiscal years could give comes
    from the earlier one.
    """
    own = ["ticker", "concept"]
    rows = facts.where(F.col("concept").isin(*FLOWS)).withColumn("n", quarters_spanned(F.col("period_start"), F.col("period_end")))
    rows = rows.where("n IS NOT NULL AND value IS NOT NULL AND fy IS NOT NULL")
    single = rows.where("n = 1")
    first = Window.partitionBy(*own, "period_end").orderBy("seq")
    seen = single.withColumns({"fy1": F.first("fy").over(first), "seq1": F.first("seq").over(first)})
    direct = latest(seen, [*own, "period_end"], "filed")
    level_one = direct.select(*own, F.col("fy1").alias("fy"), F.lit(1).alias("n"), "period_end", "value", "seq1")
    pick = Window.partitionBy(*own, "fy").orderBy("seq1")
    level_one = level_one.withColumn("_rn", F.row_number().over(pick)).where("_rn = 1").drop("_rn", "seq1")
    above = latest(rows.where("n > 1"), [*own, "fy", "n"], "filed", "period_end").select(*own, "fy", "n", "period_end", "value")
    ladder = Window.partitionBy(*own, "fy").orderBy("n")
    steps = level_one.unionByName(above).withColumns({"below": F.coalesce(F.lag("n").over(ladder), F.lit(0)), "base": F.coalesce(F.lag("value").over(ladder), F.lit(0.0))})
    derived = steps.where("n - below = 1").select(*own, "period_end", (F.col("value") - F.col("base")).alias("value"), F.lit(1).alias("rank"), "fy", "n")
    every = direct.select(*own, "period_end", "value", F.lit(0).alias("rank"), F.lit(0.0).alias("fy"), F.lit(0).alias("n")).unionByName(derived.withColumn("fy", F.col("fy").cast("double")))
    best = Window.partitionBy(*own, "period_end").orderBy("rank", "fy", "n")
    return every.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select(*own, "period_end", "value")


def trailing_sums(discrete: DataFrame) -> DataFrame:
    """``ticker, concept, ttm``: the last four quarters' sum; NULL if there are fewer."""
    w = Window.partitionBy("ticker", "concept").orderBy(F.desc("period_end"))
    last = discrete.withColumn("_rn", F.row_number().over(w)).where("_rn <= 4")
    return last.groupBy("ticker", "concept").agg(F.when(F.count("*") == 4, F.sum("value")).alias("ttm"))


def as_known_at(facts: DataFrame, as_of: Column) -> DataFrame:
    """One row for each ticker with facts filed by then: levels, and ``<flow>_ttm``."""
    seen = known_at(facts, as_of)
    levels = stocks(seen).groupBy("ticker").pivot("concept", list(STOCKS)).agg(F.first("value"))
    flows = trailing_sums(quarters(seen)).groupBy("ticker").pivot("concept", list(FLOWS)).agg(F.first("ttm")).withColumnsRenamed({f: f"{f}_ttm" for f in FLOWS})
    return seen.select("ticker").distinct().join(levels, "ticker", "left").join(flows, "ticker", "left")


def validity(facts: DataFrame) -> DataFrame:
    """``ticker, concept, value, valid_from, valid_to``: levels as intervals of knowledge.

    For many dates at once: what was known at t is an equi-join and ``valid_from <= t < valid_to``.
    """
    rows = facts.where(F.col("concept").isin(*STOCKS) & F.col("value").isNotNull() & F.col("period_end").isNotNull() & F.col("filed").isNotNull())
    own = Window.partitionBy("ticker", "concept")
    best = F.max(F.struct("period_end", "filed", "seq", "value")).over(own.orderBy("filed").rangeBetween(Window.unboundedPreceding, 0))
    days = rows.select("ticker", "concept", "filed", best.alias("b")).groupBy("ticker", "concept", "filed").agg(F.first("b").alias("b"))
    return days.select("ticker", "concept", F.col("b.value").alias("value"), F.col("filed").alias("valid_from"), F.lead("filed").over(own.orderBy("filed")).alias("valid_to"))


def signals(wide: DataFrame, closes: DataFrame) -> DataFrame:
    """``ticker`` and eight raw ratios, higher is better, from the wide view and ``ticker, close``.

    A ``t`` stays, and is a key of the closes too where they have it: all dates at once. Missing capital expenditure, depreciation, debt, cash and payout legs count as 0; any other missing
    input makes its ratio NULL.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    keys = [c for c in ("t", "ticker") if c in wide.columns]
    on = [c for c in keys if c in closes.columns]
    x = wide.join(closes.select(*on, "close"), on, "left")
    cap = F.col("shares_outstanding") * F.col("close")
    ev = cap + zero("total_debt") - zero("cash_and_equivalents")
    return x.select(
        *keys,
        ratio(F.col("net_income_ttm"), cap).alias("ep"),
        ratio(F.col("stockholders_equity"), cap).alias("bp"),
        ratio(F.col("operating_cash_flow_ttm") - zero("capex_ttm"), cap).alias("fcf_yield"),
        ratio(zero("dividends_paid_ttm") + zero("buybacks_ttm"), cap).alias("net_payout_yield"),
        ratio(F.col("gross_profit_ttm"), F.col("total_assets")).alias("gpa"),
        ratio(F.col("net_income_ttm"), F.col("stockholders_equity")).alias("roe"),
        ratio(F.col("operating_income_ttm"), F.col("revenues_ttm")).alias("oper_margin"),
        ratio(F.col("operating_income_ttm") + zero("depreciation_amortization_ttm"), ev).alias("ev_ebitda_yield"),
    )
