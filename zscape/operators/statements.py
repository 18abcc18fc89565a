"""Ratios from quarterly statements: ``symbol, statement, tag, q_rank, value``, newest quarter first.

All tags of a symbol are summed in one grouped pass; ladders of tags are a coalesce over the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ladders of tags, first choice first.
EBIT = ("EBIT", "Operating Income")
OPERATING_CASH, CAPITAL = ("Operating Cash Flow", "Total Cash From Operating Activities"), ("Capital Expenditure", "Capital Expenditures")
DIVIDENDS = ("Cash Dividends Paid", "Common Stock Dividend Paid", "Dividends Paid")
BUYBACKS = ("Repurchase Of Capital Stock", "Common Stock Payments", "Repurchase Of Stock")


def _sum4(tag: str) -> Column:
    """The sum of the newest four quarters; NULL if none of them has a value."""
    return F.sum(F.when((F.col("tag") == tag) & (F.col("q_rank") <= 4), F.col("value")))


def _has(tag: str) -> Column:
    return F.max(F.col("tag") == tag)


def _newest(tag: str) -> Column:
    return F.max(F.when((F.col("tag") == tag) & (F.col("q_rank") == 1), F.col("value")))


def ttm_ladder(*tags: str) -> Column:
    """The sum of the first tag that has any value."""
    return F.coalesce(*[_sum4(t) for t in tags])


def _present_ladder(*tags: str) -> Column:
    """The sum of the first tag that has a row (0 if all its values are missing)."""
    out = F.lit(None).cast("double")
    for t in reversed(tags):
        out = F.when(_has(t), F.coalesce(_sum4(t), F.lit(0.0))).otherwise(out)
    return out


def ratios(statements: DataFrame, info: DataFrame) -> DataFrame:
    """``symbol, roic, fcf_margin_ttm, gpa, net_payout_yield``; ``info`` has the vendor's own figures.

    ``info``: ``symbol, fcf, revenue, gross_margin, market_cap``, any of them NULL.
    """
    gross = F.when(F.count(F.when((F.col("tag") == "Gross Profit") & (F.col("q_rank") <= 4), F.col("value"))) == 4, _sum4("Gross Profit"))
    s = statements.groupBy("symbol").agg(
        _present_ladder(*EBIT).alias("ebit"), _newest("Total Assets").alias("assets"), _newest("Current Liabilities").alias("liabilities"),
        _present_ladder(*OPERATING_CASH).alias("ocf"), F.coalesce(F.abs(_present_ladder(*CAPITAL)), F.lit(0.0)).alias("capex"),
        gross.alias("gross"), ttm_ladder(*DIVIDENDS).alias("dividends"), ttm_ladder(*BUYBACKS).alias("buybacks"),
    )
    x = info.join(s, "symbol", "left")
    revenue = F.when(F.col("revenue") > 0, F.col("revenue"))
    invested = F.col("assets") - F.col("liabilities")
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap"))
    any_leg = F.coalesce("dividends", "buybacks").isNotNull()
    return x.select(
        "symbol",
        F.when(invested > 0, F.col("ebit") / invested).alias("roic"),
        F.coalesce(F.col("fcf") / revenue, (F.col("ocf") - F.col("capex")) / revenue).alias("fcf_margin_ttm"),
        F.when(F.col("assets") > 0, F.coalesce(F.col("gross"), F.nullif(F.col("revenue"), F.lit(0.0)) * F.col("gross_margin")) / F.col("assets")).alias("gpa"),
        F.when(any_leg, (F.abs(F.coalesce("dividends", F.lit(0.0))) + F.abs(F.coalesce("buybacks", F.lit(0.0)))) / cap).alias("net_payout_yield"),
    )


def as_decimals(rows: DataFrame) -> DataFrame:
    """Percentages of the vendor as decimals."""
    return rows.withColumns({"debt_equity": F.col("debt_equity") / 100, "dividend_yield": F.col("dividend_yield") / 100})
