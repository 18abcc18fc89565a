"""What is published: ranked objects, the market summary, freshness, and diffs of two rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import published
from ..shared import numbered

# The published columns.
META = ("ticker", "name", "sector", "data_quality")
SCORES = ("composite_score", "trend_score", "quality_score", "value_score", "risk_score")
PRICES = ("ret_12_1", "ret_13w", "volatility_26w")
FUNDAMENTALS = ("pe_ratio", "pb_ratio", "ev_ebitda", "roe", "roic", "debt_equity", "eps_ttm", "dividend_yield", "revenue_growth_ttm", "oper_margin_ttm", "gross_margin_ttm", "fcf_margin_ttm", "gpa", "net_payout_yield", "market_cap", "beta")
STALE_DAYS, LEAST_COVERAGE = 5, 0.90


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` from 1 by composite, ticker, over range partitions."""
    return numbered(rows, [F.col("composite_score").desc_nulls_last(), F.col("ticker")])


def objects(rows: DataFrame) -> DataFrame:
    """``rank, json``: each ranked row as the published object (absent meta columns are empty texts)."""
    meta = [(F.coalesce(F.col(c).cast("string"), F.lit("nan")) if c in rows.columns else F.lit("")).alias(c) for c in META]
    numbers = [(published(F.col(c)) if c in rows.columns else F.lit(None).cast("double")).alias(c) for c in (*SCORES, *PRICES, *FUNDAMENTALS)]
    return ranked(rows).select("rank", F.to_json(F.struct("rank", *meta, *numbers), {"ignoreNullFields": "false"}).alias("json"))


def leaders(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.col("composite_score").desc_nulls_last(), "ticker").limit(n)


def strided(rows: DataFrame, n: int) -> DataFrame:
    """Every k-th ranked row from the first, where k spreads ``n`` rows over the whole ranking."""
    size = rows.agg(F.greatest(F.lit(1), F.floor(F.count("*") / n)).alias("_step"))
    picked = ranked(rows).crossJoin(F.broadcast(size)).where((F.col("rank") - 1) % F.col("_step") == 0)  # one row
    return picked.drop("_step").orderBy("rank").limit(n)


def recency(rows: DataFrame, today: Column) -> DataFrame:
    """``data_asof, data_age_days, coverage, data_fresh`` of ``price_asof`` texts."""
    d = F.col("price_asof").try_cast("date")
    out = rows.agg(F.max(d).alias("data_asof"), F.avg(F.when(d.isNotNull(), 1.0).otherwise(0.0)).alias("coverage"))
    age = F.datediff(today, F.col("data_asof"))
    return out.select("data_asof", age.alias("data_age_days"), "coverage", F.coalesce((age <= STALE_DAYS) & (F.col("coverage") >= LEAST_COVERAGE), F.lit(False)).alias("data_fresh"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: sizes, extremes, and medians (of price-earnings and return on equity too)."""
    scored = F.col("composite_score").isNotNull()
    top = F.min(F.when(scored, F.struct((-F.col("composite_score")).alias("s"), "ticker")))
    bottom = F.max(F.when(scored, F.struct((-F.col("composite_score")).alias("s"), "ticker")))
    return rows.agg(
        F.count("*").alias("universe_size"),
        F.count_if(F.col("data_quality") == "missing_prices").alias("missing_price_count"),
        F.count_if(F.col("data_quality") == "partial_prices").alias("partial_price_count"),
        top["ticker"].alias("top_symbol"),
        F.max("composite_score").alias("top_score"),
        bottom["ticker"].alias("bottom_symbol"),
        F.min("composite_score").alias("bottom_score"),
        published(F.median("composite_score")).alias("median_composite"),
        published(F.avg("composite_score")).alias("avg_composite"),
        published(F.median("pe_ratio")).alias("avg_pe"),
        published(F.median("roe")).alias("avg_roe"),
    )


def counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def rank_correlation(old: DataFrame, new: DataFrame) -> DataFrame:
    """``n, rho`` of the stored ranks of common tickers, without ranking again; NULL where a side is constant."""
    a, b = F.col("old_rank").cast("double"), F.col("new_rank").cast("double")
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return common(old, new).agg(F.count("*").alias("n"), F.when(spread > 0, F.covar_pop(a, b) / spread).alias("rho"))


def common(old: DataFrame, new: DataFrame) -> DataFrame:
    """``ticker, old_rank, new_rank, move``; a negative move is upwards."""
    both = old.select("ticker", F.col("rank").alias("old_rank")).join(new.select("ticker", F.col("rank").alias("new_rank")), "ticker")
    return both.withColumn("move", F.col("new_rank") - F.col("old_rank"))


def churn(old: DataFrame, new: DataFrame, n: int = 20) -> DataFrame:
    """``ticker, status``: stayed in, entered or left the first ``n``."""
    a, b = old.where(F.col("rank") <= n).select("ticker"), new.where(F.col("rank") <= n).select("ticker")
    return (
        a.join(b, "ticker", "left_semi").withColumn("status", F.lit("stayed"))
        .unionByName(b.join(a, "ticker", "left_anti").withColumn("status", F.lit("entered")))
        .unionByName(a.join(b, "ticker", "left_anti").withColumn("status", F.lit("left")))
    )


def movers(old: DataFrame, new: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest moves each way, ties by ticker."""
    both = common(old, new)
    up = both.orderBy("move", "ticker").limit(n).withColumn("side", F.lit("up"))
    return up.unionByName(both.orderBy(F.desc("move"), "ticker").limit(n).withColumn("side", F.lit("down")))
