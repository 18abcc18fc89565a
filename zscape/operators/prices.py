"""Price series: calendars, weekly bars, as-of features, market proxy, beta, forward returns.

Prices are long: ``ticker, date, close``, one row for a ticker's bar. Features are computed once for
every bar with windows over the ticker's own bars, and a rebalance date then takes each ticker's last
bar at or before it, instead of computing everything again for every date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import month, week_end
from ..shared import checked

YEAR_BARS, MONTH_BARS, WEEKS_BACK, VOL_WEEKS = 252, 21, 13, 26
BETA_WEEKS, BETA_LEAST = 52, 30


def _own():
    return Window.partitionBy("ticker").orderBy("date")


def calendar(prices: DataFrame) -> DataFrame:
    """``date, pos, n``: the distinct bar dates in order (a table of days, thousands of rows at most)."""
    days = prices.select("date").distinct()
    w = Window.orderBy("date")
    return days.select("date", (F.row_number().over(w) - 1).alias("pos"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))


def month_ends(prices: DataFrame) -> DataFrame:
    """``t``: the last bar date of each month."""
    return prices.groupBy(month(F.col("date")).alias("month")).agg(F.max("date").alias("t")).select("t")


def rebalances(prices: DataFrame, warmup: int = YEAR_BARS + 1, ahead: int = MONTH_BARS) -> DataFrame:
    """``t, pos``: month ends with enough bars of the shared calendar before and after."""
    days = calendar(prices)
    return month_ends(prices).join(days, F.col("t") == F.col("date")).where((F.col("pos") + 1 >= warmup) & (F.col("n") - 1 - F.col("pos") >= ahead)).select("t", "pos")


def weekly(prices: DataFrame) -> DataFrame:
    """``ticker, week, close, seq``: each week's last close; weeks without bars vanish."""
    bars = prices.where("close IS NOT NULL").groupBy("ticker", week_end(F.col("date")).alias("week")).agg(F.max_by("close", "date").alias("close"))
    return bars.withColumn("seq", F.row_number().over(Window.partitionBy("ticker").orderBy("week")))


def weekly_returns(prices: DataFrame, last: int | None = None) -> DataFrame:
    """``ticker, week, ret`` of each ticker's ``last`` weeks."""
    w = Window.partitionBy("ticker").orderBy("week")
    out = weekly(prices).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where("ret IS NOT NULL")
    if last:
        out = out.withColumn("back", F.row_number().over(w.orderBy(F.desc("week")))).where(F.col("back") <= last)
    return out.select("ticker", "week", "ret")


def _change(now: Column, then: Column) -> Column:
    return F.when(then != 0, now / then - 1)


def features(prices: DataFrame) -> DataFrame:
    """``ticker, date, close, n_bars, ret_12_1, ret_13w, volatility_26w`` as seen at every bar.

    The week of a bar is its last, partial one: its close counts as that week's. NULL where the
    history is too short.
    """
    bars = prices.where("close IS NOT NULL").withColumns(
        {
            "n_bars": F.row_number().over(_own()),
            "ret_12_1": _change(F.lag("close", MONTH_BARS).over(_own()), F.lag("close", YEAR_BARS).over(_own())),
            "week": week_end(F.col("date")),
        }
    )
    w = Window.partitionBy("ticker").orderBy("week")
    past = w.rowsBetween(-(VOL_WEEKS - 1), -1)
    weeks = weekly(prices).withColumn("lr", F.ln(F.col("close") / F.lag("close").over(w)))
    weeks = weeks.select("ticker", "week", "seq", F.lag("close", WEEKS_BACK).over(w).alias("far"), F.lag("close").over(w).alias("before"), F.sum("lr").over(past).alias("s1"), F.sum(F.col("lr") * F.col("lr")).over(past).alias("s2"))
    now = F.ln(F.col("close") / F.col("before"))
    mean = (F.col("s1") + now) / VOL_WEEKS
    spread = F.sqrt(F.greatest((F.col("s2") + now * now) / VOL_WEEKS - mean * mean, F.lit(0.0)) * 52)
    return bars.join(weeks, ["ticker", "week"]).select(
        "ticker",
        "date",
        "close",
        "n_bars",
        F.round("ret_12_1", 6).alias("ret_12_1"),
        F.round(_change(F.col("close"), F.col("far")), 6).alias("ret_13w"),
        F.when(F.col("seq") > VOL_WEEKS, F.round(spread, 6)).alias("volatility_26w"),
    )


def as_of(bars: DataFrame, dates: DataFrame, columns: list[str]) -> DataFrame:
    """``t, ticker, asof, <columns>``: each ticker's last bar at or before each ``t`` of ``dates``.

    Bars and dates are one sorted sequence for each ticker, and a date takes the last bar before it:
    no range join. ``dates`` is a calendar, small beside the bars; each ticker gets a row for each of them.
    """
    grid = bars.select("ticker").distinct().crossJoin(checked(dates.select("t"))).select("ticker", F.col("t").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast(bars.select(F.struct("date", *columns).alias("x")).schema[0].dataType).alias("bar"))
    rows = bars.select("ticker", F.col("date").alias("at"), F.lit(0).alias("ask"), F.struct("date", *columns).alias("bar")).unionByName(grid)
    seen = F.last("bar", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("bar", seen).where("ask = 1 AND bar IS NOT NULL").select(F.col("at").alias("t"), "ticker", F.col("bar.date").alias("asof"), *(F.col("bar")[c].alias(c) for c in columns))


def equal_weight_market(prices: DataFrame) -> DataFrame:
    """``week, ret``: compounded mean daily returns; holes are filled with the last close before.

    A filled day has the return 0, so a day's mean is the sum over its bars by the number of tickers
    that began before it, and no row is made for a hole.
    """
    bars = prices.where("close IS NOT NULL")
    moved = bars.withColumn("r", F.col("close") / F.lag("close").over(_own()) - 1).groupBy("date").agg(F.sum("r").alias("s"))
    begun = bars.groupBy("ticker").agg(F.min("date").alias("date")).groupBy("date").agg(F.count("*").alias("new"))
    before = F.sum("new").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))  # over the calendar
    days = prices.select("date").distinct().join(begun, "date", "left").join(moved, "date", "left").withColumn("n", before)
    daily = days.select("date", F.when(F.col("n") > 0, F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("r"))
    return daily.groupBy(week_end(F.col("date")).alias("week")).agg((F.coalesce(F.product(1 + F.col("r")), F.lit(1.0)) - 1).alias("ret"))


def proxy_market(prices: DataFrame, ticker: str) -> DataFrame:
    """``week, ret`` of one ticker."""
    return weekly_returns(prices.where(F.col("ticker") == ticker)).select("week", "ret")


def market(prices: DataFrame, ticker: str) -> DataFrame:
    """The proxy's returns; where it has none at all, the equal-weight market's."""
    proxy = proxy_market(prices, ticker)
    has = proxy.agg(F.count("*").alias("has"))
    whole = equal_weight_market(prices).crossJoin(F.broadcast(has)).where("has = 0").select("week", "ret")
    return proxy.unionByName(whole)


def beta(prices: DataFrame, market_returns: DataFrame, t: Column) -> DataFrame:
    """``ticker, n, beta`` of the last weeks at ``t``: slope on the market's weeks that end by ``t``."""
    seen = prices.where(F.col("date") <= t)
    both = weekly_returns(seen, BETA_WEEKS).join(market_returns.where(F.col("week") <= t).select("week", F.col("ret").alias("m")), "week").where("m IS NOT NULL")
    out = both.groupBy("ticker").agg(F.count("*").alias("n"), F.covar_pop("ret", "m").alias("c"), F.var_pop("m").alias("v"))
    return out.select("ticker", "n", F.when((F.col("n") >= BETA_LEAST) & (F.col("v") >= 1e-12), F.col("c") / F.col("v")).alias("beta"))


def betas(prices: DataFrame, market_returns: DataFrame, dates: DataFrame) -> DataFrame:
    """``t, ticker, n, beta_52w`` at every ``t`` of ``dates``: ``beta`` for all of them at once.

    Co-moments roll over each ticker's weeks. A week that isn't over at t is one of the 52 and has no market
    return yet, so a date within a ticker's week takes the 51 full weeks before it.
    """
    own = Window.partitionBy("ticker").orderBy("week")
    weeks = weekly_returns(prices).join(market_returns.select("week", F.col("ret").alias("m")), "week", "left")
    both = F.when(F.col("m").isNotNull(), F.col("ret"))
    for k in (BETA_WEEKS - 1, BETA_WEEKS):
        w = own.rowsBetween(1 - k, 0)
        weeks = weeks.withColumn(f"b{k}", F.struct(F.count(both).over(w).alias("n"), F.covar_pop(both, "m").over(w).alias("c"), F.var_pop("m").over(w).alias("v")))
    full = as_of(weeks.withColumnRenamed("week", "date"), dates, [f"b{BETA_WEEKS - 1}", f"b{BETA_WEEKS}"]).drop("asof")
    last = as_of(prices.where("close IS NOT NULL"), dates, []).select("t", "ticker", (week_end(F.col("asof")) > F.col("t")).alias("within"))
    x = F.when(F.col("within"), F.col(f"b{BETA_WEEKS - 1}")).otherwise(F.col(f"b{BETA_WEEKS}"))
    out = last.join(full, ["t", "ticker"], "left").select("t", "ticker", x.alias("x"))
    return out.select("t", "ticker", F.coalesce("x.n", F.lit(0)).alias("n"), F.when((F.col("x.n") >= BETA_LEAST) & (F.col("x.v") >= 1e-12), F.col("x.c") / F.col("x.v")).alias("beta_52w"))


def signals(prices: DataFrame, market_returns: DataFrame, dates: DataFrame) -> DataFrame:
    """``t, ticker, asof, ret_12_1, ret_13w, volatility_26w, beta_52w`` of every ticker with a bar by ``t``."""
    own = as_of(features(prices), dates, ["ret_12_1", "ret_13w", "volatility_26w"])
    return own.join(betas(prices, market_returns, dates).select("t", "ticker", "beta_52w"), ["t", "ticker"], "left")


def forward_returns(prices: DataFrame, dates: DataFrame, horizons: list[int]) -> DataFrame:
    """``t, ticker, horizon, fwd``: returns over ``horizon`` bars of the shared calendar.

    NULL where either bar is missing or the calendar ends before.
    """
    days = calendar(prices).select("date", "pos")
    placed = prices.join(checked(days), "date")
    h = F.explode(F.array(*map(F.lit, horizons))).alias("horizon")
    start = placed.join(checked(dates.select("t")), F.col("date") == F.col("t")).select("t", "ticker", "pos", F.col("close").alias("from"), h)
    stop = placed.select("ticker", F.col("pos").alias("p2"), F.col("close").alias("to"))
    out = start.withColumn("p2", F.col("pos") + F.col("horizon")).join(stop, ["ticker", "p2"], "left")
    return out.select("t", "ticker", "horizon", F.when(F.col("from") != 0, F.col("to") / F.col("from") - 1).alias("fwd"))


def with_source(base: DataFrame, vendor: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base prices, vendor prices for tickers that base lacks, and each ticker's source."""
    have_base, have_vendor = base.select("ticker").distinct(), vendor.select("ticker").distinct()
    source = (
        wanted.select("ticker").distinct().join(have_base.withColumn("b", F.lit(1)), "ticker", "left").join(have_vendor.withColumn("v", F.lit(1)), "ticker", "left")
        .select("ticker", F.when(F.col("b") == 1, "base").when(F.col("v") == 1, "fetch").otherwise("missing").alias("source"))
    )
    prices = base.join(source.where("source = 'base'").select("ticker"), "ticker", "left_semi").unionByName(vendor.join(source.where("source = 'fetch'").select("ticker"), "ticker", "left_semi"))
    return prices, source


def reconciled(a: DataFrame, b: DataFrame, least: int = 20) -> DataFrame:
    """``ticker, n, max_diff, worst``: the largest relative difference over shared dates (enough of them)."""
    both = a.select("ticker", "date", F.col("close").alias("x")).join(b.select("ticker", "date", F.col("close").alias("y")), ["ticker", "date"])
    d = F.abs(F.col("x") / F.col("y") - 1)
    return both.groupBy("ticker").agg(F.count("*").alias("n"), F.max(d).alias("max_diff"), F.max_by("date", F.struct(d, F.datediff(F.lit("2100-01-01"), "date"))).alias("worst")).where(F.col("n") >= least)
