"""Jobs: the operators composed as the engine runs them, with the rules for when a job must fail.

Each job takes and gives DataFrames, so that its tables are computed where they are written; the
driver only asks whether a table has rows, and sums up which steps went well.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import data_quality, guarded, ratio, row_mean, vendor_symbol
from .functions.ranks import gaussian_rank, sector_neutral
from .operators import backtest, guards, membership, pit, prices, publish, replay, scoring
from .shared import checked, numbered, written
from .sources import web

log = logging.getLogger(__name__)


class Refused(RuntimeError):
    """A step has nothing to go on with."""


def chosen(steps: dict[str, Callable[[], object]], only: Iterable[str] | None = None) -> dict[str, Callable[[], object]]:
    """The steps that ``only`` names, in their own order; all of them without it."""
    return dict(steps) if only is None else {n: s for n, s in steps.items() if n in set(only)}


def run_steps(steps: dict[str, Callable[[], object]], only: Iterable[str] | None = None) -> dict[str, bool]:
    """Runs the chosen steps, each whatever became of those before; whether each went well."""
    done = {}
    for name, step in chosen(steps, only).items():
        try:
            step()
            done[name] = True
        except Exception as e:  # a step may fail in any way
            log.error("%s failed: %s", name, e)
            done[name] = False
    return done


def exit_code(done: dict[str, bool]) -> int:
    """0 if there was a step and none failed."""
    return 0 if done and all(done.values()) else 1


def with_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, which must have rows."""
    if df.isEmpty():
        raise Refused(f"{what}: no rows")
    return df


def filings_collected(universe: DataFrame, path: str, failures: str, what: str = "companyfacts", base: str = web.SERVICE, **options: object) -> dict[str, int]:
    """Lands the filings of the universe (``web.collected``); refused only where a run got nothing and had nothing."""
    done = web.collected(web.filing_requests(universe, what, base), path, failures, **options)
    if done["total"] and not done["fetched"] and not done["skipped"]:
        raise Refused(f"{what}: none of {done['total']} documents came")
    return done


@dataclass
class Panel:
    """``close``: ``ticker, date, close``; ``sectors``: ``ticker, sector``; ``dropped``: tickers without a bar."""

    close: DataFrame
    sectors: DataFrame
    dropped: DataFrame
    rebalances: DataFrame


def load_panel(universe: DataFrame, archive: DataFrame) -> Panel:
    """The archive's bars of the universe, under the universe's own tickers.

    The archive has vendor symbols (dashes for dots). Names that it lacks are dropped and listed:
    research never fills them from elsewhere.
    """
    names = universe.select(F.upper("ticker").alias("ticker"), "sector").withColumn("symbol", vendor_symbol(F.col("ticker")))
    close = archive.select(F.col("ticker").alias("symbol"), "date", "close").join(checked(names.select("symbol", "ticker")), "symbol").select("ticker", "date", "close")
    served = close.select("ticker").distinct()
    return Panel(close, names.join(served, "ticker", "left_semi").select("ticker", "sector"), names.join(served, "ticker", "left_anti").select("ticker"), prices.rebalances(close))


def base_first(read_base: Callable[[], DataFrame], vendor: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prices and each ticker's source. A base that can't be read in any way leaves the vendor's prices alone."""
    try:
        base = read_base().select("ticker", "date", "close")
        base.agg(F.count("close")).first()  # every file must be readable, not the first alone
    except Exception as e:
        log.warning("base prices can't be read, the vendor's are taken: %s", e)
        base = vendor.where("false").select("ticker", "date", "close")
    return prices.with_source(base, vendor.select("ticker", "date", "close"), wanted)


def ranked_factors(universe: DataFrame, bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """The scored universe: price signals at each name's last bar, fundamentals by ticker, guards, scores.

    Names without usable prices stay, with NULL signals and ``missing_prices``.
    """
    seen = prices.features(bars).groupBy("ticker").agg(F.max_by(F.struct("date", "n_bars", "ret_12_1", "ret_13w", "volatility_26w"), "date").alias("x"))
    rows = universe.join(seen, "ticker", "left").join(fundamentals, "ticker", "left")
    usable = F.col("x.n_bars") > 1
    out = rows.withColumns({c: F.when(usable, F.col(f"x.{c}")) for c in ("ret_12_1", "ret_13w", "volatility_26w")})
    out = out.withColumns({"price_asof": F.when(usable, F.date_format("x.date", "yyyy-MM-dd")), "data_quality": data_quality(F.col("x.n_bars"), F.col("ret_12_1"), F.col("ret_13w"), F.col("volatility_26w"))}).drop("x")
    out = out.withColumns({c: guarded(F.col(c), F.col("sector")) for c in ("ev_ebitda", "gpa") if c in out.columns})
    return scoring.build_scores(out)


def published(ranks: DataFrame | None, today: Column) -> dict[str, DataFrame]:
    """What the site shows; nothing for a ranking without rows."""
    if ranks is None:
        return {}
    return {"ranked_stocks": publish.objects(ranks), "leaders": publish.leaders(ranks), "market_summary": publish.summary(ranks).crossJoin(publish.recency(ranks, today)), "sectors": publish.counts(ranks, "sector"), "quality": publish.counts(ranks, "data_quality")}


def gates(facts: DataFrame, universe: DataFrame, ranks: DataFrame, concepts: tuple[str, ...], tickers: tuple[str, ...], concept: str = "revenues", as_of: Column | None = None) -> dict[str, DataFrame]:
    """Coverage by concept (shares of the enabled universe) and year, and the spot check of ``roe``.

    The check holds the ranking's return on equity against that of the facts known ``as_of`` a date
    (today): four quarters' net income by the latest equity.
    """
    size = max(1, universe.count())
    known = pit.as_known_at(facts.where(F.col("ticker").isin(*tickers)), F.current_date() if as_of is None else as_of)
    ours = known.select("ticker", ratio(F.col("net_income_ttm"), F.col("stockholders_equity")).alias("value"))
    return {
        "by_concept": guards.coverage(facts, concepts, size),
        "by_year": guards.coverage_by_year(facts, concept),
        "spot_check": guards.spot_check(ours, ranks.select("ticker", F.col("roe").alias("value")), tickers),
    }


def reconciliation(universe: DataFrame, archive: DataFrame, vendor: DataFrame, n: int = 15) -> DataFrame:
    """Every k-th of the universe's names (``n`` at most), its archive bars against the vendor's."""
    step = max(1, universe.count() // n)
    sample = numbered(universe.select("ticker"), [F.col("ticker")]).where((F.col("rank") - 1) % step == 0).where(F.col("rank") <= n * step)
    symbols = sample.select("ticker", vendor_symbol(F.col("ticker")).alias("symbol"))
    named = lambda bars: bars.withColumnRenamed("ticker", "symbol").join(F.broadcast(symbols), "symbol")  # noqa: E731  n rows
    return prices.reconciled(named(archive), named(vendor))


def backtested(panel: DataFrame, members: DataFrame | None, by: list[str], lag: int = backtest.LAG) -> dict[str, DataFrame]:
    """The result tables of ``panel(t, ticker, <by>, score, fwd)``; ``by`` has ``horizon`` among others.

    Without membership there is no bias table.
    """
    ics = backtest.information_coefficients(panel, [*by, "t"])
    spreads = backtest.quintile_spreads(panel, [*by, "t"])
    out = {
        "ic_summary": backtest.ic_summary(ics, by, lag).join(backtest.block_bootstrap(ics, by), by),
        "ic_series": ics,
        "quintiles": backtest.annualised(spreads, by, "spread").join(backtest.top_turnover(panel, by), by),
        "regimes": backtest.regime_means(ics, by),
        "decay": backtest.decay(ics, [c for c in by if c != "horizon"]),
    }
    if members is not None:
        out["bias"] = backtest.inclusion_bias(ics, backtest.information_coefficients(membership.eligible(panel, members), [*by, "t"]), by)
    return out


# The signals of a backtest, those of which less is better, and the buckets that they make.
PRICE_SIGNALS = ("ret_12_1", "ret_13w", "volatility_26w", "beta_52w")
FACT_SIGNALS = ("ep", "bp", "fcf_yield", "net_payout_yield", "gpa", "roe", "oper_margin", "ev_ebitda_yield")
LESS_IS_BETTER = ("volatility_26w", "beta_52w")
#: Decimals of signals and scores: names that differ by the order of a sum alone are tied.
DIGITS = 12
BACKTEST_BUCKETS = {
    "trend": ("ret_12_1", "ret_13w"),
    "risk": ("volatility_26w", "beta_52w"),
    "quality": ("gpa", "roe", "oper_margin"),
    "value": ("ep", "bp", "fcf_yield", "net_payout_yield", "ev_ebitda_yield"),
}


def signals_at(bars: DataFrame, facts: DataFrame | None, market: str, dates: DataFrame) -> DataFrame:
    """``t, ticker, factor, signal`` (higher is better): the union of names with prices and names with facts."""
    wide = prices.signals(bars, prices.market(bars, market), dates).drop("asof")
    names = [*PRICE_SIGNALS]
    if facts is not None:
        closes = bars.join(checked(dates.select(F.col("t"))), F.col("date") == F.col("t")).select("t", "ticker", "close")
        wide = wide.join(pit.signals(replay.as_known_on(facts, dates), closes), ["t", "ticker"], "full_outer")
        names += FACT_SIGNALS
    turned = wide.select("t", "ticker", *[F.round(-F.col(c) if c in LESS_IS_BETTER else F.col(c), DIGITS).alias(c) for c in names])
    return turned.unpivot(["t", "ticker"], names, "factor", "signal").where("signal IS NOT NULL")


def scored_signals(signals: DataFrame, sectors: DataFrame) -> DataFrame:
    """``t, ticker, factor, variant, score``: each signal's Gaussian rank, ``raw`` and sector-``neutral``."""
    own = ["factor", "t"]
    rows = signals.join(checked(sectors.select("ticker", "sector"), 128), "ticker", "left").withColumn("_g", gaussian_rank("signal", own))
    both = rows.withColumn("_z", sector_neutral("_g", "sector", own))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.round(c, DIGITS).alias("score")) for k, c in (("raw", "_g"), ("neutral", "_z"))]))
    return both.select("t", "ticker", "factor", kinds.alias("x")).select("t", "ticker", "factor", "x.*")


def backtested_from_bars(bars: DataFrame, facts: DataFrame | None, sectors: DataFrame, members: DataFrame | None, market: str, horizons: tuple[int, int] = (21, 63)) -> dict[str, DataFrame]:
    """The whole backtest from bars, facts and membership: every factor, variant and horizon as rows of one panel.

    Signals at all dates, scores and forward returns are computed once and written, and every result
    table begins there. Spreads, turnover, regimes, decay, bias and composites are of neutral scores;
    composites and all but the decay are of the nearer horizon. The bias is that of the price signals.
    """
    dates = written(prices.rebalances(bars).select("t"), "dates")
    scores = written(scored_signals(signals_at(bars, facts, market, dates), sectors), "scores")
    forward = written(prices.forward_returns(bars, dates, list(horizons)), "forward")
    grid = scores.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    panel = written(grid.join(forward, ["t", "ticker", "horizon"], "left"), "panel")
    by = ["factor", "variant", "horizon"]
    ics = written(backtest.information_coefficients(panel, [*by, "t"]), "ics")
    neutral = F.col("variant") == "neutral"
    near = neutral & (F.col("horizon") == horizons[0])
    spreads = backtest.quintile_spreads(panel.where(near), ["factor", "t"])
    out = {
        "ic_summary": backtest.ic_summary(ics, by).join(backtest.block_bootstrap(ics, by), by),
        "ic_series": ics,
        "spreads": spreads,
        "quintiles": backtest.annualised(spreads, ["factor"], "spread").join(backtest.top_turnover(panel.where(near), ["factor"]), "factor"),
        "regimes": backtest.regime_means(ics.where(near), ["factor"]),
        "decay": backtest.decay(ics.where(neutral), ["factor"], *horizons),
    }
    if members is not None:
        prices_only = F.col("factor").isin(*PRICE_SIGNALS)
        inside = backtest.information_coefficients(membership.eligible(panel.where(near & prices_only), members), ["factor", "t"])
        out["bias"] = backtest.inclusion_bias(ics.where(near & prices_only), inside, ["factor"])
    each = scores.where(neutral).groupBy("t", "ticker").pivot("factor", [f for b in BACKTEST_BUCKETS.values() for f in b]).agg(F.first("score"))
    slices = each.select("t", "ticker", *[row_mean(*map(F.col, fs)).alias(b) for b, fs in BACKTEST_BUCKETS.items()]).unpivot(["t", "ticker"], list(BACKTEST_BUCKETS), "bucket", "score")
    slices = written(slices.where("score IS NOT NULL"), "buckets")
    # a bucket takes part if each date has its signals' columns: facts have them once any is filed
    first = dates.agg(F.min("t")).first()[0]
    known = facts is not None and first is not None and (filed := facts.agg(F.min("filed")).first()[0]) is not None and filed <= first
    present = sorted(b for b in BACKTEST_BUCKETS if known or set(BACKTEST_BUCKETS[b]) <= set(PRICE_SIGNALS))
    if first is not None:
        slices = slices.where(F.col("bucket").isin(*present))
        weights = backtest.scheme_weights(slices, {"product": scoring.WEIGHTS["composite"], "literature": backtest.LITERATURE}, present)
        out["composites"] = backtest.scheme_results(slices, weights, forward.where(F.col("horizon") == horizons[0]))
    return out


def input_digests(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``input, file, bytes, sha256`` of the files (below 2 GB each) that a result depends on; NULL for what isn't there."""
    out = None
    for p in paths:
        try:
            files = spark.read.format("binaryFile").load(p).select(F.lit(p).alias("input"), F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        except AnalysisException:
            files = spark.range(1).select(F.lit(p).alias("input"), *[F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("bytes", "long"), ("sha256", "string"))])
        out = files if out is None else out.unionByName(files)
    return out
