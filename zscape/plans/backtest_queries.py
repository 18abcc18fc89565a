"""Prices, features, information coefficients and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import backtest, membership, prices
from .registry import Registry, avg_rank_sql, erc_sql, r6, rounded, sr6

R = Registry()
#: The Friday on or after a date.
WEEK_SQL = "CAST(date + CAST((5 - isodow(date) + 7) % 7 AS INT) AS DATE)"

_WEEKLY = f"w AS (SELECT ticker, {WEEK_SQL} AS week, arg_max(close, date) AS close FROM prices GROUP BY 1, 2), ws AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY week) AS seq FROM w)"
_CAL = "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM prices))"
_ENDS = "ends AS (SELECT max(date) AS t FROM prices GROUP BY date_trunc('month', date))"
_REB = _CAL + ", " + _ENDS + ", reb AS (SELECT t, pos FROM ends JOIN cal ON t = date WHERE pos + 1 >= 253 AND n - 1 - pos >= 21)"
_FEATURES = (
    _WEEKLY + ", lw AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY week)) AS lr FROM ws), "
    f"bars AS (SELECT ticker, date, close, {WEEK_SQL} AS week, row_number() OVER o AS n_bars, lag(close, 21) OVER o AS m, lag(close, 252) OVER o AS y FROM prices WINDOW o AS (PARTITION BY ticker ORDER BY date)), "
    "f AS (SELECT b.ticker, b.date, b.close, n_bars, round(m / nullif(y, 0) - 1, 6) AS ret_12_1, "
    "round(b.close / nullif((SELECT close FROM ws p WHERE p.ticker = b.ticker AND p.seq = l.seq - 13), 0) - 1, 6) AS ret_13w, l.seq, b.week FROM bars b JOIN lw l ON b.ticker = l.ticker AND b.week = l.week)"
)


def _asof_features(p: DataFrame) -> DataFrame:
    return prices.as_of(prices.features(p), prices.rebalances(p), ["ret_12_1", "ret_13w", "volatility_26w"])


R.add("wn10_month_ends", "prices", prices.month_ends, f", {_ENDS} SELECT t FROM ends")
R.add("fl7_testable_rebalances", "prices", lambda p: prices.rebalances(p), f", {_REB} SELECT t, pos FROM reb")
R.add("wn8_weekly_bars", "prices", prices.weekly, f", {_WEEKLY} SELECT ticker, week, close, seq FROM ws")
R.add("wn9_weekly_returns", "prices", lambda p: rounded(prices.weekly_returns(p, 52), "ret"), f", {_WEEKLY}, x AS (SELECT ticker, week, close / lag(close) OVER (PARTITION BY ticker ORDER BY week) - 1 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY week DESC) AS back FROM ws) SELECT ticker, week, {sr6('ret')} AS ret FROM x WHERE back <= 52 AND ret IS NOT NULL")
R.add("wn5_return_12_1", "prices", lambda p: prices.features(p).select("ticker", "date", "n_bars", r6("ret_12_1").alias("ret_12_1")), ", x AS (SELECT ticker, date, row_number() OVER o AS n_bars, lag(close, 21) OVER o / nullif(lag(close, 252) OVER o, 0) - 1 AS r FROM prices WINDOW o AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, date, n_bars, " + sr6("r") + " AS ret_12_1 FROM x")
R.add("wn6_return_13w", "prices", lambda p: prices.features(p).select("ticker", "date", r6("ret_13w").alias("ret_13w")), f", {_WEEKLY} SELECT p.ticker, p.date, {sr6('p.close / nullif(b.close, 0) - 1')} AS ret_13w FROM prices p JOIN ws c ON p.ticker = c.ticker AND c.week = {WEEK_SQL.replace('date', 'p.date')} LEFT JOIN ws b ON b.ticker = p.ticker AND b.seq = c.seq - 13")
R.add(
    "wn7_volatility_26w",
    "prices",
    lambda p: prices.features(p).select("ticker", "date", F.col("volatility_26w").alias("vol")),
    f", {_WEEKLY}, l AS (SELECT ticker, week, seq, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY week)) AS lr, lag(close) OVER (PARTITION BY ticker ORDER BY week) AS before FROM ws), "
    "k AS (SELECT *, sum(lr) OVER o AS s1, sum(lr * lr) OVER o AS s2 FROM l WINDOW o AS (PARTITION BY ticker ORDER BY week ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)), "
    f"d AS (SELECT p.ticker, p.date, c.seq, s1, s2, ln(p.close / c.before) AS now FROM prices p JOIN k c ON p.ticker = c.ticker AND c.week = {WEEK_SQL.replace('date', 'p.date')}) "
    "SELECT ticker, date, CASE WHEN seq > 26 THEN round(sqrt(greatest((s2 + now * now) / 26 - ((s1 + now) / 26) * ((s1 + now) / 26), 0.0) * 52), 6) END AS vol FROM d",
)
R.add("jn5_as_of_bars", "prices", lambda p: prices.as_of(p, prices.month_ends(p), ["close"]).select("t", "ticker", "asof", r6("close").alias("close")), f", {_ENDS} SELECT t, e.ticker, p.date AS asof, {sr6('p.close')} AS close FROM (SELECT t, ticker FROM ends CROSS JOIN (SELECT DISTINCT ticker FROM prices)) e ASOF JOIN prices p ON e.ticker = p.ticker AND e.t >= p.date")
R.add("wn11_forward_return", "prices", lambda p: rounded(prices.forward_returns(p, prices.rebalances(p), [21, 63]), "fwd"), f", {_REB} SELECT t, p.ticker, h AS horizon, {sr6('q.close / nullif(p.close, 0) - 1')} AS fwd FROM reb JOIN prices p ON p.date = t CROSS JOIN (VALUES (21), (63)) v(h) LEFT JOIN cal c ON c.pos = reb.pos + h LEFT JOIN prices q ON q.ticker = p.ticker AND q.date = c.date")
R.add("jn20_forward_positions", "prices", lambda p: prices.forward_returns(p, prices.month_ends(p), [1]).groupBy("t").agg(F.count("fwd").alias("n"), F.count("*").alias("names")), f", {_CAL}, {_ENDS} SELECT t, count(q.close) AS n, count(*) AS names FROM ends JOIN cal a ON a.date = t JOIN prices p ON p.date = t LEFT JOIN cal c ON c.pos = a.pos + 1 LEFT JOIN prices q ON q.ticker = p.ticker AND q.date = c.date GROUP BY t")
_EW = f"days AS (SELECT DISTINCT date FROM prices), grid AS (SELECT t.ticker, d.date, last_value(p.close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.date) AS close FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN days d LEFT JOIN prices p ON p.ticker = t.ticker AND p.date = d.date), dr AS (SELECT date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM grid), dm AS (SELECT date, avg(r) AS r FROM dr GROUP BY date), ew AS (SELECT {WEEK_SQL} AS week, coalesce(product(1 + r), 1) - 1 AS ret FROM dm GROUP BY 1)"
_PROXY = f"{_WEEKLY}, mk AS (SELECT week, close / lag(close) OVER (ORDER BY week) - 1 AS ret FROM ws WHERE ticker = 'Brand#11')"
R.add("ag28_market_daily_mean", "prices", lambda p: rounded(prices.equal_weight_market(p), "ret"), f", {_EW} SELECT week, {sr6('ret')} AS ret FROM ew")
R.add("ag29_weekly_product", "prices", lambda p: prices.equal_weight_market(p).select(r6(F.sum("ret")).alias("total"), F.count("*").alias("weeks")), f", {_EW} SELECT {sr6('sum(ret)')} AS total, count(*) AS weeks FROM ew")
R.add("sc5_market_proxy", "prices", lambda p: rounded(prices.proxy_market(p, "Brand#11"), "ret"), f", {_PROXY} SELECT week, {sr6('ret')} AS ret FROM mk WHERE ret IS NOT NULL")
R.add("cp12_market_fallback", "prices", lambda p: rounded(prices.market(p, "NONE"), "ret"), f", {_EW} SELECT week, {sr6('ret')} AS ret FROM ew")
_T = "DATE '2001-05-30'"
_BETA = _PROXY + f", seen AS (SELECT * FROM prices WHERE date <= {_T}), sw AS (SELECT ticker, {WEEK_SQL} AS week, arg_max(close, date) AS close FROM seen GROUP BY 1, 2), sr AS (SELECT ticker, week, close / lag(close) OVER (PARTITION BY ticker ORDER BY week) - 1 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY week DESC) AS back FROM sw), j AS (SELECT sr.ticker, sr.week, sr.ret, mk.ret AS m FROM sr JOIN mk ON sr.week = mk.week WHERE back <= 52 AND sr.ret IS NOT NULL AND mk.ret IS NOT NULL AND mk.week <= {_T})"
R.add("ag8_beta", "prices", lambda p: rounded(prices.beta(p, prices.market(p, "Brand#11"), F.lit("2001-05-30").cast("date")), "beta"), f", {_BETA} SELECT ticker, count(*) AS n, {sr6('CASE WHEN count(*) >= 30 AND var_pop(m) >= 1e-12 THEN covar_pop(ret, m) / var_pop(m) END')} AS beta FROM j GROUP BY ticker")
# beta and volatility at every rebalance: each ticker's weeks as they stood at t
_SEEN_T = f"sn AS (SELECT t, p.* FROM reb JOIN prices p ON p.date <= t), sw AS (SELECT t, ticker, {WEEK_SQL} AS week, arg_max(close, date) AS close FROM sn GROUP BY 1, 2, 3), sr AS (SELECT *, close / lag(close) OVER o - 1 AS ret, ln(close / lag(close) OVER o) AS lr, row_number() OVER (PARTITION BY t, ticker ORDER BY week DESC) AS back, count(*) OVER (PARTITION BY t, ticker) AS weeks FROM sw WINDOW o AS (PARTITION BY t, ticker ORDER BY week))"
_BETA_T = f"bt AS (SELECT t, sr.ticker, count(*) AS n, CASE WHEN count(*) >= 30 AND var_pop(mk.ret) >= 1e-12 THEN covar_pop(sr.ret, mk.ret) / var_pop(mk.ret) END AS beta FROM sr JOIN mk ON sr.week = mk.week AND mk.week <= t WHERE back <= 52 AND sr.ret IS NOT NULL AND mk.ret IS NOT NULL GROUP BY 1, 2)"
_VOL_T = "vt AS (SELECT t, ticker, CASE WHEN max(weeks) > 26 THEN stddev_pop(lr) * sqrt(52) END AS vol FROM sr WHERE back <= 26 GROUP BY 1, 2)"
_SIGNALS_T = f"b AS (SELECT t, f.ticker, max(f.date) AS last FROM reb JOIN f ON f.date <= t GROUP BY 1, 2), sg AS (SELECT b.t, b.ticker, last, ret_12_1, ret_13w, vol, beta FROM b JOIN f ON f.ticker = b.ticker AND f.date = last JOIN vt ON vt.t = b.t AND vt.ticker = b.ticker LEFT JOIN bt ON bt.t = b.t AND bt.ticker = b.ticker)"


def _signals(p: DataFrame) -> DataFrame:
    return prices.signals(p, prices.market(p, "Brand#11"), prices.rebalances(p))


R.add("ag8_rolling_betas", "prices", lambda p: rounded(prices.betas(p, prices.market(p, "Brand#11"), prices.rebalances(p)), "beta_52w"), f", {_REB}, {_PROXY}, {_SEEN_T}, {_BETA_T} SELECT k.t, k.ticker, coalesce(n, 0) AS n, {sr6('beta')} AS beta_52w FROM (SELECT DISTINCT t, ticker FROM sw) k LEFT JOIN bt ON bt.t = k.t AND bt.ticker = k.ticker")
R.add("cp11_price_signals", "prices", lambda p: rounded(_signals(p), "ret_12_1", "ret_13w", "volatility_26w", "beta_52w"), f", {_REB}, {_FEATURES}, {_PROXY.replace(_WEEKLY + ', ', '')}, {_SEEN_T}, {_BETA_T}, {_VOL_T}, {_SIGNALS_T} SELECT t, ticker, last AS \"asof\", {sr6('ret_12_1')} AS ret_12_1, {sr6('ret_13w')} AS ret_13w, {sr6('vol')} AS volatility_26w, {sr6('beta')} AS beta_52w FROM sg")
R.add("jn3_weekly_join", "prices", lambda p: prices.weekly_returns(p).join(prices.proxy_market(p, "Brand#11").withColumnRenamed("ret", "m"), "week").groupBy("ticker").agg(F.count("*").alias("n"), r6(F.corr("ret", "m")).alias("corr")), f", {_PROXY}, sr AS (SELECT ticker, week, close / lag(close) OVER (PARTITION BY ticker ORDER BY week) - 1 AS ret FROM ws) SELECT ticker, count(*) AS n, {sr6('corr(sr.ret, mk.ret)')} AS corr FROM sr JOIN mk USING (week) WHERE sr.ret IS NOT NULL AND mk.ret IS NOT NULL GROUP BY ticker")

_RANKED = lambda src, by: f"b AS (SELECT * FROM {src} WHERE score IS NOT NULL AND fwd IS NOT NULL), rk AS (SELECT *, {avg_rank_sql('score', by)} AS ra, {avg_rank_sql('fwd', by)} AS rb FROM b), ic AS (SELECT {by}, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(ra) >= 1e-12 AND stddev_pop(rb) >= 1e-12 THEN (count(*) * sum(ra * rb) - sum(ra) * sum(rb)) / sqrt(count(*) * sum(ra * ra) - sum(ra) * sum(ra)) / sqrt(count(*) * sum(rb * rb) - sum(rb) * sum(rb)) END AS ic FROM rk GROUP BY {by})"
_IC, _ICP = _RANKED("slices", "t"), _RANKED("panel", "factor, horizon, t")
FH = ["factor", "horizon"]


def _ics(p: DataFrame) -> DataFrame:
    return backtest.information_coefficients(p, [*FH, "t"])


R.add("ag9_spearman_ic", "slices", lambda s: rounded(backtest.information_coefficients(s, ["t"]), "ic"), f", {_IC} SELECT t, n, {sr6('ic')} AS ic FROM ic")
R.add("jn1_score_forward_join", "slices", lambda s: s.select("t", "ticker", "score").join(s.select("t", "ticker", "fwd"), ["t", "ticker"]).dropna("any", subset=["score", "fwd"]).groupBy("t").agg(F.count("*").alias("n")), " SELECT t, count(*) AS n FROM slices WHERE score IS NOT NULL AND fwd IS NOT NULL GROUP BY t")
_NW = "xs AS (SELECT *, ic - avg(ic) OVER (PARTITION BY factor, horizon) AS x FROM ic WHERE ic IS NOT NULL), ls AS (SELECT *, lag(x, 1) OVER o AS l1, lag(x, 2) OVER o AS l2, lag(x, 3) OVER o AS l3 FROM xs WINDOW o AS (PARTITION BY factor, horizon ORDER BY t)), nw AS (SELECT factor, horizon, count(*) AS n, (sum(x * x) + 2 * (3e0 / 4 * coalesce(sum(x * l1), 0) + 2e0 / 4 * coalesce(sum(x * l2), 0) + 1e0 / 4 * coalesce(sum(x * l3), 0))) / count(*) AS lrv FROM ls GROUP BY 1, 2), se AS (SELECT factor, horizon, CASE WHEN n >= 2 AND lrv > 0 THEN sqrt(lrv / n) END AS se_nw FROM nw)"
R.add("ag10_newey_west", "panel", lambda p: rounded(backtest.newey_west(_ics(p), FH), "se_nw"), f", {_ICP}, {_NW} SELECT factor, horizon, {sr6('se_nw')} AS se_nw FROM se")
_SUM = "sm AS (SELECT factor, horizon, count(*) AS n, avg(ic) AS mean, CASE WHEN stddev_samp(ic) > 0 THEN stddev_samp(ic) END AS sd, avg(CASE WHEN ic > 0 THEN 100e0 ELSE 0e0 END) AS pct_pos FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2)"
R.add("ag11_ic_summary", "panel", lambda p: rounded(backtest.ic_summary(_ics(p), FH), "mean", "std", "t_stat", "t_nw", "pct_pos", "ic_for_t2"), f", {_ICP}, {_NW}, {_SUM} SELECT factor, horizon, n, {sr6('mean')} AS mean, {sr6('sd')} AS std, {sr6('mean / (sd / sqrt(n))')} AS t_stat, {sr6('mean / se_nw')} AS t_nw, {sr6('pct_pos')} AS pct_pos, {sr6('2 * sd / sqrt(n)')} AS ic_for_t2 FROM sm JOIN se USING (factor, horizon)")
R.add("ag12_block_bootstrap", "panel", lambda p: rounded(backtest.block_bootstrap(_ics(p), FH), "ci_lo", "ci_hi"))
R.add("ag22_median_precision", "panel", lambda p: backtest.ic_summary(_ics(p), FH).agg(r6(F.median("std")).alias("std"), r6(F.median("ic_for_t2")).alias("ic_for_t2")), f", {_ICP}, {_SUM} SELECT {sr6('median(sd)')} AS std, {sr6('median(2 * sd / sqrt(n))')} AS ic_for_t2 FROM sm")
_LAB = "lb AS (SELECT *, CASE WHEN count(score) OVER (PARTITION BY t) >= 5 THEN greatest(1, ceil((row_number() OVER (PARTITION BY t, score IS NULL ORDER BY score, ticker) - 1) * 5 / (count(score) OVER (PARTITION BY t) - 1)))::INT END AS q FROM slices WHERE score IS NOT NULL)"
_SPREAD = _LAB + ", sp AS (SELECT t, " + ", ".join(f"avg(fwd) FILTER (q = {k}) AS q{k}" for k in range(1, 6)) + " FROM lb WHERE q IS NOT NULL AND fwd IS NOT NULL GROUP BY t HAVING count(DISTINCT q) = 5)"
R.add("ag15_quintile_spread", "slices", lambda s: rounded(backtest.quintile_spreads(s, ["t"]), "q1", "q2", "q3", "q4", "q5", "spread"), f", {_SPREAD} SELECT t, " + ", ".join(f"{sr6(f'q{k}')} AS q{k}" for k in range(1, 6)) + f", {sr6('q5 - q1')} AS spread FROM sp")
R.add("jn2_labels_forward_join", "slices", lambda s: backtest.quintile_spreads(s, ["t"]).agg(F.count("*").alias("n")), f", {_SPREAD} SELECT count(*) AS n FROM sp")


def _annual(s: DataFrame) -> DataFrame:
    return backtest.annualised(backtest.quintile_spreads(s, ["t"]).withColumn("book", F.lit("spread")), ["book"], "spread")


_EQ = _SPREAD + ", eq AS (SELECT t, q5 - q1 AS r, product(1 + q5 - q1) OVER (ORDER BY t) AS equity FROM sp), pk AS (SELECT *, max(equity) OVER (ORDER BY t) AS peak FROM eq)"
R.add("ag13_annualised", "slices", lambda s: rounded(_annual(s).drop("max_drawdown"), "ann_ret", "ann_vol"), f", {_EQ} SELECT 'spread' AS book, count(*) AS n, {sr6('power(product(1 + r), 12.0::DOUBLE / count(*)) - 1')} AS ann_ret, {sr6('stddev_samp(r) * sqrt(12)')} AS ann_vol FROM eq")
R.add("ag14_max_drawdown", "slices", lambda s: rounded(_annual(s).select("book", "max_drawdown"), "max_drawdown"), f", {_EQ} SELECT 'spread' AS book, {sr6('min(equity / peak - 1)')} AS max_drawdown FROM pk")
R.add("ag16_quintile_stats", "slices", lambda s: rounded(backtest.annualised(backtest.quintile_spreads(s, ["t"]).withColumn("book", F.lit("q5")), ["book"], "q5"), "ann_ret", "ann_vol", "max_drawdown"), f", {_SPREAD}, eq AS (SELECT t, q5 AS r, product(1 + q5) OVER (ORDER BY t) AS equity FROM sp), pk AS (SELECT *, max(equity) OVER (ORDER BY t) AS peak FROM eq) SELECT 'q5' AS book, count(*) AS n, {sr6('power(product(1 + r), 12.0::DOUBLE / count(*)) - 1')} AS ann_ret, {sr6('stddev_samp(r) * sqrt(12)')} AS ann_vol, {sr6('min(equity / peak - 1)')} AS max_drawdown FROM pk")
R.add("wn13_running_peak", "slices", lambda s: _running(s), f", {_EQ} SELECT t, {sr6('equity')} AS equity, {sr6('peak')} AS peak FROM pk")


def _running(s: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("book").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    x = backtest.quintile_spreads(s, ["t"]).withColumn("book", F.lit(1)).withColumn("equity", F.product(1 + F.col("spread")).over(own))
    return rounded(x.withColumn("peak", F.max("equity").over(own)).select("t", "equity", "peak"), "equity", "peak")


_BOOK = _LAB + ", bk AS (SELECT t, ticker FROM lb WHERE q = 5), dt AS (SELECT t, lag(t) OVER (ORDER BY t) AS prev FROM (SELECT DISTINCT t FROM bk)), tn AS (SELECT bk.t, avg(CASE WHEN p.ticker IS NULL THEN 1.0 ELSE 0.0 END) AS new FROM bk JOIN dt ON bk.t = dt.t AND prev IS NOT NULL LEFT JOIN bk p ON p.t = dt.prev AND p.ticker = bk.ticker GROUP BY bk.t)"
R.add("ag17_top_turnover", "slices", lambda s: rounded(backtest.top_turnover(s.withColumn("book", F.lit("all")), ["book"]), "turnover"), f", {_BOOK} SELECT 'all' AS book, {sr6('avg(new)')} AS turnover FROM tn")
R.add("so6_book_difference", "slices", lambda s: backtest.book_changes(s.withColumn("book", F.lit("all")), ["book"]).where("NOT was").select("t", "ticker"), f", {_BOOK} SELECT bk.t, bk.ticker FROM bk JOIN dt ON bk.t = dt.t AND prev IS NOT NULL LEFT JOIN bk p ON p.t = dt.prev AND p.ticker = bk.ticker WHERE p.ticker IS NULL")
_HALVES = (
    "lb2 AS (SELECT *, CAST(ticker AS INT) % 2 AS half, CASE WHEN count(score) OVER w >= 2 THEN greatest(1, ceil((row_number() OVER (PARTITION BY CAST(ticker AS INT) % 2, t ORDER BY score, ticker) - 1) * 2 / (count(score) OVER w - 1)))::INT END AS q FROM slices WHERE score IS NOT NULL WINDOW w AS (PARTITION BY CAST(ticker AS INT) % 2, t)), "
    "bk2 AS (SELECT half, t, ticker FROM lb2 WHERE q = 2), dt2 AS (SELECT half, t, lag(t) OVER (PARTITION BY half ORDER BY t) AS prev FROM (SELECT DISTINCT half, t FROM bk2)), "
    "tn2 AS (SELECT a.half, a.t, avg(CASE WHEN p.ticker IS NULL THEN 1.0 ELSE 0.0 END) AS new FROM bk2 a JOIN dt2 d ON a.half = d.half AND a.t = d.t AND prev IS NOT NULL LEFT JOIN bk2 p ON p.half = a.half AND p.t = d.prev AND p.ticker = a.ticker GROUP BY 1, 2)"
)
R.add("wn14_previous_book", "slices", lambda s: rounded(backtest.top_turnover(s.withColumn("half", F.col("ticker").cast("int") % 2), ["half"], 2), "turnover"), f", {_HALVES} SELECT half, {sr6('avg(new)')} AS turnover FROM tn2 GROUP BY half")
_REGIMES = {"a": ("1995-01-01", "1996-12-31"), "b": ("1998-01-01", "1999-06-30")}
R.add("ag18_regime_means", "panel", lambda p: rounded(backtest.regime_means(_ics(p), FH, _REGIMES), "a_mean", "b_mean"), f", {_ICP} SELECT factor, horizon, " + ", ".join(f"{sr6(f'''avg(ic) FILTER (t BETWEEN DATE '{a}' AND DATE '{b}')''')} AS {k}_mean, count(ic) FILTER (t BETWEEN DATE '{a}' AND DATE '{b}') AS {k}_n" for k, (a, b) in _REGIMES.items()) + " FROM ic GROUP BY 1, 2")
R.add("fl8_regime_window", "panel", lambda p: backtest.regime_means(_ics(p), ["factor"], backtest.REGIMES).select("factor", *[f"{k}_n" for k in backtest.REGIMES]), f", {_ICP} SELECT factor, " + ", ".join(f"count(ic) FILTER (t BETWEEN DATE '{a}' AND DATE '{b}') AS {k}_n" for k, (a, b) in backtest.REGIMES.items()) + " FROM ic GROUP BY 1")
R.add("ag19_ic_decay", "panel", lambda p: rounded(backtest.decay(_ics(p), ["factor"]), "mean_21", "mean_63"), f", {_ICP} SELECT factor, " + ", ".join(f"{sr6(f'avg(ic) FILTER (horizon = {h})')} AS mean_{h}, count(ic) FILTER (horizon = {h}) AS n_{h}" for h in (21, 63)) + " FROM ic GROUP BY 1")
_MEM = "mb AS (SELECT s.* FROM {0} s JOIN members m ON s.ticker = m.ticker AND (added_date IS NULL OR added_date <= t))"
R.add("fl3_membership_filter", "slices members", lambda s, m: membership.eligible(s, m).select("t", "ticker"), f", {_MEM.format('slices')} SELECT t, ticker FROM mb")
R.add("jn4_membership_mask", "slices members", lambda s, m: membership.eligible(s, m).groupBy("t").agg(F.count("*").alias("n")), f", {_MEM.format('slices')} SELECT t, count(*) AS n FROM mb GROUP BY t")
R.add("fl4_excluded_count", "slices members", membership.excluded, f", {_MEM.format('slices')}, k AS (SELECT t, count(*) AS kept FROM mb GROUP BY t) SELECT t, count(*) - coalesce(max(kept), 0) AS excluded FROM slices LEFT JOIN k USING (t) GROUP BY t")
R.add("ag21_average_excluded", "slices members", lambda s, m: membership.excluded(s, m).agg(r6(F.avg("excluded")).alias("excluded")), f", {_MEM.format('slices')} SELECT {sr6('((SELECT count(*) FROM slices) - (SELECT count(*) FROM mb)) / (SELECT count(DISTINCT t) FROM slices)')} AS excluded")
_IC2 = _RANKED("mb", "factor, horizon, t").replace("b AS (", "b2 AS (").replace("FROM b)", "FROM b2)").replace("rk AS", "rk2 AS").replace("FROM rk ", "FROM rk2 ").replace("ic AS (SELECT factor", "ic2 AS (SELECT factor")
R.add("ag20_inclusion_bias", "panel members", lambda p, m: rounded(backtest.inclusion_bias(_ics(p), _ics(membership.eligible(p, m)), FH), "unfiltered", "filtered", "bias"), f", {_MEM.format('panel')}, {_ICP}, {_IC2}, u AS (SELECT factor, horizon, avg(ic) AS u FROM ic GROUP BY 1, 2), v AS (SELECT factor, horizon, avg(ic) AS v FROM ic2 GROUP BY 1, 2) SELECT factor, horizon, {sr6('u')} AS unfiltered, {sr6('v')} AS filtered, {sr6('u - v')} AS bias FROM u JOIN v USING (factor, horizon)")
_SCHEMES = {"product": {"trend": 0.3334, "quality": 0.3333, "value": 0.3333}, "literature": backtest.LITERATURE}
_CS = lambda ws: "CASE WHEN coalesce(trend, quality, value) IS NOT NULL THEN (" + " + ".join(f"coalesce({k}, 0) * {w / sum(v for n, v in ws.items() if n != 'risk')!r}::DOUBLE" for k, w in ws.items() if k != "risk") + ") END"
R.add("cp9_composite_experiment", "blends", lambda b: rounded(backtest.experiment(b, _SCHEMES), "ic"), ", sc AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scheme, t, ticker, {_CS(w)} AS score, fwd FROM blends" for k, w in _SCHEMES.items()) + f"), {_RANKED('sc', 'scheme, t')} SELECT scheme, t, n, {sr6('ic')} AS ic FROM ic")
# schemes as rows of weights: two that are given, one that is solved


def _bucket_rows(b: DataFrame) -> DataFrame:
    return b.unpivot(["t", "ticker"], ["trend", "quality", "value"], "bucket", "score").where("score IS NOT NULL")


def _scheme_results(b: DataFrame) -> DataFrame:
    rows, names = _bucket_rows(b), ["quality", "trend", "value"]
    return rounded(backtest.scheme_results(rows, backtest.scheme_weights(rows, _SCHEMES, names), b), "mean", "t_stat", "t_nw", "ann_return")


def results_sql(source: str, by: str, tag: str) -> str:
    """CTEs ``ic``, ``se``, ``sm`` and ``an`` (suffixed by ``tag``) of ``source(<by>, t, ticker, score, fwd)``."""
    n = len(by.split(","))
    key = ", ".join(str(i + 1) for i in range(n))
    own = f"PARTITION BY {by}, t"
    return (
        f"b{tag} AS (SELECT * FROM {source} WHERE score IS NOT NULL AND fwd IS NOT NULL), rk{tag} AS (SELECT *, {avg_rank_sql('score', by + ', t')} AS ra, {avg_rank_sql('fwd', by + ', t')} AS rb FROM b{tag}), "
        f"ic{tag} AS (SELECT {by}, t, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(ra) >= 1e-12 AND stddev_pop(rb) >= 1e-12 THEN (count(*) * sum(ra * rb) - sum(ra) * sum(rb)) / sqrt(count(*) * sum(ra * ra) - sum(ra) * sum(ra)) / sqrt(count(*) * sum(rb * rb) - sum(rb) * sum(rb)) END AS ic FROM rk{tag} GROUP BY {by}, t), "
        f"xs{tag} AS (SELECT *, ic - avg(ic) OVER (PARTITION BY {by}) AS x FROM ic{tag} WHERE ic IS NOT NULL), ls{tag} AS (SELECT *, lag(x, 1) OVER o AS l1, lag(x, 2) OVER o AS l2, lag(x, 3) OVER o AS l3 FROM xs{tag} WINDOW o AS (PARTITION BY {by} ORDER BY t)), "
        f"sm{tag} AS (SELECT {by}, count(*) AS n, avg(ic) AS mean, CASE WHEN stddev_samp(ic) > 0 THEN stddev_samp(ic) END AS sd, avg(CASE WHEN ic > 0 THEN 100e0 ELSE 0e0 END) AS pct_pos, (sum(x * x) + 2 * (3e0 / 4 * coalesce(sum(x * l1), 0) + 2e0 / 4 * coalesce(sum(x * l2), 0) + 1e0 / 4 * coalesce(sum(x * l3), 0))) / count(*) AS lrv FROM ls{tag} GROUP BY {key}), "
        f"lb{tag} AS (SELECT *, CASE WHEN count(score) OVER ({own}) >= 5 THEN greatest(1, ceil((row_number() OVER ({own} ORDER BY score, ticker) - 1) * 5 / (count(score) OVER ({own}) - 1)))::INT END AS q FROM {source} WHERE score IS NOT NULL), "
        f"sp{tag} AS (SELECT {by}, t, avg(fwd) FILTER (q = 5) - avg(fwd) FILTER (q = 1) AS r FROM lb{tag} WHERE q IS NOT NULL AND fwd IS NOT NULL GROUP BY {by}, t HAVING count(DISTINCT q) = 5), "
        f"eq{tag} AS (SELECT *, product(1 + r) OVER (PARTITION BY {by} ORDER BY t) AS equity FROM sp{tag}), "
        f"pk{tag} AS (SELECT *, max(equity) OVER (PARTITION BY {by} ORDER BY t) AS peak FROM eq{tag}), "
        f"an{tag} AS (SELECT {by}, power(product(1 + r), 12.0::DOUBLE / count(*)) - 1 AS ann, min(equity / peak - 1) AS drawdown FROM pk{tag} GROUP BY {key})"
    )


_T_NW = "mean / (CASE WHEN sm{0}.n >= 2 AND lrv > 0 THEN sqrt(lrv / sm{0}.n) END)"
_MIX = lambda ws: "coalesce(trend, 0) * " + f"{ws[0]} + coalesce(quality, 0) * {ws[1]} + coalesce(value, 0) * {ws[2]}"
_NAMED = {k: [f"{v / sum(x for n, x in ws.items() if n != 'risk')!r}::DOUBLE" for n, v in ws.items() if n != "risk"] for k, ws in _SCHEMES.items()} | {"variance_share": ["w0", "w1", "w2"]}
R.add(
    "cp9_scheme_results",
    "blends",
    _scheme_results,
    ", d AS (SELECT * FROM blends WHERE trend IS NOT NULL AND quality IS NOT NULL AND value IS NOT NULL), " + erc_sql("d", ["trend", "quality", "value"])
    + ", sc AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scheme, t, ticker, CASE WHEN coalesce(trend, quality, value) IS NOT NULL THEN {_MIX(ws)} END AS score, fwd FROM blends, erc" for k, ws in _NAMED.items())
    + f"), {results_sql('sc', 'scheme', '_s')} SELECT sm_s.scheme, n, {sr6('mean')} AS mean, {sr6('mean / (sd / sqrt(n))')} AS t_stat, {sr6(_T_NW.format('_s'))} AS t_nw, {sr6('ann')} AS ann_return FROM sm_s LEFT JOIN an_s USING (scheme)",
)
R.oracles["cp9_scheme_results"] = R.oracles["cp9_scheme_results"].replace("WITH ", "WITH RECURSIVE ", 1)
R.add("so3_bucket_intersection", "slices", lambda s: backtest.bucket_coverage(s.withColumnRenamed("ticker", "bucket")), " SELECT ticker AS bucket FROM slices WHERE score IS NOT NULL GROUP BY ticker HAVING count(DISTINCT t) = (SELECT count(DISTINCT t) FROM slices)")
R.add("so5_stack_dropna", "blends", lambda b: b.dropna("any").groupBy("t").agg(F.count("*").alias("n")), " SELECT t, count(*) AS n FROM blends WHERE trend IS NOT NULL AND quality IS NOT NULL AND value IS NOT NULL AND fwd IS NOT NULL GROUP BY t")
R.add("nj11_flatten_results", "blends", lambda b: b.unpivot(["t", "ticker"], ["trend", "quality", "value"], "bucket", "score").where("score IS NOT NULL").withColumn("score", r6("score")), f" SELECT t, ticker, bucket, {sr6('score')} AS score FROM (UNPIVOT (SELECT t, ticker, trend, quality, value FROM blends) ON trend, quality, value INTO NAME bucket VALUE score)")
R.add("sc4_price_panel", "base_prices vendor_prices prices", lambda b, v, p: prices.with_source(b, v, p.select("ticker"))[0].groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("last")), ", s AS (SELECT ticker, date FROM base_prices UNION ALL SELECT ticker, date FROM vendor_prices WHERE ticker NOT IN (SELECT ticker FROM base_prices)) SELECT ticker, count(*) AS n, max(date) AS last FROM s GROUP BY 1")
R.add("jn16_source_precedence", "base_prices vendor_prices prices", lambda b, v, p: prices.with_source(b, v, p)[1], " SELECT DISTINCT ticker, CASE WHEN ticker IN (SELECT ticker FROM base_prices) THEN 'base' WHEN ticker IN (SELECT ticker FROM vendor_prices) THEN 'fetch' ELSE 'missing' END AS source FROM prices")
R.add("jn18_missing_tickers", "prices base_prices", lambda p, b: p.select("ticker").distinct().join(b, "ticker", "left_anti"), " SELECT DISTINCT ticker FROM prices WHERE ticker NOT IN (SELECT ticker FROM base_prices)")
R.add("jn17_vendor_overlap", "prices vendor_prices", lambda p, v: p.join(v.select("ticker", "date"), ["ticker", "date"], "left_semi").groupBy("ticker").agg(F.count("*").alias("n")), " SELECT ticker, count(*) AS n FROM prices JOIN vendor_prices USING (ticker, date) GROUP BY 1")
R.add("ag25_reconciliation", "prices vendor_prices", lambda p, v: rounded(prices.reconciled(p, v).drop("worst"), "max_diff"), f" SELECT ticker, count(*) AS n, {sr6('max(abs(p.close / v.close - 1))')} AS max_diff FROM prices p JOIN vendor_prices v USING (ticker, date) GROUP BY 1 HAVING count(*) >= 20")
R.add("dd3_keep_last", "prices", lambda p: membership.keep_last(p.withColumnRenamed("date", "day").withColumn("date", expr.month(F.col("day"))), ["ticker", "date"], "day").select("ticker", "date", "day", r6("close").alias("close")), f" SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, max(date) AS day, {sr6('arg_max(close, date)')} AS close FROM prices GROUP BY 1, 2")
R.add("pj8_price_asof", "prices", lambda p: p.groupBy("ticker").agg(F.date_format(F.max("date"), "yyyy-MM-dd").alias("price_asof")), " SELECT ticker, strftime(max(date), '%Y-%m-%d') AS price_asof FROM prices GROUP BY 1")
R.add("pj7_data_quality", "prices", lambda p: prices.as_of(prices.features(p), prices.month_ends(p), ["n_bars", "ret_12_1", "ret_13w"]).select("t", "ticker", expr.data_quality(F.col("n_bars"), F.col("ret_12_1"), F.col("ret_13w")).alias("q")).groupBy("q").agg(F.count("*").alias("n")), f", {_ENDS}, {_FEATURES}, b AS (SELECT t, f.ticker, max(f.date) AS asof FROM ends JOIN f ON f.date <= t GROUP BY 1, 2), c AS (SELECT CASE WHEN n_bars <= 1 THEN 'missing_prices' WHEN ret_12_1 IS NOT NULL AND ret_13w IS NOT NULL THEN 'ok' ELSE 'partial_prices' END AS q FROM b JOIN f ON f.ticker = b.ticker AND f.date = b.asof) SELECT q, count(*) AS n FROM c GROUP BY q")
