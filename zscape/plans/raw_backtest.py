"""The backtest from bars, facts and membership, all tables as rows of one, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import jobs
from ..operators import backtest, scoring
from .backtest_queries import _BETA_T, _FEATURES, _PROXY, _REB, _SEEN_T, _SIGNALS_T, _T_NW, _VOL_T, _WEEKLY, results_sql
from .facts_queries import _AT, _QUARTERS, _RATIOS, _STOCKS, pit
from .registry import Registry, avg_rank_sql, erc_sql, neutral_sql, ppf_sql, r6, sr6

R = Registry()
KEYS = {"factor": "string", "variant": "string", "horizon": "int", "t": "date"}
#: The columns of each table that are compared.
MEASURES = {
    "ic_summary": ("n", "mean", "std", "t_stat", "t_nw", "pct_pos", "ic_for_t2"),
    "ic_series": ("n", "ic"),
    "spreads": ("spread",),
    "quintiles": ("ann_ret", "max_drawdown", "turnover"),
    "regimes": tuple(f"{k}_n" for k in backtest.REGIMES),
    "decay": ("mean_21", "n_21", "mean_63", "n_63"),
    "bias": ("unfiltered", "filtered", "bias"),
    "composites": ("n", "mean", "t_stat", "t_nw", "ann_return"),
}


def _rows(part: str, df: DataFrame) -> DataFrame:
    df = df.withColumnRenamed("scheme", "factor")
    keys = [(F.col(k) if k in df.columns else F.lit(None)).cast(kind).alias(k) for k, kind in KEYS.items()]
    values = [r6(F.col(m).cast("double")).alias(m) for m in MEASURES[part]]
    return df.select(F.lit(part).alias("part"), *keys, *values).unpivot(["part", *KEYS], list(MEASURES[part]), "measure", "value")


def _backtest(p: DataFrame, f: DataFrame, m: DataFrame) -> DataFrame:
    sectors = p.select("ticker", F.when(F.col("ticker") < "Brand#3", "A").otherwise("B").alias("sector")).distinct()
    out = jobs.backtested_from_bars(p, f, sectors, m, "Brand#11")
    return reduce(DataFrame.unionByName, [_rows(k, df) for k, df in out.items()])


_NAMES = [*jobs.PRICE_SIGNALS, *jobs.FACT_SIGNALS]
_BUCKETS = sorted(jobs.BACKTEST_BUCKETS)
_MEAN = lambda fs: "list_avg([" + ", ".join(fs) + "])"
_WEIGHTS = {k: backtest.renormalised(w, _BUCKETS) for k, w in (("product", scoring.WEIGHTS["composite"]), ("literature", backtest.LITERATURE))}
_SCHEMES = {k: [f"{w[b]!r}::DOUBLE" for b in _BUCKETS] for k, w in _WEIGHTS.items()} | {"variance_share": [f"w{i}" for i in range(len(_BUCKETS))]}
_STEPS = ", ".join((
    _REB, _FEATURES, _PROXY.replace(_WEEKLY + ", ", ""), _SEEN_T, _BETA_T, _VOL_T, _SIGNALS_T,
    "seen AS (SELECT t, brand_facts.* FROM brand_facts JOIN reb ON filed <= t)", _AT(_QUARTERS), _AT(_STOCKS),
    "wide AS (SELECT k.t, k.ticker, " + ", ".join(f"max(sk.value) FILTER (sk.concept = '{c}') AS {c}" for c in pit.STOCKS) + ", " + ", ".join(f"any_value({c}_ttm) AS {c}_ttm" for c in pit.FLOWS)
    + " FROM (SELECT DISTINCT t, ticker FROM seen) k LEFT JOIN sk ON sk.t = k.t AND sk.ticker = k.ticker LEFT JOIN (SELECT t, ticker, " + ", ".join(f"max(ttm) FILTER (concept = '{c}') AS {c}_ttm" for c in pit.FLOWS) + " FROM tt GROUP BY 1, 2) f ON f.t = k.t AND f.ticker = k.ticker GROUP BY 1, 2)",
    "x AS (SELECT wide.*, shares_outstanding * close AS cap FROM wide LEFT JOIN prices p ON p.ticker = wide.ticker AND p.date = wide.t)",
    "fu AS (SELECT t, ticker, " + ", ".join(f"{v} AS {k}" for k, v in _RATIOS.items()) + " FROM x)",
    "al AS (SELECT t, ticker, ret_12_1, ret_13w, -round(vol, 6) AS volatility_26w, round(-beta, 12) AS beta_52w, " + ", ".join(f"round({c}, 12) AS {c}" for c in _RATIOS) + " FROM sg FULL JOIN fu USING (t, ticker))",
    f"lo AS (UNPIVOT al ON {', '.join(_NAMES)} INTO NAME factor VALUE signal)",
    f"ks AS (SELECT *, CASE WHEN ticker NOT IN (SELECT ticker FROM prices) THEN NULL WHEN ticker < 'Brand#3' THEN 'A' ELSE 'B' END AS sector, ({avg_rank_sql('signal', 'factor, t')} - 0.5::DOUBLE) / count(*) OVER (PARTITION BY factor, t) AS p FROM lo)",
    f"gs AS (SELECT *, {ppf_sql('p')} AS g FROM ks)", f"zs AS (SELECT *, {neutral_sql('g', 'sector', 'factor, t')} AS z FROM gs)",
    "sc AS (SELECT t, ticker, factor, 'raw' AS variant, round(g, 12) AS score FROM zs UNION ALL SELECT t, ticker, factor, 'neutral', round(z, 12) FROM zs)",
    "fw AS (SELECT t, p.ticker, h AS horizon, q.close / nullif(p.close, 0) - 1 AS fwd FROM reb JOIN prices p ON p.date = t CROSS JOIN (VALUES (21), (63)) v(h) LEFT JOIN cal c ON c.pos = reb.pos + h LEFT JOIN prices q ON q.ticker = p.ticker AND q.date = c.date)",
    "pn AS (SELECT sc.*, h AS horizon, fwd FROM sc CROSS JOIN (VALUES (21), (63)) v(h) LEFT JOIN fw ON fw.t = sc.t AND fw.ticker = sc.ticker AND fw.horizon = h)",
    results_sql("pn", "factor, variant, horizon", "_p"),
    "mb AS (SELECT pn.* FROM pn JOIN brand_members m ON pn.ticker = m.ticker AND (added_date IS NULL OR added_date <= t))", results_sql("mb", "factor, variant, horizon", "_m"),
    "tb AS (SELECT factor, t, ticker FROM lb_p WHERE q = 5 AND variant = 'neutral' AND horizon = 21), td AS (SELECT factor, t, lag(t) OVER (PARTITION BY factor ORDER BY t) AS prev FROM (SELECT DISTINCT factor, t FROM tb)), tn AS (SELECT tb.factor, tb.t, avg(CASE WHEN o.ticker IS NULL THEN 1e0 ELSE 0e0 END) AS new FROM tb JOIN td ON td.factor = tb.factor AND td.t = tb.t AND prev IS NOT NULL LEFT JOIN tb o ON o.factor = tb.factor AND o.t = prev AND o.ticker = tb.ticker GROUP BY 1, 2), tu AS (SELECT factor, avg(new) AS turnover FROM tn GROUP BY 1)",
    "ea AS (PIVOT (SELECT t, ticker, factor, score FROM sc WHERE variant = 'neutral') ON factor IN (" + ", ".join(f"'{n}'" for n in _NAMES) + ") USING first(score))",
    "bl AS (SELECT t, ticker, " + ", ".join(f"{_MEAN(jobs.BACKTEST_BUCKETS[b])} AS {b}" for b in _BUCKETS) + " FROM ea)",
    "d AS (SELECT * FROM bl WHERE " + " AND ".join(f"{b} IS NOT NULL" for b in _BUCKETS) + ")", erc_sql("d", _BUCKETS),
    "cs AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scheme, t, ticker, CASE WHEN coalesce({', '.join(_BUCKETS)}) IS NOT NULL THEN " + " + ".join(f"coalesce({b}, 0) * {w}" for b, w in zip(_BUCKETS, ws)) + " END AS score FROM bl, erc" for k, ws in _SCHEMES.items()) + ")",
    "cf AS (SELECT cs.*, fwd FROM cs LEFT JOIN fw ON fw.t = cs.t AND fw.ticker = cs.ticker AND fw.horizon = 21)", results_sql("cf", "scheme", "_c"),
))


def _part(name: str, keys: str, source: str, **values: str) -> str:
    """The rows of one table, a row for each measure."""
    names, own = ", ".join(f"'{m}'" for m in values), ", ".join(f"({sr6(f'({v})::DOUBLE')})" for v in values.values())
    return f"SELECT '{name}' AS part, {keys}, unnest([{names}]) AS measure, unnest([{own}]) AS value FROM {source}"


_ALL, _NEAR = "factor, variant, horizon, NULL::DATE AS t", "factor, NULL AS variant, NULL::INT AS horizon, NULL::DATE AS t"
_SERIES = "factor, NULL AS variant, NULL::INT AS horizon, CAST(t AS DATE) AS t"
_OF = "variant = 'neutral' AND horizon = 21"
_SQL = ", " + _STEPS + "\n" + "\nUNION ALL ".join((
    _part("ic_summary", _ALL, "sm_p", n="n", mean="mean", std="sd", t_stat="mean / (sd / sqrt(n))", t_nw=_T_NW.format("_p"), pct_pos="pct_pos", ic_for_t2="2 * sd / sqrt(n)"),
    _part("ic_series", "factor, variant, horizon, CAST(t AS DATE) AS t", "ic_p", n="n", ic="ic"),
    _part("spreads", _SERIES, f"sp_p WHERE {_OF}", spread="r"),
    _part("quintiles", _NEAR, f"an_p JOIN tu USING (factor) WHERE {_OF}", ann_ret="ann", max_drawdown="drawdown", turnover="turnover"),
    _part("regimes", _NEAR, f"(SELECT DISTINCT factor FROM ic_p WHERE {_OF})", **{f"{k}_n": f"(SELECT count(ic) FROM ic_p i WHERE i.factor = factor AND {_OF} AND t BETWEEN DATE '{a}' AND DATE '{b}')" for k, (a, b) in backtest.REGIMES.items()}),
    _part("decay", _NEAR, "(SELECT factor, " + ", ".join(f"avg(ic) FILTER (horizon = {h}) AS m{h}, count(ic) FILTER (horizon = {h}) AS n{h}" for h in (21, 63)) + " FROM ic_p WHERE variant = 'neutral' GROUP BY 1)", mean_21="m21", n_21="n21", mean_63="m63", n_63="n63"),
    _part("bias", _NEAR, f"(SELECT u.factor, u.m AS u, v.m AS v FROM (SELECT factor, avg(ic) AS m FROM ic_p WHERE {_OF} GROUP BY 1) u JOIN (SELECT factor, avg(ic) AS m FROM ic_m WHERE {_OF} GROUP BY 1) v USING (factor) WHERE factor IN ({', '.join(repr(n) for n in jobs.PRICE_SIGNALS)}))", unfiltered="u", filtered="v", bias="u - v"),
    _part("composites", "scheme AS factor, NULL AS variant, NULL::INT AS horizon, NULL::DATE AS t", "sm_c LEFT JOIN an_c USING (scheme)", n="n", mean="mean", t_stat="mean / (sd / sqrt(n))", t_nw=_T_NW.format("_c"), ann_return="ann"),
))
R.add("or2_from_bars", "prices brand_facts brand_members", _backtest, _SQL)
R.oracles["or2_from_bars"] = R.oracles["or2_from_bars"].replace("WITH ", "WITH RECURSIVE ", 1)
