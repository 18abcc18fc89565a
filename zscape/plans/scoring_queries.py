"""Expressions, ranks, buckets and composites over the factor table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr, ranks
from ..operators import backtest, scoring, statements
from .registry import Registry, avg_rank_sql, erc_sql, neutral_sql, ppf_sql, r6, rounded, sr6

R = Registry()
SUBS = scoring.WEIGHTS["subfactors"]
NAMES = [n for s in SUBS.values() for n in s]


def _signal_sql(n: str) -> str:
    return f"1 / nullif({n}, 0)" if n in scoring.AS_YIELD else f"-{n}" if n in scoring.LESS_IS_BETTER else n


def _blend_sql(parts: list[tuple[float, str]]) -> str:
    have = " + ".join(f"CASE WHEN {z} IS NOT NULL THEN {float(w)!r}::DOUBLE ELSE 0 END" for w, z in parts)
    total = sum(w for w, _ in parts)
    return f"CASE WHEN ({have}) > 0 AND ({have}) / {total!r}::DOUBLE >= 0.5 THEN (" + " + ".join(f"coalesce({z}, 0) * {float(w)!r}::DOUBLE" for w, z in parts) + f") / ({have}) END"


#: Steps of scoring as CTEs behind ``factors``.
_Z = (
    "s AS (SELECT *, " + ", ".join(f"{_signal_sql(n)} AS s_{n}" for n in NAMES) + " FROM factors),\n"
    + "k AS (SELECT *, " + ", ".join(f"({avg_rank_sql(f's_{n}', '')} - 0.5::DOUBLE) / count(s_{n}) OVER () AS p_{n}" for n in NAMES) + " FROM s),\n"
    + "g AS (SELECT *, " + ", ".join(f"{ppf_sql(f'p_{n}')} AS g_{n}" for n in NAMES) + " FROM k),\n"
    + "z AS (SELECT *, " + ", ".join(f"{neutral_sql(f'g_{n}', 'sector')} AS z_{n}" for n in NAMES) + " FROM g),\n"
    + "b AS (SELECT *, " + ", ".join(f"{_blend_sql([(w, f'z_{n}') for n, w in s.items()])} AS {b}_score" for b, s in SUBS.items()) + " FROM z),\n"
    + "r AS (SELECT *, " + ", ".join(f"CASE WHEN stddev_pop({b}_score) OVER () > 1e-9 THEN (coalesce({b}_score, 0) - avg({b}_score) OVER ()) / stddev_pop({b}_score) OVER () ELSE 0 END AS r_{b}" for b in scoring.BUCKETS) + " FROM b)"
)


def _with(extra: str, body: str) -> str:
    return ", " + extra + "\n" + body


def _expr(name: str, inputs: str, build, oracle: str) -> None:
    R.add(name, inputs, build, oracle)


_expr("pj4_inverse_yield", "factors", lambda f: f.select("ticker", r6(expr.inverse_yield(F.col("pe_ratio"))).alias("ep")), f"SELECT ticker, {sr6('1 / nullif(pe_ratio, 0)')} AS ep FROM factors")
_expr("pj5_direction", "factors", lambda f: f.select("ticker", *[r6(scoring.signal(f, n)).alias(n) for n in ("beta", "roe", "ev_ebitda")]), "SELECT ticker, " + ", ".join(f"{sr6(_signal_sql(n))} AS {n}" for n in ("beta", "roe", "ev_ebitda")) + " FROM factors")
_expr("pj6_sector_guard", "factors", lambda f: f.select("ticker", *[expr.guarded(F.col(c), F.col("sector")).alias(c) for c in ("ev_ebitda", "gpa")]), "SELECT ticker, CASE WHEN sector IS DISTINCT FROM 'Financials' THEN ev_ebitda END AS ev_ebitda, CASE WHEN sector IS DISTINCT FROM 'Financials' THEN gpa END AS gpa FROM factors")
_expr("pj16_json_clean", "factors", lambda f: f.select("ticker", *[expr.published(F.col(c)).alias(c) for c in ("ret_12_1", "roe")]), "SELECT ticker, round(ret_12_1, 4) + 0.0 AS ret_12_1, round(roe, 4) + 0.0 AS roe FROM factors")
_expr("pj23_type_coercion", "factors", lambda f: f.select("ticker", F.coalesce(expr.number(F.concat(F.when(F.col("roe") > 0.2, "x").otherwise(""), F.col("roe").cast("string"))), F.lit(-1.0)).alias("roe"), F.coalesce(scoring.signal(f, "absent"), F.lit(-1.0)).alias("absent")), "SELECT ticker, coalesce(CASE WHEN roe > 0.2 THEN NULL ELSE roe END, -1.0) AS roe, (-1.0)::DOUBLE AS absent FROM factors")
_expr("wn1_average_rank", "factors", lambda f: f.select("ticker", ranks.average_rank("debt_equity", ["sector"]).alias("r")), f"SELECT ticker, {avg_rank_sql('debt_equity', 'sector')} AS r FROM factors")
_expr("wn2_gaussian_rank", "factors", lambda f: f.select("ticker", r6(ranks.gaussian_rank("roe", ["sector"])).alias("g")), ", k AS (SELECT ticker, (" + avg_rank_sql("roe", "sector") + f" - 0.5::DOUBLE) / count(roe) OVER (PARTITION BY sector) AS p FROM factors) SELECT ticker, {sr6(ppf_sql('p'))} AS g FROM k")
_expr("wn3_sector_neutral", "factors", lambda f: f.withColumn("_1", F.lit(1)).select("ticker", r6(ranks.sector_neutral("roe", "sector", ["_1"])).alias("z")), f"SELECT ticker, {sr6(neutral_sql('roe', 'sector'))} AS z FROM factors")
_expr("wn4_restandardize", "factors", lambda f: f.select("ticker", r6(ranks.restandardized("gpa", ["sector"])).alias("r")), f"SELECT ticker, {sr6('CASE WHEN stddev_pop(gpa) OVER (PARTITION BY sector) > 1e-9 THEN (coalesce(gpa, 0) - avg(gpa) OVER (PARTITION BY sector)) / stddev_pop(gpa) OVER (PARTITION BY sector) ELSE 0 END')} AS r FROM factors")
_expr("wn12_quintile_labels", "factors", lambda f: f.select("ticker", ranks.quantile_label("roe", ["sector"], "ticker").alias("q")), "SELECT ticker, CASE WHEN roe IS NOT NULL AND count(roe) OVER (PARTITION BY sector) >= 5 THEN greatest(1, ceil((row_number() OVER (PARTITION BY sector, roe IS NULL ORDER BY roe, ticker) - 1) * 5 / (count(roe) OVER (PARTITION BY sector) - 1)))::INT END AS q FROM factors")
_expr("ag5_population_std", "factors", lambda f: rounded(f.groupBy("sector").agg(F.stddev_pop("roe").alias("sd")), "sd"), f"SELECT sector, {sr6('stddev_pop(roe)')} AS sd FROM factors GROUP BY sector")
_expr("ag6_sample_std", "factors", lambda f: rounded(f.groupBy("sector").agg(F.stddev_samp("roe").alias("sd")), "sd"), f"SELECT sector, {sr6('stddev_samp(roe)')} AS sd FROM factors GROUP BY sector")
_expr("ag7_covariance", "factors", lambda f: f.groupBy("sector").agg(*scoring.covariances(["roe", "gpa"])).select("sector", r6("`roe*roe`").alias("aa"), r6("`roe*gpa`").alias("ab"), r6("`gpa*gpa`").alias("bb")), f"SELECT sector, {sr6('covar_samp(roe, roe)')} AS aa, {sr6('covar_samp(roe, gpa)')} AS ab, {sr6('covar_samp(gpa, gpa)')} AS bb FROM factors GROUP BY sector")
_expr("ag27_row_mean", "factors", lambda f: f.select("ticker", r6(expr.row_mean(F.col("roe"), F.col("gpa"), F.col("beta"))).alias("m")), f"SELECT ticker, {sr6('list_avg([roe, gpa, beta])')} AS m FROM factors")
_expr("cp1_coverage_blend", "factors", lambda f: f.select("ticker", r6(expr.blended([(0.25, F.col("roe")), (0.25, F.col("gpa")), (0.5, F.col("beta"))])).alias("blend")), f"SELECT ticker, {sr6(_blend_sql([(0.25, 'roe'), (0.25, 'gpa'), (0.5, 'beta')]))} AS blend FROM factors")
_expr("cp8_weighted_sum", "factors", lambda f: f.select("ticker", r6(expr.weighted_sum([(0.4, F.col("roe")), (0.6, F.col("gpa"))])).alias("s")), f"SELECT ticker, {sr6('CASE WHEN coalesce(roe, gpa) IS NOT NULL THEN coalesce(roe, 0) * 0.4::DOUBLE + coalesce(gpa, 0) * 0.6::DOUBLE END')} AS s FROM factors")


def _cp2(f: DataFrame) -> DataFrame:
    b = scoring.buckets(f, [])
    return b.select("ticker", *[r6(f"{n}_score").alias(f"{n}_score") for n in SUBS])


R.add("cp2_buckets", "factors", _cp2, _with(_Z, "SELECT ticker, " + ", ".join(f"{sr6(f'{b}_score')} AS {b}_score" for b in SUBS) + " FROM b"))
R.add("cp10_to_score", "slices", lambda s: s.withColumn("_g", ranks.gaussian_rank("score", ["t"])).withColumn("sector", F.col("ticker").cast("int") % 2).select("t", "ticker", r6("_g").alias("raw"), r6(ranks.sector_neutral("_g", "sector", ["t"])).alias("neutral")),
      _with("k AS (SELECT *, CAST(ticker AS INT) % 2 AS sector, (" + avg_rank_sql("score", "t") + " - 0.5::DOUBLE) / count(score) OVER (PARTITION BY t) AS p FROM slices), g AS (SELECT *, " + ppf_sql("p") + " AS g FROM k)", f"SELECT t, ticker, {sr6('g')} AS raw, {sr6(neutral_sql('g', 'sector', 't'))} AS neutral FROM g"))


def build_scores(f: DataFrame) -> DataFrame:
    return scoring.build_scores(f).select("ticker", *[F.col(f"{b}_score") for b in SUBS], "composite_score")


_SCORES = ", ".join(f"round(coalesce({b}_score, 0), 4) + 0.0 AS {b}_score" for b in SUBS)
_COMPOSITE = " + ".join(f"w{i} * r_{b}" for i, b in enumerate(scoring.BUCKETS))
R.add("cp3_build_scores", "factors", build_scores, _with(_Z + ", " + erc_sql("r", [f"r_{b}" for b in scoring.BUCKETS]), f"SELECT ticker, {_SCORES}, round({_COMPOSITE}, 4) + 0.0 AS composite_score FROM r, erc"))
R.oracles["cp3_build_scores"] = R.oracles["cp3_build_scores"].replace("WITH ", "WITH RECURSIVE ", 1)


def _weights(df: DataFrame, names: list[str], nominal: dict | None) -> DataFrame:
    w = df.agg(*scoring.covariances(names)).select(scoring.equal_contribution(names, nominal).alias("w"))
    return w.select(*[r6(F.col("w")[i]).alias(f"w{i}") for i in range(len(names))])


R.add("cp4_erc_weights", "factors", lambda f: _weights(f, ["roe", "gpa", "beta"], {"roe": 1.0, "gpa": 1.0, "beta": 1.0}), _with(erc_sql("factors", ["roe", "gpa", "beta"]), f"SELECT {sr6('w0')} AS w0, {sr6('w1')} AS w1, {sr6('w2')} AS w2 FROM erc"))
R.oracles["cp4_erc_weights"] = R.oracles["cp4_erc_weights"].replace("WITH ", "WITH RECURSIVE ", 1)
R.add("cp4_erc_fallback", "factors", lambda f: _weights(f.withColumn("flat", F.lit(1.0)), ["roe", "flat"], {"roe": 3.0, "flat": 1.0}), "SELECT 0.75::DOUBLE AS w0, 0.25::DOUBLE AS w1")
R.add("cp5_erc_research", "blends", lambda b: rounded(backtest.solved_weights(b, ["trend", "quality", "value"]), "weight"), _with("d AS (SELECT * FROM blends WHERE trend IS NOT NULL AND quality IS NOT NULL AND value IS NOT NULL), " + erc_sql("d", ["trend", "quality", "value"]), f"SELECT unnest(['trend', 'quality', 'value']) AS bucket, unnest([{sr6('w0')}, {sr6('w1')}, {sr6('w2')}]) AS weight FROM erc"))
R.oracles["cp5_erc_research"] = R.oracles["cp5_erc_research"].replace("WITH ", "WITH RECURSIVE ", 1)
R.add("cp6_renormalize", "blends", lambda b: b.select("t", "ticker", backtest.row_weights({"trend": 0.4, "quality": 0.3, "value": 0.15}).alias("w")).select("t", "ticker", *[r6(F.col("w")[k]).alias(k) for k in ("trend", "quality", "value")]), ", x AS (SELECT *, CASE WHEN trend IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN quality IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN value IS NULL THEN 0 ELSE 0.15::DOUBLE END AS total FROM blends) SELECT t, ticker, " + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN {sr6(f'{w}::DOUBLE / total')} END AS {k}" for k, w in (("trend", 0.4), ("quality", 0.3), ("value", 0.15))) + " FROM x")
R.add("cp7_literature_weights", "blends", lambda b: b.select("t", "ticker", r6(backtest.composite(b, backtest.LITERATURE)).alias("score")), f"SELECT t, ticker, {sr6('CASE WHEN coalesce(trend, quality, value) IS NOT NULL THEN (coalesce(trend, 0) * 0.40 + coalesce(quality, 0) * 0.30 + coalesce(value, 0) * 0.15) / 0.85::DOUBLE END')} AS score FROM blends")
_AGG31 = "v AS (SELECT covar_samp(trend, trend) AS a, covar_samp(trend, quality) AS b, covar_samp(trend, value) AS c, covar_samp(quality, quality) AS d, covar_samp(quality, value) AS e, covar_samp(value, value) AS f FROM blends), w AS (SELECT 0.5::DOUBLE * (0.5 * a + 0.3 * b + 0.2 * c) AS x, 0.3::DOUBLE * (0.5 * b + 0.3 * d + 0.2 * e) AS y, 0.2::DOUBLE * (0.5 * c + 0.3 * e + 0.2 * f) AS z FROM v)"
R.add("ag31_variance_contributions", "blends", lambda b: rounded(backtest.variance_shares(b, {"trend": 0.5, "quality": 0.3, "value": 0.2}), "share"), _with(_AGG31, f"SELECT unnest(['trend', 'quality', 'value']) AS bucket, unnest([{sr6('x / (x + y + z)')}, {sr6('y / (x + y + z)')}, {sr6('z / (x + y + z)')}]) AS share FROM w"))

_S4 = lambda tag: f"sum(value) FILTER (tag = '{tag}' AND q_rank <= 4)"
_HAS = lambda *tags: "CASE " + " ".join(f"WHEN count(*) FILTER (tag = '{t}') > 0 THEN coalesce({_S4(t)}, 0)" for t in tags) + " END"
_Q1 = lambda tag: f"max(value) FILTER (tag = '{tag}' AND q_rank = 1)"
_STATEMENTS = (
    f"x AS (SELECT symbol, {_HAS(*statements.EBIT)} AS ebit, {_Q1('Total Assets')} AS assets, {_Q1('Current Liabilities')} AS liabilities, {_HAS(*statements.OPERATING_CASH)} AS ocf, coalesce(abs({_HAS(*statements.CAPITAL)}), 0) AS capex, "
    f"CASE WHEN count(value) FILTER (tag = 'Gross Profit' AND q_rank <= 4) = 4 THEN {_S4('Gross Profit')} END AS gross, coalesce({', '.join(map(_S4, statements.DIVIDENDS))}) AS dividends, coalesce({', '.join(map(_S4, statements.BUYBACKS))}) AS buybacks FROM statements GROUP BY symbol)"
)
for _name, _column, _sql in (
    ("pj10_roic", "roic", "CASE WHEN assets - liabilities > 0 THEN ebit / (assets - liabilities) END"),
    ("pj11_fcf_margin", "fcf_margin_ttm", "CASE WHEN revenue > 0 THEN coalesce(fcf / revenue, (ocf - capex) / revenue) END"),
    ("pj12_gpa", "gpa", "CASE WHEN assets > 0 THEN coalesce(gross, nullif(revenue, 0) * gross_margin) / assets END"),
    ("pj13_net_payout_yield", "net_payout_yield", "CASE WHEN market_cap > 0 AND coalesce(dividends, buybacks) IS NOT NULL THEN (abs(coalesce(dividends, 0)) + abs(coalesce(buybacks, 0))) / market_cap END"),
):
    R.add(_name, "statements info", lambda s, i, c=_column: statements.ratios(s, i).select("symbol", r6(c).alias(c)), _with(_STATEMENTS, f"SELECT symbol, {sr6(_sql)} AS {_column} FROM info LEFT JOIN x USING (symbol)"))
R.add("pj14_ttm_ladder", "statements", lambda s: s.groupBy("symbol").agg(r6(statements.ttm_ladder(*statements.DIVIDENDS)).alias("ttm")), f"SELECT symbol, {sr6('coalesce(' + ', '.join(map(_S4, statements.DIVIDENDS)) + ')')} AS ttm FROM statements GROUP BY symbol")
R.add("pj9_percent_to_decimal", "info", lambda i: rounded(statements.as_decimals(i).select("symbol", "debt_equity", "dividend_yield"), "debt_equity", "dividend_yield"), f"SELECT symbol, {sr6('debt_equity / 100')} AS debt_equity, {sr6('dividend_yield / 100')} AS dividend_yield FROM info")
