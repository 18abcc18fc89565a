"""Filing documents, point-in-time facts, membership, publishing and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import facts, guards, membership, pit, publish, replay
from ..shared import checked, scratch, written
from ..sources import readers, writers
from .registry import Registry, r6, rounded, sr6

R = Registry()
AS_OF = "2000-05-20"


def _day():
    return F.lit(AS_OF).cast("date")


_SEEN = f"seen AS (SELECT * FROM facts WHERE filed <= DATE '{AS_OF}')"
_FLOW = "', '".join(pit.FLOWS)
_STOCK = "', '".join(pit.STOCKS)
_NQ = "CASE " + " ".join(f"WHEN abs(datediff('day', period_start, period_end) - {n}) <= 25 THEN {k}" for k, n in expr.HORIZONS.items()) + " END"
_QUARTERS = (
    f"fr AS (SELECT *, {_NQ} AS n FROM seen WHERE concept IN ('{_FLOW}')), fk AS (SELECT * FROM fr WHERE n IS NOT NULL AND value IS NOT NULL AND fy IS NOT NULL), "
    "d0 AS (SELECT *, first_value(fy) OVER (PARTITION BY ticker, concept, period_end ORDER BY seq) AS fy1, min(seq) OVER (PARTITION BY ticker, concept, period_end) AS seq1, "
    "row_number() OVER (PARTITION BY ticker, concept, period_end ORDER BY filed DESC, seq DESC) AS k FROM fk WHERE n = 1), dd AS (SELECT * FROM d0 WHERE k = 1), "
    "l1 AS (SELECT ticker, concept, fy1 AS fy, 1 AS n, period_end, value FROM dd QUALIFY row_number() OVER (PARTITION BY ticker, concept, fy1 ORDER BY seq1) = 1), "
    "l2 AS (SELECT ticker, concept, fy, n, period_end, value FROM fk WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY ticker, concept, fy, n ORDER BY filed DESC, period_end DESC, seq DESC) = 1), "
    "st AS (SELECT *, coalesce(lag(n) OVER o, 0) AS below, coalesce(lag(value) OVER o, 0) AS base FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) WINDOW o AS (PARTITION BY ticker, concept, fy ORDER BY n)), "
    "qs AS (SELECT ticker, concept, period_end, value FROM (SELECT ticker, concept, period_end, value, 0 AS r, 0.0 AS fy, 0 AS n FROM dd UNION ALL SELECT ticker, concept, period_end, value - base, 1, fy, n FROM st WHERE n - below = 1) "
    "QUALIFY row_number() OVER (PARTITION BY ticker, concept, period_end ORDER BY r, fy, n) = 1), "
    "tt AS (SELECT ticker, concept, CASE WHEN count(*) = 4 THEN sum(value) END AS ttm FROM (SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY ticker, concept ORDER BY period_end DESC) <= 4) GROUP BY 1, 2)"
)
_STOCKS = f"sk AS (SELECT ticker, concept, value FROM seen WHERE concept IN ('{_STOCK}') AND value IS NOT NULL AND period_end IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, concept ORDER BY period_end DESC, filed DESC, seq DESC) = 1)"
_WIDE = (
    f"{_SEEN}, {_QUARTERS}, {_STOCKS}, wide AS (SELECT t.ticker, " + ", ".join(f"(SELECT value FROM sk WHERE sk.ticker = t.ticker AND concept = '{c}') AS {c}" for c in pit.STOCKS) + ", "
    + ", ".join(f"(SELECT ttm FROM tt WHERE tt.ticker = t.ticker AND concept = '{c}') AS {c}_ttm" for c in pit.FLOWS) + " FROM (SELECT DISTINCT ticker FROM seen) t)"
)
_COLUMNS = [*pit.STOCKS, *(f"{c}_ttm" for c in pit.FLOWS)]


def _wide(f: DataFrame) -> DataFrame:
    return pit.as_known_at(f, _day())


R.add("fl2_known_by", "facts", lambda f: pit.known_at(f, _day()).groupBy("concept").agg(F.count("*").alias("n")), f", {_SEEN} SELECT concept, count(*) AS n FROM seen GROUP BY 1")
R.add("pj18_quarters_spanned", "facts", lambda f: f.groupBy("concept", expr.quarters_spanned(F.col("period_start"), F.col("period_end")).alias("q")).agg(F.count("*").alias("n")), f" SELECT concept, {_NQ} AS q, count(*) AS n FROM facts GROUP BY 1, 2")
R.add("dd4_best_known", "facts", lambda f: rounded(pit.latest(f, ["ticker", "concept"], "filed", "period_end").select("ticker", "concept", "filed", "period_end", "value"), "value"), f" SELECT ticker, concept, filed, period_end, {sr6('value')} AS value FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, concept ORDER BY filed DESC, period_end DESC, seq DESC) = 1")
R.add("dd5_period_keep_last", "facts", lambda f: rounded(pit.latest(f.where("concept = 'revenues'"), ["ticker", "period_end"], "seq").select("ticker", "period_end", "value"), "value"), f" SELECT ticker, period_end, {sr6('arg_max(value, seq)')} AS value FROM facts WHERE concept = 'revenues' GROUP BY 1, 2")
R.add("dd6_distinct_tickers", "facts", lambda f: f.select("ticker").distinct(), " SELECT DISTINCT ticker FROM facts")
R.add("jn6_bitemporal_as_of", "facts", lambda f: rounded(pit.stocks(pit.known_at(f, _day())), "value"), f", {_SEEN}, {_STOCKS} SELECT ticker, concept, {sr6('value')} AS value FROM sk")
R.add("st4_last_by_keys", "facts", lambda f: rounded(pit.stocks(f).where("concept = 'total_assets'"), "value"), f", {_SEEN.replace(f" WHERE filed <= DATE '{AS_OF}'", '')}, {_STOCKS} SELECT ticker, concept, {sr6('value')} AS value FROM sk WHERE concept = 'total_assets'")
R.add("nj10_discrete_quarters", "facts", lambda f: rounded(pit.quarters(pit.known_at(f, _day())), "value"), f", {_SEEN}, {_QUARTERS} SELECT ticker, concept, period_end, {sr6('value')} AS value FROM qs")
R.add("wn15_ladder_differences", "facts", lambda f: pit.quarters(f).groupBy("concept", F.year("period_end").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("v")), f", {_SEEN.replace(f" WHERE filed <= DATE '{AS_OF}'", '')}, {_QUARTERS} SELECT concept, year(period_end)::INT AS y, count(*) AS n, round(sum(value), 5) AS v FROM qs GROUP BY 1, 2")
R.add("ag30_trailing_sums", "facts", lambda f: f.transform(lambda x: pit.trailing_sums(pit.quarters(pit.known_at(x, _day())))).select("ticker", "concept", F.round("ttm", 5).alias("ttm")), f", {_SEEN}, {_QUARTERS} SELECT ticker, concept, round(ttm, 5) AS ttm FROM tt")
R.add("nj8_as_known_at", "facts", lambda f: _wide(f).select("ticker", *[F.round(c, 5).alias(c) for c in _COLUMNS]), f", {_WIDE} SELECT ticker, " + ", ".join(f"round({c}, 5) AS {c}" for c in _COLUMNS) + " FROM wide")
R.add("nj9_single_ticker", "facts", lambda f: _wide(f.where("ticker = '7'")).select("ticker", *[F.round(c, 5).alias(c) for c in _COLUMNS]), f", {_WIDE} SELECT ticker, " + ", ".join(f"round({c}, 5) AS {c}" for c in _COLUMNS) + " FROM wide WHERE ticker = '7'")
_CLOSES = "cl AS (SELECT ticker, 20e0 + CAST(ticker AS INT) % 7 AS close FROM (SELECT DISTINCT ticker FROM facts) WHERE CAST(ticker AS INT) % 8 <> 3)"
_RATIOS = {
    "ep": "net_income_ttm / nullif(cap, 0)", "bp": "stockholders_equity / nullif(cap, 0)", "fcf_yield": "(operating_cash_flow_ttm - coalesce(capex_ttm, 0)) / nullif(cap, 0)",
    "net_payout_yield": "(coalesce(dividends_paid_ttm, 0) + coalesce(buybacks_ttm, 0)) / nullif(cap, 0)", "gpa": "gross_profit_ttm / nullif(total_assets, 0)", "roe": "net_income_ttm / nullif(stockholders_equity, 0)",
    "oper_margin": "operating_income_ttm / nullif(revenues_ttm, 0)", "ev_ebitda_yield": "(operating_income_ttm + coalesce(depreciation_amortization_ttm, 0)) / nullif(cap + coalesce(total_debt, 0) - coalesce(cash_and_equivalents, 0), 0)",
}


def _closes(f: DataFrame) -> DataFrame:
    k = F.col("ticker").cast("int")
    return f.select("ticker").distinct().where(k % 8 != 3).select("ticker", (k % 7 + 20.0).alias("close"))


R.add("pj15_pit_ratios", "facts", lambda f: rounded(pit.signals(_wide(f), _closes(f)), *_RATIOS), f", {_WIDE}, {_CLOSES}, x AS (SELECT wide.*, shares_outstanding * close AS cap FROM wide LEFT JOIN cl USING (ticker)) SELECT ticker, " + ", ".join(f"{sr6(v)} AS {k}" for k, v in _RATIOS.items()) + " FROM x")
# the same at many dates: every quarter's first day
_DATES = "dt AS (SELECT DISTINCT CAST(date_trunc('quarter', filed) AS DATE) AS t FROM facts)"
_AT = lambda text: text.replace("ticker, concept", "t, ticker, concept").replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")
_WIDE_T = (
    f"{_DATES}, seen AS (SELECT t, facts.* FROM facts JOIN dt ON filed <= t), {_AT(_QUARTERS)}, {_AT(_STOCKS)}, wide AS (SELECT k.t, k.ticker, "
    + ", ".join(f"max(sk.value) FILTER (sk.concept = '{c}') AS {c}" for c in pit.STOCKS) + ", " + ", ".join(f"any_value({c}_ttm) AS {c}_ttm" for c in pit.FLOWS)
    + " FROM (SELECT DISTINCT t, ticker FROM seen) k LEFT JOIN sk ON sk.t = k.t AND sk.ticker = k.ticker LEFT JOIN (SELECT t, ticker, " + ", ".join(f"max(ttm) FILTER (concept = '{c}') AS {c}_ttm" for c in pit.FLOWS) + " FROM tt GROUP BY 1, 2) f ON f.t = k.t AND f.ticker = k.ticker GROUP BY 1, 2)"
)


def _quarter_days(f: DataFrame) -> DataFrame:
    return f.where("filed IS NOT NULL").select(F.trunc("filed", "quarter").alias("t")).distinct()


def _known_on_quarters(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The facts, which several steps read, written; and what of them was known at every quarter's first day."""
    f = written(f, "facts")
    return f, replay.as_known_on(f, _quarter_days(f))


def _ratios_on_quarters(f: DataFrame) -> DataFrame:
    f, wide = _known_on_quarters(f)
    return pit.signals(wide, _closes(f))


R.add("nj8_as_known_on_dates", "facts", lambda f: _known_on_quarters(f)[1].select("t", "ticker", *[F.round(c, 5).alias(c) for c in _COLUMNS]), f", {_WIDE_T} SELECT t, ticker, " + ", ".join(f"round({c}, 5) AS {c}" for c in _COLUMNS) + " FROM wide")
R.add("pj15_ratios_on_dates", "facts", lambda f: rounded(_ratios_on_quarters(f), *_RATIOS), f", {_WIDE_T}, {_CLOSES}, x AS (SELECT wide.*, shares_outstanding * close AS cap FROM wide LEFT JOIN cl USING (ticker)) SELECT t, ticker, " + ", ".join(f"{sr6(v)} AS {k}" for k, v in _RATIOS.items()) + " FROM x")
R.add("jn6_flow_intervals", "facts", lambda f: replay.on_dates(replay.intervals(f.where("concept IN ('revenues', 'net_income')")), _quarter_days(f)).select("t", "ticker", "concept", F.round("value", 5).alias("value")), f", {_DATES}, seen AS (SELECT t, facts.* FROM facts JOIN dt ON filed <= t), {_AT(_QUARTERS)} SELECT k.t, k.ticker, k.concept, round(ttm, 5) AS value FROM (SELECT DISTINCT t, ticker, concept FROM seen WHERE concept IN ('revenues', 'net_income')) k LEFT JOIN tt ON tt.t = k.t AND tt.ticker = k.ticker AND tt.concept = k.concept")
R.add("jn9_close_at_date", "facts", lambda f: _wide(f).select("ticker").join(_closes(f), "ticker", "left"), f", {_SEEN}, {_CLOSES} SELECT DISTINCT s.ticker, close FROM seen s LEFT JOIN cl USING (ticker)")
R.add("jn7_union_of_coverage", "facts", lambda f: f.where("concept = 'total_debt'").select("ticker").distinct().withColumn("a", F.lit(1)).join(f.where("concept = 'capex'").select("ticker").distinct().withColumn("b", F.lit(1)), "ticker", "full_outer"), " SELECT ticker, max(CASE WHEN concept = 'total_debt' THEN 1 END) AS a, max(CASE WHEN concept = 'capex' THEN 1 END) AS b FROM facts WHERE concept IN ('total_debt', 'capex') GROUP BY 1")
R.add("so2_union_of_index", "facts", lambda f: f.where("concept = 'total_debt'").select("ticker").union(f.where("concept = 'capex'").select("ticker")).distinct(), " SELECT DISTINCT ticker FROM facts WHERE concept IN ('total_debt', 'capex')")
R.add("jn6_validity_intervals", "facts", lambda f: rounded(pit.validity(f), "value"), f", v AS (SELECT DISTINCT ticker, concept, filed FROM facts WHERE concept IN ('{_STOCK}')), w AS (SELECT v.ticker, v.concept, v.filed, arg_max(f.value, (f.period_end, f.filed, f.seq)) AS value FROM v JOIN facts f ON f.ticker = v.ticker AND f.concept = v.concept AND f.filed <= v.filed GROUP BY 1, 2, 3) SELECT ticker, concept, {sr6('value')} AS value, filed AS valid_from, lead(filed) OVER (PARTITION BY ticker, concept ORDER BY filed) AS valid_to FROM w")

# coverage gates and spot checks over facts
R.add("ag4_coverage_by_concept", "facts", lambda f: rounded(guards.coverage(f, ("revenues", "net_income", "total_debt", "goodwill"), 120, 2000), "share"), f", c AS (SELECT unnest(['revenues', 'net_income', 'total_debt', 'goodwill']) AS concept), k AS (SELECT concept, count(DISTINCT ticker) AS n FROM facts WHERE year(period_end) >= 2000 GROUP BY 1) SELECT concept, coalesce(n, 0) AS tickers, {sr6('coalesce(n, 0) / 120')} AS share, concept IN ('revenues', 'net_income') AS required, concept NOT IN ('revenues', 'net_income') OR coalesce(n, 0) / 120 >= 0.9 AS ok FROM c LEFT JOIN k USING (concept)")
R.add("gd6_coverage_gate", "facts", lambda f: guards.coverage(f, guards.REQUIRED, 100, 1999).agg(F.min("ok").alias("ok"), F.count("*").alias("n")), " SELECT min(ok) AS ok, count(*) AS n FROM (SELECT concept, coalesce((SELECT count(DISTINCT ticker) FROM facts f WHERE f.concept = c.concept AND year(period_end) >= 1999), 0) / 100 >= 0.9 AS ok FROM (SELECT unnest(['revenues', 'net_income', 'stockholders_equity', 'total_assets']) AS concept) c)")
R.add("ag4_coverage_by_year", "facts", lambda f: guards.coverage_by_year(f, "capex", 1993, 2003), " SELECT y::INT AS year, coalesce(n, 0) AS tickers FROM (SELECT unnest(range(1993, 2004)) AS y) LEFT JOIN (SELECT year(period_end) AS y, count(DISTINCT ticker) AS n FROM facts WHERE concept = 'capex' GROUP BY 1) USING (y)")
R.add("fl9_recent_years", "facts", lambda f: f.where(F.year("period_end") >= 2000).agg(F.count("*").alias("n")), " SELECT count(*) AS n FROM facts WHERE year(period_end) >= 2000")
R.add("fl10_ticker_list", "facts", lambda f: f.where(F.col("ticker").isin("1", "5", "44")).groupBy("ticker").agg(F.count("*").alias("n")), " SELECT ticker, count(*) AS n FROM facts WHERE ticker IN ('1', '5', '44') GROUP BY 1")
R.add("st7_sorted_coverage", "facts", lambda f: guards.coverage(f, ("revenues", "capex"), 100, 1999).orderBy(F.desc("tickers"), "concept").select("concept", "tickers"), " SELECT concept, count(DISTINCT ticker) AS tickers FROM facts WHERE year(period_end) >= 1999 AND concept IN ('revenues', 'capex') GROUP BY 1")
_TICKERS = ("1", "2", "3", "4", "5")
_STORED = "CASE WHEN CAST(ticker AS INT) % 4 <> 3 THEN (CAST(ticker AS INT) % 4) * 3e-2 + 1e-2 END"


def stored_roe(f: DataFrame) -> DataFrame:
    """``ticker, roe``: what a ranking shows, some right, some far off."""
    return f.select("ticker").distinct().select("ticker", F.expr(_STORED).cast("double").alias("roe"))


def _spot(f: DataFrame) -> DataFrame:
    wide = _wide(f.where(F.col("ticker").isin(*_TICKERS)))
    return guards.spot_check(wide.select("ticker", expr.ratio(F.col("net_income_ttm"), F.col("stockholders_equity")).alias("value")), stored_roe(f).select("ticker", F.col("roe").alias("value")), _TICKERS)


_BAND = "CASE WHEN ours / nullif(theirs, 0) > 5 OR ours / nullif(theirs, 0) < 0.2 THEN 'RED' WHEN ours / nullif(theirs, 0) > 1.3 OR ours / nullif(theirs, 0) < 0.77 THEN 'WARN' WHEN ours IS NOT NULL AND theirs <> 0 THEN 'OK' END"
SPOT_SQL = f"{_WIDE}, sr AS (SELECT DISTINCT ticker, {_STORED} AS roe FROM facts), so AS (SELECT wide.ticker, net_income_ttm / nullif(stockholders_equity, 0) AS ours, roe AS theirs FROM wide LEFT JOIN sr USING (ticker) WHERE wide.ticker IN {_TICKERS}), sp AS (SELECT ticker, {sr6('ours')} AS ours, {sr6('theirs')} AS theirs, {sr6('ours / nullif(theirs, 0)')} AS ratio, {_BAND} AS verdict FROM so)"
for _n in ("gd7_spot_check", "jn19_stored_ratio", "pj19_verdict"):
    R.add(_n, "facts", lambda f: rounded(_spot(f), "ours", "theirs", "ratio"), f", {SPOT_SQL} SELECT * FROM sp")

# filing documents: built from rows, parsed again
_DOC_TAGS = (("us-gaap", "Revenues", "USD", 0), ("us-gaap", "SalesRevenueNet", "USD", 1), ("us-gaap", "NetIncomeLoss", "USD", 2), ("us-gaap", "LongTermDebtNoncurrent", "USD", 3), ("us-gaap", "LongTermDebtCurrent", "USD", 4), ("us-gaap", "LongTermDebt", "USD", 5), ("dei", "EntityCommonStockSharesOutstanding", "shares", 6), ("us-gaap", "CommonStockSharesOutstanding", "shares", 7), ("us-gaap", "Assets", "EUR", 8))
_VALUES = ", ".join(f"('{a}', '{b}', '{c}', {k})" for a, b, c, k in _DOC_TAGS)
_ROWS = (
    "fr AS (SELECT CAST(s AS STRING) AS cik, namespace, tag, unit, k, s, y, q, make_date(y, 3 * q - 2, 1) AS st, e AS en, e + 40 AS fi, "
    "CASE WHEN k IN (6, 7) AND (s + q) % 3 = 0 THEN 1e0 WHEN k IN (6, 7) THEN 1e6 + v + k ELSE v * (k + 1) END AS value, CONCAT('a', CAST(CASE WHEN k = 4 AND (s + y) % 4 = 0 THEN 9 ELSE q END AS STRING)) AS accn "
    f"FROM levels CROSS JOIN (VALUES {_VALUES}) AS g(namespace, tag, unit, k) WHERE (s + y + q + k) % 5 <> 0 AND NOT (k = 1 AND y > 1999) AND NOT (k = 0 AND y < 1997) AND NOT (k = 5 AND s % 3 = 0))"
)


def _docs(levels: DataFrame) -> DataFrame:
    """One document a company, in the shape of the filings, and the parsed form."""
    spark = levels.sparkSession
    tags = spark.createDataFrame([(a, b, c, k) for a, b, c, k in _DOC_TAGS], "namespace string, tag string, unit string, k int")
    rows = levels.crossJoin(F.broadcast(tags)).where("(s + y + q + k) % 5 <> 0 AND NOT (k = 1 AND y > 1999) AND NOT (k = 0 AND y < 1997) AND NOT (k = 5 AND s % 3 = 0)")
    value = F.expr("CASE WHEN k IN (6, 7) AND (s + q) % 3 = 0 THEN 1e0 WHEN k IN (6, 7) THEN 1e6 + v + k ELSE cast(v * (k + 1) as double) END")
    accn = F.expr("concat('a', cast(CASE WHEN k = 4 AND (s + y) % 4 = 0 THEN 9 ELSE q END AS string))")
    record = F.struct(F.expr("make_date(y, 3 * q - 2, 1)").cast("string").alias("start"), F.col("e").cast("string").alias("end"), value.alias("val"), accn.alias("accn"), F.col("y").alias("fy"), F.concat(F.lit("Q"), "q").alias("fp"), F.lit("10-Q").alias("form"), F.expr("e + 40").cast("string").alias("filed"))
    units = rows.groupBy("s", "namespace", "tag", "unit").agg(F.array_sort(F.collect_list(record)).alias("items"))
    by_tag = units.groupBy("s", "namespace", "tag").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "items"))).alias("units")).alias("body"))
    spaces = by_tag.groupBy("s", "namespace").agg(F.map_from_entries(F.collect_list(F.struct("tag", "body"))).alias("tags"))
    docs = spaces.groupBy("s").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("namespace", "tags"))).alias("facts"))).alias("text"))
    return facts.parsed(docs.select(F.col("s").cast("string").alias("cik"), "text"))


_REC = "SELECT cik, CAST(en AS DATE) AS period_end, fi AS filed"
R.add("nj1_path_extraction", "levels", lambda x: _docs(x).select("cik", F.coalesce(F.size(facts.records_at(F.col("doc"), "us-gaap", "Revenues", "USD")), F.lit(0)).alias("n")), f", {_ROWS} SELECT cik, count(*) FILTER (k = 0) AS n FROM fr GROUP BY 1")
R.add("nj2_flatten_records", "levels", lambda x: facts.records(_docs(x)).select("cik", "namespace", "tag", "unit", "period_start", "period_end", "filed", r6("value").alias("value")), f", {_ROWS} SELECT cik, namespace, tag, unit, st AS period_start, en AS period_end, fi AS filed, {sr6('value')} AS value FROM fr")
_CHAIN = "ch AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'revenues' ELSE 'net_income' END AS concept FROM fr WHERE k IN (0, 1, 2) QUALIFY row_number() OVER (PARTITION BY cik, CASE WHEN k IN (0, 1) THEN 'revenues' ELSE 'net_income' END, st, en, fi ORDER BY k) = 1)"
for _n in ("dd1_first_tag_wins", "so1_union_of_tags"):
    R.add(_n, "levels", lambda x: rounded(facts.chained(facts.records(_docs(x), facts.WANTED)).where("concept IN ('revenues', 'net_income')").select("cik", "concept", "period_start", "period_end", "filed", "value"), "value"), f", {_ROWS}, {_CHAIN} SELECT cik, concept, st AS period_start, en AS period_end, fi AS filed, {sr6('value')} AS value FROM ch")
R.add("dd2_first_populated_tag", "levels", lambda x: facts.first_populated_tag(facts.records(_docs(x)).join(F.broadcast(facts.chain_table(x.sparkSession)), ["namespace", "tag", "unit"])).where("concept = 'revenues'").groupBy("cik").agg(F.max("tag").alias("tag"), F.count("*").alias("n")), f", {_ROWS} SELECT cik, CASE WHEN min(k) = 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END AS tag, count(*) FILTER (k = m) AS n FROM (SELECT *, min(k) OVER (PARTITION BY cik) AS m FROM fr WHERE k IN (0, 1)) GROUP BY cik")
_SH = "sh AS (SELECT * FROM fr WHERE k IN (6, 7) AND value >= 1000000 QUALIFY row_number() OVER (PARTITION BY cik, st, en, fi ORDER BY k) = 1)"
for _n in ("nj4_shares", "fl5_shares_sentinel"):
    R.add(_n, "levels", lambda x: rounded(facts.shares(facts.records(_docs(x), facts.WANTED)).select("cik", "period_end", "filed", "value"), "value"), f", {_ROWS}, {_SH} SELECT cik, en AS period_end, fi AS filed, {sr6('value')} AS value FROM sh")
_DEBT = (
    "pr AS (SELECT cik, en, fi, sum(value) AS value FROM fr WHERE k IN (3, 4) GROUP BY cik, en, fi, accn HAVING count(*) = 2), "
    "rs AS (SELECT f.cik, f.en, f.fi, f.value FROM fr f LEFT JOIN (SELECT DISTINCT cik, en, fi, 1 AS had FROM pr) p ON p.cik = f.cik AND p.en = f.en AND p.fi = f.fi WHERE f.k = 5 AND had IS NULL)"
)
R.add("nj5_total_debt", "levels", lambda x: rounded(facts.total_debt(facts.records(_docs(x), facts.WANTED)).select("cik", "period_end", "filed", "value"), "value"), f", {_ROWS}, {_DEBT} SELECT cik, en AS period_end, fi AS filed, {sr6('value')} AS value FROM (SELECT * FROM pr UNION ALL SELECT * FROM rs)")
R.add("jn10_debt_legs", "levels", lambda x: facts.total_debt(facts.records(_docs(x), facts.WANTED)).where("period_start IS NULL").groupBy("cik").agg(F.count("*").alias("n")), f", {_ROWS}, {_DEBT} SELECT cik, count(*) AS n FROM pr GROUP BY 1")
R.add("jn11_debt_fallback", "levels", lambda x: facts.total_debt(facts.records(_docs(x), facts.WANTED)).where("period_start IS NOT NULL").groupBy("cik").agg(F.count("*").alias("n")), f", {_ROWS}, {_DEBT} SELECT cik, count(*) AS n FROM rs GROUP BY 1")
for _n in ("nj6_foreign_units", "pj25_foreign_currency"):
    R.add(_n, "levels", lambda x: facts.foreign_units(_docs(x)), f", {_ROWS} SELECT cik, count(*) FILTER (unit = 'EUR') AS foreign_facts FROM fr GROUP BY 1")


def _panel(x: DataFrame) -> DataFrame:
    docs = _docs(x)
    twice = docs.select("cik", F.explode(F.array(F.concat(F.lit("T"), "cik"), F.concat(F.lit("T"), "cik", F.lit(".B")))).alias("ticker"))
    return facts.panel(docs, twice).groupBy("ticker", "concept").agg(F.count("*").alias("n"), F.round(F.sum("value"), 1).alias("v"))


_ALL = ", un AS (SELECT cik, concept, value FROM ch UNION ALL SELECT cik, 'shares_outstanding', value FROM sh UNION ALL SELECT cik, 'total_debt', value FROM pr UNION ALL SELECT cik, 'total_debt', value FROM rs), tk AS (SELECT CONCAT('T', cik) AS ticker, * FROM un UNION ALL SELECT CONCAT('T', cik, '.B'), * FROM un) SELECT ticker, concept, count(*) AS n, round(sum(value), 1) AS v FROM tk GROUP BY 1, 2"
for _n in ("nj3_company_extraction", "nj7_build_panel", "jn12_dual_class"):
    R.add(_n, "levels", _panel, f", {_ROWS}, {_CHAIN}, {_SH}, {_DEBT}{_ALL}")


def _filed(levels: DataFrame) -> DataFrame:
    """The documents written as files, every tenth cut short, and read again as VARIANT."""
    path = f"{scratch(levels.sparkSession, 'filings')}/files"
    text = F.when(F.col("cik").cast("int") % 10 == 4, F.expr("left(text, length(text) div 2)")).otherwise(F.col("text"))
    writers.write_filings(_docs(levels).select("cik", text.alias("text")), path)
    return readers.read_filings(levels.sparkSession, path, variant=True)


def _counted(levels: DataFrame) -> DataFrame:
    spark = levels.sparkSession
    names = levels.where("s % 7 <> 3").select(F.col("s").cast("string").alias("cik")).distinct()
    names = names.select("cik", F.explode(F.array(F.concat(F.lit("T"), "cik"), F.concat(F.lit("T"), "cik", F.lit(".B")))).alias("ticker"))
    panel, counts = facts.counted_panel(_filed(levels), names)
    rows = panel.groupBy("concept").agg(F.count("*").alias("n")).select(F.concat(F.lit("rows "), "concept").alias("item"), "n")
    return rows.unionByName(spark.createDataFrame([*counts.items()], "item string, n long"))


_WELL = _ROWS.replace("WHERE (s +", "WHERE s % 10 <> 4 AND (s +", 1)
_KS = sorted({k for _, t, _, k in _DOC_TAGS if (_DOC_TAGS[k][0], t) in facts.PATHS})
R.add("sc7_filing_files", "levels", lambda x: facts.records_on_paths(_filed(x)).select("cik", "namespace", "tag", "unit", "period_start", "period_end", "filed", "accn", r6("value").alias("value")), f", {_WELL} SELECT cik, namespace, tag, unit, st AS period_start, en AS period_end, fi AS filed, accn, {sr6('value')} AS value FROM fr WHERE k IN ({', '.join(map(str, _KS))})")
_HAD = "hd AS (SELECT DISTINCT cik, CASE WHEN k = 2 THEN 'net_income' ELSE 'revenues' END AS concept FROM fr WHERE k IN (0, 1, 2) UNION SELECT cik, 'shares_outstanding' FROM sh UNION SELECT cik, 'total_debt' FROM pr UNION SELECT cik, 'total_debt' FROM rs)"
_IN = "CAST(cik AS INT) % 7 <> 3"
R.add("ag24_build_counts", "levels", _counted, f", {_WELL}, {_CHAIN}, {_SH}, {_DEBT}, {_HAD}, af AS ({_ROWS[len('fr AS ('):]}, ci AS (SELECT DISTINCT cik FROM af WHERE {_IN}), w AS (SELECT count(*) AS n FROM ci WHERE CAST(cik AS INT) % 10 <> 4), cs AS (SELECT unnest({[*facts.CHAINS, 'shares_outstanding', 'total_debt']}) AS concept), un AS (SELECT cik, concept FROM ch UNION ALL SELECT cik, 'shares_outstanding' FROM sh UNION ALL SELECT cik, 'total_debt' FROM pr UNION ALL SELECT cik, 'total_debt' FROM rs) SELECT 'rows ' || concept AS item, 2 * count(*) AS n FROM un WHERE {_IN} GROUP BY 1 UNION ALL SELECT 'malformed', count(*) FROM ci WHERE CAST(cik AS INT) % 10 = 4 UNION ALL SELECT 'seen', 2 * n FROM w UNION ALL SELECT 'foreign', count(*) FROM fr WHERE unit = 'EUR' AND {_IN} UNION ALL SELECT 'placeholders', 2 * count(*) FROM fr WHERE k IN (6, 7) AND value < 1000000 AND {_IN} UNION ALL SELECT 'missing ' || concept, 2 * (n - (SELECT count(*) FROM hd WHERE hd.concept = cs.concept AND {_IN})) FROM cs, w")
R.add("fl6_required_fields", "levels", lambda x: facts.complete(facts.records(_docs(x)).withColumn("filed", F.when(F.col("fy") > 1996, F.col("filed")))).agg(F.count("*").alias("n")), f", {_ROWS} SELECT count(*) AS n FROM fr WHERE y > 1996")
R.add("ag24_missing_concepts", "facts", lambda f: guards.missing_concepts(f, 5), " SELECT concept, (SELECT count(DISTINCT ticker) FROM facts) - count(DISTINCT ticker) AS missing FROM facts GROUP BY 1 HAVING missing > 0 ORDER BY missing DESC, concept LIMIT 5")

# universe and membership
R.add("sc1_universe", "universe", lambda u: readers.normalised_universe(u), " SELECT upper(trim(symbol)) AS ticker, lpad(trim(cik), 10, '0') AS cik, trim(sector) AS sector, trim(name) AS name, coalesce(TRY_CAST(enabled AS INT), 0) AS enabled FROM universe")
R.add("fl1_enabled_only", "universe", lambda u: readers.normalised_universe(u, True).select("ticker"), " SELECT upper(trim(symbol)) AS ticker FROM universe WHERE coalesce(TRY_CAST(enabled AS INT), 0) = 1")
R.add("sc2_research_universe", "universe", readers.research_universe, " SELECT upper(trim(symbol)) AS ticker, lpad(trim(cik), 10, '0') AS cik FROM universe WHERE coalesce(trim(enabled), '1') IN ('1', '') AND trim(coalesce(cik, '')) <> ''")
R.add("pj1_vendor_symbol", "universe", lambda u: readers.normalised_universe(u).select("ticker", expr.vendor_symbol(F.col("ticker")).alias("symbol")), " SELECT upper(trim(symbol)) AS ticker, replace(upper(trim(symbol)), '.', '-') AS symbol FROM universe")
R.add("pj2_vendor_clash", "universe", lambda u: guards.vendor_clash(readers.normalised_universe(u).unionByName(readers.normalised_universe(u).withColumn("ticker", F.replace("ticker", F.lit("."), F.lit("-"))))), " SELECT replace(upper(trim(symbol)), '.', '-') AS symbol, count(*) * 2 AS n FROM universe GROUP BY 1")
R.add("pj3_cik_forms", "universe", lambda u: u.select(expr.cik_padded(F.col("cik")).alias("padded"), expr.cik_bare(expr.cik_padded(F.col("cik"))).alias("bare")), " SELECT lpad(trim(cik), 10, '0') AS padded, cik AS bare FROM universe")
R.add("pj20_ticker_class", "changes", lambda c: c.select("seq", expr.ticker_class(F.col("ticker")).alias("tc")), " SELECT seq, replace(replace(replace(upper(trim(ticker)), ' ', ''), '-', '.'), '/', '.') AS tc FROM changes")


def _name_sql(c: str) -> str:
    out = f"lower(coalesce({c}, ''))"
    for junk in expr.NAME_JUNK:
        out = "replace({}, '{}', '')".format(out, junk.replace("'", "''"))
    return rf"trim(regexp_replace(regexp_replace({out}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


R.add("pj21_company_name", "universe", lambda u: u.select("symbol", expr.company_name(F.col("name")).alias("cn")), f" SELECT symbol, {_name_sql('name')} AS cn FROM universe")
_MATCH = f"u AS (SELECT symbol AS ticker, replace(replace(replace(upper(trim(symbol)), ' ', ''), '-', '.'), '/', '.') AS tc, {_name_sql('name')} AS cn FROM universe), c AS (SELECT replace(replace(replace(upper(trim(ticker)), ' ', ''), '-', '.'), '/', '.') AS tc, {_name_sql('name')} AS cn, date FROM changes), m AS (SELECT ticker, (SELECT max(date) FROM c WHERE c.tc = u.tc) AS a, (SELECT max(date) FROM c WHERE c.cn = u.cn AND u.cn <> '') AS b FROM u)"
R.add("jn13_two_tier_match", "universe changes", lambda u, c: membership.matched(u.withColumnRenamed("symbol", "ticker"), c), f", {_MATCH} SELECT ticker, coalesce(a, b) AS added_date, CASE WHEN a IS NOT NULL THEN 'ticker' WHEN b IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM m")
R.add("jn14_manual_override", "members", lambda m: membership.overridden(m, m.sparkSession.createDataFrame([("1", "2013-12-23")], "ticker string, d string").select("ticker", F.col("d").cast("date").alias("added_date"))), " SELECT ticker, CASE WHEN ticker = '1' THEN DATE '2013-12-23' ELSE added_date END AS added_date FROM members")
R.add("dd7_latest_event", "changes", membership.latest_events, " SELECT ticker, name, date, seq FROM changes QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC, seq) = 1")
R.add("pj24_date_coercion", "changes", lambda c: c.select("seq", F.concat(F.when(F.col("seq") % 3 == 0, "n/a ").otherwise(""), F.col("date").cast("string")).try_cast("date").alias("d")), " SELECT seq, CASE WHEN seq % 3 <> 0 THEN date END AS d FROM changes")
R.add("jn8_sector_lookup", "ranks factors", lambda r, f: r.select("ticker").join(checked(f.where("sector <> 'TINY'").select("ticker", "sector")), "ticker", "left"), " SELECT r.ticker, f.sector FROM ranks r LEFT JOIN (SELECT * FROM factors WHERE sector <> 'TINY') f ON r.ticker = f.ticker")

# publishing
_PUB = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("composite_score", "pe_ratio"))
R.add("wn16_published_rank", "ranks", lambda r: publish.ranked(r).select("rank", "ticker"), " SELECT row_number() OVER (ORDER BY composite_score DESC NULLS LAST, ticker)::INT AS rank, ticker FROM ranks")
R.add("st1_composite_order", "ranks", lambda r: publish.ranked(r).select("ticker", "rank"), " SELECT ticker, row_number() OVER (ORDER BY composite_score DESC NULLS LAST, ticker)::INT AS rank FROM ranks")
R.add("st2_leaders", "ranks", lambda r: publish.leaders(r).select("ticker", "composite_score"), " SELECT ticker, composite_score FROM ranks ORDER BY composite_score DESC NULLS LAST, ticker LIMIT 10")
R.add("pj17_published_object", "ranks", lambda r: publish.objects(r).select("rank", *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("ticker", "sector", "data_quality")], *[F.get_json_object("json", f"$.{c}").cast("double").alias(c) for c in ("composite_score", "pe_ratio", "gpa")]), f" SELECT row_number() OVER (ORDER BY composite_score DESC NULLS LAST, ticker)::INT AS rank, ticker, sector, data_quality, {_PUB}, NULL::DOUBLE AS gpa FROM ranks")
R.add("ag1_summary_statistics", "ranks", publish.summary, " SELECT count(*) AS universe_size, count(*) FILTER (data_quality = 'missing_prices') AS missing_price_count, count(*) FILTER (data_quality = 'partial_prices') AS partial_price_count, (SELECT ticker FROM ranks ORDER BY composite_score DESC, ticker LIMIT 1) AS top_symbol, max(composite_score) AS top_score, (SELECT ticker FROM ranks ORDER BY composite_score, ticker DESC LIMIT 1) AS bottom_symbol, min(composite_score) AS bottom_score, round(median(composite_score), 4) + 0.0 AS median_composite, round(avg(composite_score), 4) + 0.0 AS avg_composite, round(median(pe_ratio), 4) + 0.0 AS avg_pe, round(median(roe), 4) + 0.0 AS avg_roe FROM ranks")
R.add("st3_extremes", "ranks", lambda r: publish.summary(r).select("top_symbol", "bottom_symbol"), " SELECT (SELECT ticker FROM ranks ORDER BY composite_score DESC, ticker LIMIT 1) AS top_symbol, (SELECT ticker FROM ranks ORDER BY composite_score, ticker DESC LIMIT 1) AS bottom_symbol")
R.add("ag2_value_counts", "ranks", lambda r: publish.counts(r, "sector"), " SELECT sector, count(*) AS n FROM ranks GROUP BY 1")
R.add("ag3_freshness", "ranks", lambda r: rounded(publish.recency(r, F.lit("2024-03-20").cast("date")), "coverage"), f" SELECT max(CAST(price_asof AS DATE)) AS data_asof, datediff('day', max(CAST(price_asof AS DATE)), DATE '2024-03-20')::INT AS data_age_days, {sr6('count(price_asof) / count(*)')} AS coverage, datediff('day', max(CAST(price_asof AS DATE)), DATE '2024-03-20') <= 5 AND count(price_asof) / count(*) >= 0.9 AS data_fresh FROM ranks")
_BOTH = "bo AS (SELECT ticker, o.rank AS old_rank, n.rank AS new_rank, n.rank - o.rank AS move FROM old_ranks o JOIN new_ranks n USING (ticker))"
R.add("jn15_common_ranks", "old_ranks new_ranks", lambda o, n: publish.common(o, n).selectExpr("ticker", "old_rank", "new_rank", "cast(move as bigint) move"), f", {_BOTH} SELECT * FROM bo")
R.add("ag26_rank_correlation", "old_ranks new_ranks", lambda o, n: rounded(publish.rank_correlation(o, n), "rho"), f", {_BOTH} SELECT count(*) AS n, {sr6('corr(old_rank, new_rank)')} AS rho FROM bo")
_CHURN = "SELECT ticker, CASE WHEN o.rank <= 20 AND n.rank <= 20 THEN 'stayed' WHEN n.rank <= 20 THEN 'entered' ELSE 'left' END AS status FROM old_ranks o FULL JOIN new_ranks n USING (ticker) WHERE coalesce(o.rank <= 20, false) OR coalesce(n.rank <= 20, false)"
for _n in ("st5_top_churn", "so4_common_entered_left"):
    R.add(_n, "old_ranks new_ranks", publish.churn, f" {_CHURN}")
R.add("wn17_movers", "old_ranks new_ranks", lambda o, n: publish.movers(o, n).selectExpr("ticker", "cast(move as bigint) move", "side"), f", {_BOTH} (SELECT ticker, move, 'up' AS side FROM bo ORDER BY move, ticker LIMIT 10) UNION ALL (SELECT ticker, move, 'down' AS side FROM bo ORDER BY move DESC, ticker LIMIT 10)")
R.add("or7_rank_migration", "old_ranks new_ranks", lambda o, n: publish.churn(o, n).groupBy("status").agg(F.count("*").alias("n")), f", c AS ({_CHURN}) SELECT status, count(*) AS n FROM c GROUP BY 1")
R.add("st6_stride_sample", "ranks", lambda r: publish.strided(r, 15).select("ticker", "rank"), " SELECT ticker, rank FROM (SELECT ticker, row_number() OVER (ORDER BY composite_score DESC NULLS LAST, ticker)::INT AS rank FROM ranks) WHERE (rank - 1) % greatest(1, (SELECT count(*) FROM ranks) // 15) = 0 ORDER BY rank LIMIT 15")
R.add("st8_first_inputs", "universe", lambda u: u.orderBy("symbol").limit(7).select("symbol"), " SELECT symbol FROM universe ORDER BY symbol LIMIT 7")
_SRC = "sr AS (SELECT DISTINCT ticker, CASE WHEN ticker IN (SELECT ticker FROM base_prices) THEN 'base' WHEN ticker IN (SELECT ticker FROM vendor_prices) THEN 'fetch' ELSE 'missing' END AS source FROM prices)"


def _source(b: DataFrame, v: DataFrame, p: DataFrame) -> DataFrame:
    from ..operators import prices

    return prices.with_source(b, v, p)[1]


R.add("ag23_base_fraction", "base_prices vendor_prices prices", lambda b, v, p: guards.provenance(_source(b, v, p)), f", {_SRC} SELECT count(*) AS total, count(*) FILTER (source = 'base') AS base, count(*) FILTER (source <> 'base') AS fetch FROM sr")
_BASE_SHARE = sr6("count(*) FILTER (source = 'base') / count(*)")
R.add("gd3_base_guard", "base_prices vendor_prices prices", lambda b, v, p: rounded(guards.base_sourced(_source(b, v, p), 25, ("Brand#51",)), "base_share"), f", {_SRC} SELECT count(*) AS covered, count(*) FILTER (source = 'base') AS base, count(*) FILTER (source <> 'base' AND ticker <> 'Brand#51') AS unexpected, {_BASE_SHARE} AS base_share, count(*) > 0 AND count(*) >= 22.5 AND count(*) FILTER (source = 'base') / count(*) >= 0.9 AS ok FROM sr")
R.add("pj22_formatting", "ranks", lambda r: r.select("ticker", expr.shown(F.col("pe_ratio"), "%.2f").alias("pe"), expr.shown(F.round(F.col("roe") * 100, 6), "%.1f%%").alias("roe")), " SELECT ticker, coalesce(printf('%.2f', pe_ratio), 'n/a') AS pe, coalesce(printf('%.1f%%', round(roe * 100, 6)), 'n/a') AS roe FROM ranks")
