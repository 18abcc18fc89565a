"""Round trips through files, and jobs composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import jobs
from ..operators import backtest, publish
from ..shared import scratch
from ..sources import readers, writers
from .backtest_queries import _IC2, _ICP, _MEM, _SUM, _WEEKLY
from .facts_queries import _TICKERS, AS_OF, SPOT_SQL, stored_roe
from .registry import Registry, r6, rounded, sr6

R = Registry()


def _through(df: DataFrame, name: str, write, read) -> DataFrame:
    """``df`` written as files and read again."""
    path = f"{scratch(df.sparkSession, name)}/files"
    write(df, path)
    return read(df.sparkSession, path)


# sources and sinks: what is written is read again
R.add("sc3_price_files", "prices", lambda p: _through(p, "prices", writers.write_prices, readers.read_prices), " SELECT ticker, date, close FROM prices")
R.add("sk1_price_files", "prices", lambda p: _through(p, "prices", writers.write_price_files, readers.read_price_files), " SELECT ticker, date, close FROM prices WHERE ticker IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL")


def _fact_files(f: DataFrame) -> DataFrame:
    full = f.withColumns({"cik": F.col("ticker"), "unit": F.lit("USD"), "form": F.lit("10-Q"), "fp": F.lit("Q1")})
    return rounded(_through(full, "panel", writers.write_fact_panel, readers.read_fact_panel).drop("seq"), "value")


for _n in ("sc6_fact_panel_files", "sk3_fact_panel_files"):
    R.add(_n, "facts", _fact_files, f" SELECT ticker, lpad(ticker, 10, '0') AS cik, concept, 'USD' AS unit, period_start, period_end, filed, '10-Q' AS form, fy, 'Q1' AS fp, {sr6('value')} AS value FROM facts")
for _n in ("sc9_ranks_files", "sk2_ranks_files"):
    R.add(_n, "ranks", lambda r: _through(r.select("ticker", "sector", "composite_score", "roe", "data_quality"), "ranks", writers.write_ranks, readers.read_ranks).select(F.col("ticker").cast("string").alias("ticker"), "sector", "data_quality", r6("composite_score").alias("composite_score"), r6("roe").alias("roe")), f" SELECT ticker, sector, data_quality, {sr6('composite_score')} AS composite_score, {sr6('roe')} AS roe FROM ranks")


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


R.add("sc11_membership_files", "members", lambda m: _through(m, "members", _write_csv, readers.read_membership), " SELECT ticker, added_date FROM members")
for _n in ("sc8_summary_file", "sk4_summary_file"):
    R.add(_n, "ranks", lambda r: _through(publish.summary(r), "summary", writers.write_summary, lambda s, p: s.read.json(p)).select("universe_size", "top_symbol", r6("median_composite").alias("median_composite")), f" SELECT count(*) AS universe_size, (SELECT ticker FROM ranks ORDER BY composite_score DESC, ticker LIMIT 1) AS top_symbol, {sr6('round(median(composite_score), 4)')} AS median_composite FROM ranks")


def _results(s: DataFrame) -> DataFrame:
    path = scratch(s.sparkSession, "results")
    writers.write_results({"ic": backtest.information_coefficients(s, ["t"])}, path)
    back = s.sparkSession.read.option("header", True).option("inferSchema", True).csv(f"{path}/ic")
    return back.select(F.col("t").cast("date").alias("t"), F.col("n").cast("long").alias("n"))


R.add("sk5_result_files", "slices", _results, " SELECT t, count(*) AS n FROM slices WHERE score IS NOT NULL AND fwd IS NOT NULL GROUP BY t")


def _coverage_files(f: DataFrame) -> DataFrame:
    by_concept = f.groupBy("concept").agg(F.count_distinct("ticker").alias("tickers"))
    by_year = f.groupBy(F.year("period_end").alias("year")).agg(F.count_distinct("ticker").alias("tickers"))
    path = scratch(f.sparkSession, "coverage")
    writers.write_coverage(by_concept, by_year, path)
    read = lambda name, key: f.sparkSession.read.option("header", True).csv(f"{path}/{name}").select(F.lit(name).alias("section"), F.col(key).alias("item"), F.col("tickers").cast("long").alias("tickers"))
    return read("by_concept", "concept").unionByName(read("by_year", "year"))


R.add("sk6_coverage_files", "facts", _coverage_files, " SELECT 'by_concept' AS section, concept AS item, count(DISTINCT ticker) AS tickers FROM facts GROUP BY concept UNION ALL SELECT 'by_year', CAST(year(period_end) AS VARCHAR), count(DISTINCT ticker) FROM facts GROUP BY year(period_end)")
_SOURCE = " SELECT DISTINCT ticker, CASE WHEN ticker IN (SELECT ticker FROM base_prices) THEN 'base' WHEN ticker IN (SELECT ticker FROM vendor_prices) THEN 'fetch' ELSE 'missing' END AS source FROM prices"
R.add("sk8_price_source_file", "base_prices vendor_prices prices", lambda b, v, p: _through(jobs.base_first(lambda: b, v, p)[1], "source", writers.write_price_source, lambda s, path: s.read.json(path)), _SOURCE)


def _unreadable() -> DataFrame:
    raise OSError("no archive")


# jobs
R.add("gd5_price_fallback", "vendor_prices prices", lambda v, p: jobs.base_first(_unreadable, v, p)[1], " SELECT DISTINCT ticker, CASE WHEN ticker IN (SELECT ticker FROM vendor_prices) THEN 'fetch' ELSE 'missing' END AS source FROM prices")
_UNI = "SELECT DISTINCT replace(ticker, '#', '.') AS ticker, CASE WHEN ticker < 'Brand#3' THEN 'A' ELSE 'B' END AS sector FROM prices"


def _universe(p: DataFrame) -> DataFrame:
    return p.select(F.replace("ticker", F.lit("#"), F.lit(".")).alias("ticker"), F.when(F.col("ticker") < "Brand#3", "A").otherwise("B").alias("sector")).distinct()


def _archive(p: DataFrame) -> DataFrame:
    return p.withColumn("ticker", F.upper(F.replace("ticker", F.lit("#"), F.lit("-"))))


def _panel(b: DataFrame, p: DataFrame) -> DataFrame:
    panel = jobs.load_panel(_universe(p), _archive(b))
    bars = panel.close.groupBy("ticker").agg(F.count("*").alias("bars"))
    return bars.join(panel.sectors, "ticker").unionByName(panel.dropped.withColumns({"bars": F.lit(0).cast("long"), "sector": F.lit(None).cast("string")}))


R.add("or1_load_panel", "base_prices prices", _panel, f", u AS ({_UNI}), b AS (SELECT upper(replace(ticker, '#', '.')) AS ticker, count(*) AS n FROM base_prices GROUP BY 1) SELECT upper(u.ticker) AS ticker, coalesce(n, 0) AS bars, CASE WHEN n IS NOT NULL THEN sector END AS sector FROM u LEFT JOIN b ON upper(u.ticker) = b.ticker")


def _ranked(p: DataFrame) -> DataFrame:
    """The job over short and long histories; fundamentals from the table of factors would be other names."""
    names = _universe(p).withColumn("ticker", F.replace("ticker", F.lit("."), F.lit("#"))).withColumn("name", F.col("ticker"))
    fundamentals = names.select("ticker", F.length("ticker").cast("double").alias("roe"), F.lit(1.0).alias("gpa"))
    bars = p.where("ticker <> 'Brand#11' AND (ticker <> 'Brand#12' OR year(date) = 1995)")
    return jobs.ranked_factors(names, bars, fundamentals).select("ticker", "price_asof", "data_quality", r6("ret_12_1").alias("ret_12_1"), (F.col("composite_score").isNotNull()).alias("scored"))


R.add("or3_ranked_factors", "prices", _ranked, f", pr AS (SELECT * FROM prices WHERE ticker <> 'Brand#11' AND (ticker <> 'Brand#12' OR year(date) = 1995)), {_WEEKLY.replace('FROM prices', 'FROM pr')}, k AS (SELECT ticker, count(*) AS weeks FROM ws GROUP BY 1), x AS (SELECT ticker, date, row_number() OVER o AS n, lag(close, 21) OVER o / nullif(lag(close, 252) OVER o, 0) - 1 AS r FROM pr WINDOW o AS (PARTITION BY ticker ORDER BY date)), l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM x), n AS (SELECT DISTINCT ticker FROM prices) SELECT n.ticker, CASE WHEN l.n > 1 THEN strftime(l.date, '%Y-%m-%d') END AS price_asof, CASE WHEN coalesce(l.n, 0) <= 1 THEN 'missing_prices' WHEN l.r IS NOT NULL AND weeks > 26 THEN 'ok' ELSE 'partial_prices' END AS data_quality, {sr6('l.r')} AS ret_12_1, true AS scored FROM n LEFT JOIN l ON n.ticker = l.ticker AND back = 1 LEFT JOIN k ON n.ticker = k.ticker")


def _published(r: DataFrame) -> DataFrame:
    out = jobs.published(r, F.lit("2024-03-20").cast("date"))
    counts = [F.lit(k).alias("part") for k in out]
    parts = [df.agg(F.count("*").alias("n")).select(c, "n") for c, df in zip(counts, out.values())]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


R.add("or5_published", "ranks", _published, " SELECT 'ranked_stocks' AS part, count(*) AS n FROM ranks UNION ALL SELECT 'leaders', least(10, count(*)) FROM ranks UNION ALL SELECT 'market_summary', 1 UNION ALL SELECT 'sectors', count(DISTINCT coalesce(sector, '')) FROM ranks UNION ALL SELECT 'quality', count(DISTINCT data_quality) FROM ranks")


def _gates(f: DataFrame, u: DataFrame) -> DataFrame:
    universe = readers.normalised_universe(u, enabled_only=True)
    out = jobs.gates(f, universe, stored_roe(f), ("revenues", "capex", "goodwill"), _TICKERS, as_of=F.lit(AS_OF).cast("date"))
    covered = out["by_concept"].select(F.lit("by_concept").alias("part"), F.col("concept").alias("item"), F.col("tickers").cast("double").alias("value"), r6("share").alias("share"), F.col("ok").cast("string").alias("verdict"))
    return covered.unionByName(out["spot_check"].select(F.lit("spot_check").alias("part"), F.col("ticker").alias("item"), r6("ours").alias("value"), r6("ratio").alias("share"), "verdict"))


R.add("or6_gates", "facts universe", _gates, f", {SPOT_SQL}, s AS (SELECT count(*) AS size FROM universe WHERE TRY_CAST(enabled AS INT) = 1), c AS (SELECT unnest(['revenues', 'capex', 'goodwill']) AS concept), k AS (SELECT concept, count(DISTINCT ticker) AS n FROM facts WHERE year(period_end) >= 2024 GROUP BY 1) SELECT 'by_concept' AS part, concept AS item, coalesce(n, 0)::DOUBLE AS value, {sr6('coalesce(n, 0) / size')} AS share, CAST(NOT (concept = 'revenues') OR coalesce(n, 0) / size >= 0.9 AS VARCHAR) AS verdict FROM c LEFT JOIN k USING (concept), s UNION ALL SELECT 'spot_check', ticker, ours, ratio, verdict FROM sp")
R.add("or8_reconciliation", "prices vendor_prices", lambda p, v: rounded(jobs.reconciliation(p.select("ticker").distinct(), p, v, 7).drop("worst"), "max_diff"), f", n AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT ticker FROM prices)), k AS (SELECT ticker FROM n WHERE i % greatest(1, size // 7) = 0 AND i < 7 * greatest(1, size // 7)) SELECT ticker, count(*) AS n, {sr6('max(abs(p.close / v.close - 1))')} AS max_diff FROM prices p JOIN vendor_prices v USING (ticker, date) WHERE ticker IN (SELECT ticker FROM k) GROUP BY 1 HAVING count(*) >= 20")
FH = ["factor", "horizon"]


def _backtest(p: DataFrame, m: DataFrame) -> DataFrame:
    out = jobs.backtested(p, m, FH)
    ic = out["ic_summary"].select(F.lit("ic").alias("part"), *FH, "n", r6("mean").alias("value"))
    bias = out["bias"].select(F.lit("bias").alias("part"), *FH, F.lit(None).cast("long").alias("n"), r6("bias").alias("value"))
    return ic.unionByName(bias)


R.add("or2_backtest", "panel members", _backtest, f", {_MEM.format('panel')}, {_ICP}, {_SUM}, {_IC2}, u AS (SELECT factor, horizon, avg(ic) AS u FROM ic GROUP BY 1, 2), w AS (SELECT factor, horizon, avg(ic) AS v FROM ic2 GROUP BY 1, 2) SELECT 'ic' AS part, factor, horizon, n, {sr6('mean')} AS value FROM sm UNION ALL SELECT 'bias', factor, horizon, NULL, {sr6('u - v')} FROM u JOIN w USING (factor, horizon)")
R.add("or9_membership_optional", "slices", lambda s: s.transform(lambda x: jobs.membership.eligible(x, None)).groupBy("t").agg(F.count("*").alias("n")), " SELECT t, count(*) AS n FROM slices GROUP BY t")
