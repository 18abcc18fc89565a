"""Inputs of the registered queries, as SQL over the driver tables.

The tables stand for what the engine reads in production: price series, a factor table, facts. The
statements are plain SQL that Spark and DuckDB both run, so that a query and its oracle begin with the
same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _pick(k: int, m: int, scale: str, shift: str, null: int) -> str:
    """A number spread by the key, NULL for every ``null``-th."""
    return f"CASE WHEN c_custkey % {null} = 0 THEN NULL ELSE ((c_custkey * {k}) % {m}) / {scale} - {shift} END"


_FACTORS = {
    "ret_12_1": _pick(7919, 1009, "5e2", "7e-1", 17), "ret_13w": _pick(6007, 503, "1e3", "2e-1", 19), "volatility_26w": _pick(3571, 211, "4e2", "0e0", 23),
    "pe_ratio": _pick(4447, 613, "1e1", "5e0", 13), "pb_ratio": _pick(2713, 307, "2e1", "0e0", 29), "ev_ebitda": _pick(5003, 401, "1e1", "4e0", 11),
    "roe": _pick(1231, 701, "1e3", "2e-1", 7), "roic": _pick(8887, 509, "1e3", "1e-1", 31), "debt_equity": _pick(9973, 257, "1e2", "0e0", 9),
    "oper_margin_ttm": _pick(1511, 809, "2e3", "1e-1", 21), "fcf_margin_ttm": _pick(3083, 419, "2e3", "5e-2", 8), "gpa": _pick(6421, 607, "1e3", "0e0", 6),
    "net_payout_yield": _pick(7103, 151, "2e3", "0e0", 15), "dividend_yield": _pick(2203, 101, "1e3", "0e0", 14), "beta": _pick(4201, 199, "1e2", "5e-1", 27),
}

CTES = {
    "prices": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1e2 / sum(CAST(l_quantity AS BIGINT)) AS close
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)""",
    "factors": "SELECT CAST(c_custkey AS STRING) AS ticker, c_name AS name, CASE WHEN c_custkey % 97 = 0 THEN 'TINY' WHEN c_custkey % 41 = 0 THEN 'Financials' ELSE c_mktsegment END AS sector, c_acctbal AS market_cap, "
    + "CASE WHEN c_custkey % 33 = 0 THEN 'missing_prices' WHEN c_custkey % 10 = 0 THEN 'partial_prices' ELSE 'ok' END AS data_quality, "
    + ", ".join(f"{v} AS {k}" for k, v in _FACTORS.items())
    + " FROM customer",
    "slices": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(c_nationkey AS STRING) AS ticker, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e2 / count(*) AS score,
        CASE WHEN sum(o_orderkey) % 11 = 0 THEN NULL ELSE sum((o_orderkey * 31) % 201) / 1e3 / count(*) - 1e-1 END AS fwd
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE), CAST(c_nationkey AS STRING)""",
    "panel": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(c_nationkey AS STRING) AS ticker, c_mktsegment AS factor, h AS horizon, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e2 / count(*) AS score,
        sum((o_orderkey * (h + 10)) % 201) / 1e3 / count(*) - 1e-1 AS fwd
        FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (VALUES (21), (63)) AS v(h)
        GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE), CAST(c_nationkey AS STRING), c_mktsegment, h""",
    "members": """SELECT CAST(n_nationkey AS STRING) AS ticker, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE make_date(CAST(1993 + n_nationkey % 7 AS INT), 6, 15) END AS added_date
        FROM nation WHERE n_nationkey % 6 <> 5""",
    "blends": """SELECT t, ticker, fwd, CASE WHEN CAST(ticker AS INT) % 9 = 1 THEN NULL ELSE score / 1e5 END AS trend, (CAST(ticker AS INT) * 37 % 19) / 1e1 - 9e-1 + score / 3e5 AS quality,
        CASE WHEN CAST(ticker AS INT) % 7 = 2 THEN NULL ELSE (CAST(ticker AS INT) * 53 % 23) / 1e1 - 1e0 END AS value FROM slices""",
    "quarter_sums": """SELECT l_suppkey AS s, CAST(year(l_shipdate) AS INT) AS y, CAST(quarter(l_shipdate) AS INT) AS q, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v
        FROM lineitem GROUP BY l_suppkey, CAST(year(l_shipdate) AS INT), CAST(quarter(l_shipdate) AS INT)""",
    "levels": """SELECT s, y, q, v, CAST(sum(v) OVER (PARTITION BY s, y ORDER BY q) AS BIGINT) AS ytd, last_day(make_date(y, 3 * q, 1)) AS e FROM quarter_sums""",
    # ``k`` numbers quarters, ``turn`` orders a company's rows of a concept by filing, period end and period start
    "flow_rows": """SELECT s, y, q, make_date(y, 3 * q - 2, 1) AS period_start, e AS period_end, e + 40 AS filed, v AS x, CAST(y * 4 + q AS BIGINT) AS k, CAST(2 * (y * 4 + q) AS BIGINT) AS f, 1 AS turn
        FROM levels WHERE (q = 1 OR (s + y + q) % 3 = 0) AND (s * 7 + y + q) % 13 <> 0
        UNION ALL SELECT s, y, q, make_date(y, 1, 1), e, e + 40, ytd, CAST(y * 4 + q AS BIGINT), CAST(2 * (y * 4 + q) AS BIGINT), 0 FROM levels WHERE q > 1 AND (s * 5 + y + q) % 11 <> 0
        UNION ALL SELECT s, y, q, make_date(y, 1, 1), e, e + 140, ytd * 2, CAST(y * 4 + q AS BIGINT), CAST(2 * (y * 4 + q) + 3 AS BIGINT), 2 FROM levels WHERE q > 1 AND (s + y) % 5 = 0""",
    "facts": """SELECT CAST(s AS STRING) AS ticker, concept, period_start, period_end, filed, CAST(y AS DOUBLE) AS fy, x * w / 1e2 AS value,
        (CAST(s AS BIGINT) * 16 + c) * 4294967296 + (f * 10000 + k) * 4 + turn AS seq
        FROM flow_rows CROSS JOIN (VALUES ('revenues', 1e0, 1), ('net_income', 1e-1, 2), ('gross_profit', 4e-1, 3), ('operating_income', 2e-1, 4), ('operating_cash_flow', 15e-2, 5), ('capex', 3e-2, 6), ('dividends_paid', 1e-2, 7)) AS c(concept, w, c)
        WHERE NOT (concept = 'capex' AND s % 4 = 0)
        UNION ALL
        SELECT CAST(s AS STRING), concept, CAST(NULL AS DATE), e, e + 30 + CAST(s % 3 AS INT) * 50, CAST(y AS DOUBLE), v * w / 1e2, (CAST(s AS BIGINT) * 16 + c) * 4294967296 + y * 4 + q
        FROM levels CROSS JOIN (VALUES ('stockholders_equity', 3e0, 8), ('total_assets', 9e0, 9), ('total_debt', 2e0, 10), ('shares_outstanding', 1e1, 11), ('cash_and_equivalents', 5e-1, 12)) AS c(concept, w, c)
        WHERE NOT (concept = 'total_debt' AND s % 5 = 0)""",
    "statements": """SELECT CAST(c_custkey AS STRING) AS symbol, tag, CAST(q AS INT) AS q_rank, CASE WHEN (c_custkey + q * 3 + k) % 23 = 0 THEN NULL ELSE sgn * (50e0 + (c_custkey * (k + 3) + q * 17) % 97) END AS value
        FROM customer CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS q(q)
        CROSS JOIN (VALUES ('EBIT', 1, 1e0), ('Operating Income', 2, 1e0), ('Total Assets', 3, 3e1), ('Current Liabilities', 4, 1e1), ('Operating Cash Flow', 5, 1e0), ('Total Cash From Operating Activities', 6, 1e0),
          ('Capital Expenditure', 7, -1e0), ('Capital Expenditures', 8, -2e0), ('Gross Profit', 9, 1e0), ('Cash Dividends Paid', 10, -1e0), ('Dividends Paid', 11, -2e0), ('Repurchase Of Capital Stock', 12, -1e0), ('Repurchase Of Stock', 13, -1e0)) AS g(tag, k, sgn)
        WHERE (c_custkey + k) % 4 <> 0""",
    "info": """SELECT CAST(c_custkey AS STRING) AS symbol, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 1e1 END AS fcf, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS revenue,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 3e-1 END AS gross_margin, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal * 1e1 END AS market_cap, (c_custkey % 300) * 1e0 AS debt_equity, (c_custkey % 9) * 5e-1 AS dividend_yield FROM customer""",
    # every key is a rank of its own; the new ranking moves names within blocks of 64
    "old_ranks": "SELECT CAST(c_custkey AS STRING) AS ticker, CAST(c_custkey AS INT) AS rank FROM customer WHERE c_custkey % 10 <> 3",
    "new_ranks": """SELECT CAST(c_custkey AS STRING) AS ticker, CAST(c_custkey - 1 - (c_custkey - 1) % 64 + ((c_custkey - 1) % 64 * 37 + 11) % 64 + 1 AS INT) AS rank
        FROM customer WHERE c_custkey % 10 <> 4""",
    "vendor_prices": "SELECT ticker, date, close * CASE WHEN ticker < 'Brand#3' THEN 1.01e0 ELSE 1e0 END + CASE WHEN ticker = 'Brand#44' THEN 5e0 ELSE 0e0 END AS close FROM prices WHERE ticker <> 'Brand#55'",
    "base_prices": "SELECT ticker, date, close FROM prices WHERE ticker < 'Brand#45'",
    # the facts of 25 suppliers under the names of the brands that have prices
    "brand_facts": """SELECT CONCAT('Brand#', CAST(CAST(floor((CAST(ticker AS INT) - 1) / 5e0) AS INT) + 1 AS STRING), CAST((CAST(ticker AS INT) - 1) % 5 + 1 AS STRING)) AS ticker, concept, period_start, period_end, filed, fy, value, seq
        FROM facts WHERE CAST(ticker AS INT) <= 25""",
    "brand_members": """SELECT p_brand AS ticker, CASE WHEN min(p_partkey) % 4 = 0 THEN NULL ELSE make_date(CAST(1993 + min(p_partkey) % 6 AS INT), 6, 15) END AS added_date
        FROM part WHERE p_brand <> 'Brand#13' GROUP BY p_brand""",
    "universe": """SELECT CONCAT(' b', CAST(s_suppkey % 7 AS STRING), '.', CAST(s_suppkey AS STRING), ' ') AS symbol, CONCAT('The ', s_name, CASE WHEN s_suppkey % 2 = 0 THEN ', Inc.' ELSE ' Holdings Corp.' END) AS name,
        CAST(s_suppkey * 137 AS STRING) AS cik, CASE WHEN s_suppkey % 5 = 0 THEN 'x' WHEN s_suppkey % 3 = 0 THEN '0' ELSE '1' END AS enabled, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(s_nationkey AS STRING) END AS sector FROM supplier""",
    "changes": """SELECT CASE WHEN s_suppkey % 4 = 0 THEN CONCAT('OLD', CAST(s_suppkey AS STRING)) ELSE upper(CONCAT('b', CAST(s_suppkey % 7 AS STRING), '-', CAST(s_suppkey AS STRING))) END AS ticker,
        CASE WHEN s_suppkey % 9 = 0 THEN 'Else Co.' ELSE CONCAT(s_name, ' Company') END AS name, make_date(CAST(1990 + (s_suppkey * k) % 30 AS INT), CAST(1 + s_suppkey % 12 AS INT), CAST(1 + k AS INT)) AS date, s_suppkey * 10 + k AS seq
        FROM supplier CROSS JOIN (VALUES (1), (2)) AS r(k) WHERE s_suppkey % 6 <> 0""",
    "ranks": "SELECT ticker, name, sector, data_quality, round(ret_12_1, 4) AS composite_score, ret_12_1, ret_13w, pe_ratio, roe, beta, CASE WHEN CAST(ticker AS INT) % 12 = 0 THEN NULL ELSE CONCAT('2024-03-', lpad(CAST(CAST(ticker AS INT) % 9 + 10 AS STRING), 2, '0')) END AS price_asof FROM factors WHERE ret_12_1 IS NOT NULL",
}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in re.findall(r"(?:FROM|JOIN)\s+(\w+)", CTES[n]):
            if m in CTES:
                out += [x for x in _needed([m]) if x not in out]
        if n not in out:
            out.append(n)
    return out


def sql(names: str, body: str) -> str:
    """``body`` after the surrogates that it names (and those that they need)."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in _needed(names.split())) + "\n" + body


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = sql(name, f"SELECT * FROM {name}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({TABLES.replace(' ', '|')})\b", rf"\1 parquet.`{sf_dir}/\2.parquet` AS \2", text))
