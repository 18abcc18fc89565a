"""Registered queries against their SQL, run by DuckDB on the smallest driver tables."""

import math
import os

import pytest

from zscape.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHOSEN = (
    "wn3_sector_neutral", "cp2_buckets", "cp5_erc_research", "wn7_volatility_26w", "jn5_as_of_bars", "ag8_beta", "ag11_ic_summary", "ag15_quintile_spread",
    "fl3_membership_filter", "dd1_first_tag_wins", "nj5_total_debt", "nj10_discrete_quarters", "pj10_roic", "jn13_two_tier_match", "pj17_published_object", "or7_rank_migration",
    "wn14_previous_book", "cp6_renormalize", "ag28_market_daily_mean", "st6_stride_sample", "sc3_price_files", "sk1_price_files", "sc6_fact_panel_files", "sk6_coverage_files", "or1_load_panel", "or2_backtest", "or8_reconciliation",
    "sc7_filing_files", "ag24_build_counts", "nj6_foreign_units", "nj7_build_panel", "cp9_scheme_results", "cp11_price_signals", "nj8_as_known_on_dates", "pj15_ratios_on_dates",
)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v if v is None else str(v)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    result = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    df = catalog.queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == want


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
