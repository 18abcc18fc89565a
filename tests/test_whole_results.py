"""Queries that give all of their reference's result: no fewer draws, rows or steps."""

import os

import numpy as np
import pytest

from zscape.operators import backtest, publish, scoring
from zscape.plans import catalog, surrogates

SF_DIR = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver tables are not here")


@driver_tables
def test_bootstrap_is_a_loop_of_2000_draws(spark):
    series = {}
    for r in backtest.information_coefficients(surrogates.frame(spark, SF_DIR, "panel"), ["factor", "horizon", "t"]).where("ic IS NOT NULL").collect():
        series.setdefault((r["factor"], r["horizon"]), []).append((r["t"], r["ic"]))
    got = {(r["factor"], r["horizon"]): (r["ci_lo"], r["ci_hi"]) for r in catalog.queries()["ag12_block_bootstrap"](spark, SF_DIR).collect()}
    assert set(series) <= set(got) and any(len(s) >= 3 for s in series.values())
    for key, s in series.items():
        x = np.array([ic for _, ic in sorted(s)])
        if len(x) < 3:
            assert got[key] == (None, None)
            continue
        rng, means = np.random.default_rng(20260706), []
        for _ in range(2000):
            starts = rng.choice(np.arange(len(x)), size=-(-len(x) // 3), replace=True)
            means.append(x[((starts[:, None] + np.arange(3)).ravel() % len(x))[: len(x)]].mean())
        assert np.allclose(got[key], np.percentile(means, [2.5, 97.5]), atol=2e-6), key


def whole_ranking():
    """The ranking in full, by the SQL of another query."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{t}'")
    return [(t, k) for k, t in sorted(con.execute(catalog.oracle_sql()["wn16_published_rank"]).fetchall())]


@driver_tables
def test_composite_order_has_every_row(spark):
    want = whole_ranking()
    assert len(want) > 50
    assert sorted(map(tuple, catalog.queries()["st1_composite_order"](spark, SF_DIR).collect()), key=lambda r: r[1]) == want


@driver_tables
def test_stride_follows_the_number_of_rows(spark):
    want = whole_ranking()
    got = [tuple(r) for r in catalog.queries()["st6_stride_sample"](spark, SF_DIR).collect()]
    assert sorted(got, key=lambda r: r[1]) == want[:: max(1, len(want) // 15)][:15]
    for n in (0, 7, 15, 31, 200):
        rows = spark.range(n).selectExpr("cast(id as string) ticker", "cast(-id as double) composite_score")
        assert [r["rank"] for r in publish.strided(rows, 15).collect()] == [*range(1, n + 1)][:: max(1, n // 15)][:15]


def test_equal_contribution_takes_as_many_steps_as_the_reference(spark):
    # the first settles at once, the second needs more than 300 steps
    for a, b, c in ((0.1, 0.2, 0.3), (-0.46263152887829984, -0.1302553041061469, 0.020046532167428913)):
        cov = np.array([[1, a, b], [a, 1, c], [b, c, 1]])
        w = np.full(3, 1 / 3)
        for _ in range(10_000):
            share = w * (cov @ w) / (w @ cov @ w)
            new = w * np.sqrt(1 / 3 / np.where(share <= 0, 1e-15, share))
            new, w = w, new / new.sum()
            if np.abs(new - w).max() < 1e-10:
                break
        names = list("xyz")
        row = [(float(cov[i][j]), f"{names[i]}*{names[j]}") for i in range(3) for j in range(i, 3)]
        df = spark.createDataFrame([tuple(v for v, _ in row)], [n for _, n in row])
        assert np.allclose(df.select(scoring.equal_contribution(names, None)).first()[0], w, atol=1e-6)
