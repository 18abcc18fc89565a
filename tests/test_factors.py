"""Factor scores and rank functions on small universes with known results."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from zscape.functions.expr import norm_ppf
from zscape.operators import scoring

FACTORS = sorted({n for s in scoring.WEIGHTS["subfactors"].values() for n in s})


def universe(spark, columns, sectors=None):
    """Names ``n0, n1, ...``; ``columns`` maps a factor to its values. Other factors are missing altogether."""
    size = len(next(iter(columns.values())))
    rows = [(f"n{i}", sectors[i] if sectors else "one", *(c[i] for c in columns.values())) for i in range(size)]
    return spark.createDataFrame(rows, ", ".join(["ticker string", "sector string", *(f"{c} double" for c in columns)]))


def scores(df):
    return {r["ticker"]: r for r in scoring.best_first(scoring.build_scores(df)).collect()}


def rankit(values):
    """Gaussian ranks by definition, from the standard library."""
    n, order = len(values), sorted(values)
    mean_rank = lambda v: order.index(v) + (order.count(v) + 1) / 2
    return [statistics.NormalDist().inv_cdf((mean_rank(v) - 0.5) / n) for v in values]


def standard(z):
    return [(v - statistics.fmean(z)) / statistics.pstdev(z) for v in z]


def test_normal_quantile(spark):
    ps = [10.0**-k for k in range(1, 13)] + [k / 64 for k in range(1, 64)]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(norm_ppf(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], abs=1e-8)


def test_a_bucket_is_the_standard_gaussian_rank(spark):
    values = [3.5, -1.0, 8.25, 0.0, 3.5, 41.0, -7.5, 2.0, 5.0, 6.0, 7.0]
    want = standard(rankit(values))
    got = scores(universe(spark, {"ret_12_1": values}))
    assert [got[f"n{i}"]["trend_score"] for i in range(len(values))] == pytest.approx(want, abs=6e-5)
    # the other buckets have no spread, so the composite can't take from them
    assert all(r["quality_score"] == r["value_score"] == r["risk_score"] == 0.0 for r in got.values())
    shown = [int(t[1:]) for t in got]
    assert [values[i] for i in shown] == sorted(values, reverse=True) and shown.index(0) < shown.index(4)


def test_less_is_better_and_multiples_are_yields(spark):
    n = 14
    got = scores(universe(spark, {"debt_equity": [float(i) for i in range(n)], "volatility_26w": [0.01 * i for i in range(n)], "pe_ratio": [4.0 + i for i in range(n)], "ev_ebitda": [-2.0] + [5.0 + i for i in range(n - 1)]}))
    risk, value = [got[f"n{i}"]["risk_score"] for i in range(n)], [got[f"n{i}"]["value_score"] for i in range(n)]
    assert risk == sorted(risk, reverse=True) and value[1:] == sorted(value[1:], reverse=True)
    assert value[0] < value[1]  # a negative multiple is a negative yield: the worst


@pytest.mark.parametrize("outside", ["ret_13w", "pb_ratio", "roic", "dividend_yield", "market_cap"])
def test_columns_outside_the_buckets_do_not_count(spark, outside):
    got = scores(universe(spark, {outside: [0.5 * i * i for i in range(13)]}))
    assert {v for r in got.values() for v in (r["trend_score"], r["quality_score"], r["value_score"], r["risk_score"], r["composite_score"])} == {0.0}


def test_below_half_of_the_weight_there_is_no_score(spark):
    n = 16
    ramp = [float(i) for i in range(n)]
    two = universe(spark, {"roe": [None, *ramp[1:]], "gpa": ramp[::-1]})  # two of four quarters, or one
    raw = {r["ticker"]: r["quality_score"] for r in scoring.buckets(two, []).collect()}
    assert raw["n0"] is None and all(v is not None for t, v in raw.items() if t != "n0")
    assert scores(two)["n0"]["quality_score"] == 0.0


def test_sectors_are_neutral_unless_small(spark):
    sectors = ["a"] * 20 + ["b"] * 20 + ["few"] * 4
    values = [float(i) for i in range(20)] + [1000.0 + i for i in range(20)] + [5000.0 + i for i in range(4)]
    got = scores(universe(spark, {"ret_12_1": values}, sectors))
    means = {s: statistics.fmean(got[f"n{i}"]["trend_score"] for i in range(44) if sectors[i] == s) for s in set(sectors)}
    assert abs(means["a"]) < 1e-4 and abs(means["b"]) < 1e-4 and means["few"] > 1


def test_risk_is_scored_but_not_blended(spark):
    got = scores(universe(spark, {"beta": [1.5 - 0.1 * i for i in range(15)], "debt_equity": [2.0 * i * (-1) ** i for i in range(15)]}))
    assert len({r["risk_score"] for r in got.values()}) > 5 and {r["composite_score"] for r in got.values()} == {0.0}


def test_cross_sections_are_scored_apart(spark):
    rows = [(d, f"n{i}", "one", float((i * k) % 17)) for d, k in (("x", 3), ("y", 5)) for i in range(17)]
    both = spark.createDataFrame(rows, "day string, ticker string, sector string, ret_12_1 double")
    got = {(r["day"], r["ticker"]): r["composite_score"] for r in scoring.build_scores(both, ["day"]).collect()}
    for d in ("x", "y"):
        alone = scores(both.where(f"day = '{d}'"))
        assert {t: r["composite_score"] for t, r in alone.items()} == {t: v for (day, t), v in got.items() if day == d}


def test_variance_shares_are_equal(spark):
    rng = random.Random(4)
    columns = ("ret_12_1", "roe", "gpa", "oper_margin_ttm", "fcf_margin_ttm", "pe_ratio", "ev_ebitda", "net_payout_yield")
    common = [rng.gauss(0, 0.4) for _ in range(400)]
    df = universe(spark, {c: [20 + k + v * (-1 if c in scoring.AS_YIELD else 1) + rng.gauss(0, 1 + k % 3) for v in common] for k, c in enumerate(columns)})
    names = [f"{b}_score" for b in scoring.BUCKETS]
    rows = scoring.buckets(df, []).select(*names)
    w = rows.agg(*scoring.covariances(names)).select("*", scoring.equal_contribution(names, None).alias("w")).first()
    cov = [[w[f"{a}*{b}" if i <= j else f"{b}*{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)]
    parts = [w["w"][i] * sum(cov[i][j] * w["w"][j] for j in range(3)) for i in range(3)]
    assert sum(w["w"]) == pytest.approx(1) and max(parts) - min(parts) < 1e-6 * sum(parts)


def test_empty_universe(spark):
    assert scoring.build_scores(universe(spark, {"ret_12_1": [1.0]}).where("false")).count() == 0
