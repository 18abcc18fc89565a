"""Ranks over range partitions against the window forms, rows that share a ticker, and standard errors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zscape.functions import ranks
from zscape.operators import backtest, cross_section, scoring


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "b", None]), rng.choice(["s", "t", "u", None]), rng.choice([None, -0.0, 0.0, 1.5, 2.0, 7.0]) if i % 3 else rng.random()) for i in range(600)]
    return spark.createDataFrame(data, "i int, own string, sector string, v double").repartition(7)


@pytest.mark.parametrize("own", [[], ["own"]])
def test_ranks_equal_the_window_form(spark, rows, own):
    want = {r["i"]: r["r"] for r in rows.withColumn("_1", F.lit(1)).select("i", ranks.average_rank("v", own or ["_1"]).alias("r")).collect()}
    table = cross_section.value_ranks(rows, "v", own)
    got = {r["i"]: r["rank"] for r in cross_section.beside(rows.where("v IS NOT NULL"), table, [*own, "v"]).collect()}
    assert got == {i: r for i, r in want.items() if r is not None}


def test_few_values_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v"))
        got = {r["v"]: r["rank"] for r in cross_section.value_ranks(df, "v", []).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    values = np.arange(5000) % 7
    assert got == {float(k): float(np.flatnonzero(np.sort(values) == k).mean() + 1) for k in range(7)}


def test_neutral_scores_equal_the_window_form(rows):
    df = rows.withColumn("_g", ranks.gaussian_rank("v", ["own"]))
    want = {r["i"]: r["z"] for r in df.select("i", ranks.sector_neutral("_g", "sector", ["own"]).alias("z")).collect() if r["z"] is not None}
    got = {r["i"]: r["z"] for r in cross_section.neutral_scores(rows, "v", "sector", ["own"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_no_window_over_a_whole_cross_section(rows):
    plan = cross_section.neutral_scores(rows, "v", "sector", [])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # sums over the rows of one range partition, and over the sums of the partitions
    assert windows and all("windowspecdefinition(pid" in w if "sum(_times" in w else "sum(_in" in w for w in windows)



def test_few_values_move_no_row_to_their_ranks(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = cross_section.neutral_scores(rows, "v", "sector", ["own"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_values_with_large_ones_score_the_same(rows, monkeypatch):
    want = {r["i"]: r["z"] for r in cross_section.neutral_scores(rows, "v", "sector", ["own"]).collect()}
    monkeypatch.setattr(cross_section, "VALUE_BYTES", cross_section.BROADCAST_BYTES // 9)
    monkeypatch.setattr(cross_section, "HOT", 20)
    out = cross_section.neutral_scores(rows, "v", "sector", ["own"])
    got = {r["i"]: r["z"] for r in out.collect()}
    assert got.keys() == want.keys() and out.count() == len(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert "Join LeftAnti" in out._jdf.queryExecution().optimizedPlan().toString()



def test_rows_of_one_partition_are_dealt_out(spark, rows, monkeypatch):
    parts, real = [], scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, name: parts.append((name, df.rdd.getNumPartitions())) or real(df, name))
    one = rows.coalesce(1).withColumnRenamed("v", "roe")
    assert scoring.build_scores(one).count() == 600 and ("rows", 4) in parts


def test_no_task_reads_all_rows_on_the_way_to_the_scores(spark, tmp_path):
    """Read by map output, a shuffle has as few tasks as its input had files: here one, with all rows."""
    df = spark.range(20000, numPartitions=1).select(F.col("id").cast("string").alias("ticker"), F.concat(F.lit("s"), F.col("id") % 5).alias("sector"), *[((F.col("id") * k) % 97 / 10).alias(n) for k, n in ((7, "ret_12_1"), (11, "roe"), (13, "beta"))])
    df.write.parquet(str(tmp_path / "one"))
    keys = {"spark.sql.autoBroadcastJoinThreshold": "64k", "spark.sql.files.maxPartitionBytes": "1g"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    plans, real = [], scoring.written
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(scoring, "written", lambda d, name: plans.append(d) or real(d, name))
            out = scoring.build_scores(spark.read.parquet(str(tmp_path / "one")))
            assert out.count() == 20000
        scored = next(d for d in plans if "trend_score" in d.columns)  # the buckets' rows
        scored.collect()
        assert "AQEShuffleRead local" not in scored._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_rows_that_share_a_ticker_or_have_none_are_all_scored(spark):
    data = [(t, "s", float(k), 0.1 * k) for k, t in enumerate(["A", "B", "A", None, None, "C", *(f"N{i}" for i in range(11))])]
    out = scoring.build_scores(spark.createDataFrame(data, "ticker string, sector string, ret_12_1 double, roe double")).collect()
    assert sorted((r["ticker"] or "", r["ret_12_1"]) for r in out) == sorted((t or "", x) for t, _, x, _ in data)
    by_signal = sorted(out, key=lambda r: r["ret_12_1"])
    assert all(a["trend_score"] < b["trend_score"] for a, b in zip(by_signal, by_signal[1:]))


def plain_newey_west(x, lag=3):
    x = np.array(x) - np.mean(x)
    n = len(x)
    total = x @ x / n + sum(2 * (1 - k / (lag + 1)) * (x[k:] @ x[:-k]) / n for k in range(1, min(lag, n - 1) + 1))
    return np.sqrt(total / n) if n >= 2 and total > 0 else None


def test_standard_errors_take_three_lags_and_shares_are_percent(spark):
    rng = np.random.default_rng(3)
    series = {f"f{n}": rng.normal(0.02, 0.1, n).cumsum() / 4 for n in (2, 3, 5, 40)} | {"zero": np.array([0.0, 0.0, 0.3, -0.1])}
    data = [(f, f"20{10 + k // 12}-{k % 12 + 1:02d}-01", float(v)) for f, xs in series.items() for k, v in enumerate(xs)]
    ics = spark.createDataFrame(data, "factor string, t string, ic double")
    out = {r["factor"]: r for r in backtest.ic_summary(ics, ["factor"]).collect()}
    for f, xs in series.items():
        se = plain_newey_west(xs)
        assert out[f]["t_nw"] == pytest.approx(np.mean(xs) / se) if se else out[f]["t_nw"] is None
        assert out[f]["pct_pos"] == pytest.approx(100 * np.mean(xs > 0))
