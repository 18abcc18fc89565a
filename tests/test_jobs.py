"""How jobs fail, what they leave out, and how they fall back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from zscape import jobs

BARS = "ticker string, date date, close double"


def bars(spark, **closes):
    first = dt.date(2020, 1, 1)
    return spark.createDataFrame([(t.replace("_", "-"), first + dt.timedelta(days=i), float(c)) for t, cs in closes.items() for i, c in enumerate(cs)], BARS)


def test_steps_go_on_after_one_that_fails():
    ran = []

    def fails():
        ran.append("b")
        raise jobs.Refused("no rows")

    steps = {"a": lambda: ran.append("a"), "b": fails, "c": lambda: ran.append("c")}
    done = jobs.run_steps(steps)
    assert ran == ["a", "b", "c"] and done == {"a": True, "b": False, "c": True} and jobs.exit_code(done) == 1
    assert jobs.run_steps(steps, ["c", "a", "unknown"]) == {"a": True, "c": True} and jobs.exit_code({"a": True}) == 0
    assert jobs.run_steps(steps, ["unknown"]) == {} and jobs.exit_code({}) == 1


def test_a_table_without_rows_is_refused(spark):
    df = spark.range(1)
    assert jobs.with_rows(df, "prices") is df
    with pytest.raises(jobs.Refused, match="prices"):
        jobs.with_rows(df.where("false"), "prices")


def test_panel_keeps_the_universe_names_and_lists_what_it_drops(spark):
    universe = spark.createDataFrame([("BRK.B", "Fin"), ("aaa", "Tech"), ("GONE", "Tech")], "ticker string, sector string")
    panel = jobs.load_panel(universe, bars(spark, BRK_B=[1, 2], AAA=[3], OTHER=[4]))
    assert {(r["ticker"], r["close"]) for r in panel.close.collect()} == {("BRK.B", 1.0), ("BRK.B", 2.0), ("AAA", 3.0)}
    assert [r[0] for r in panel.dropped.collect()] == ["GONE"] and {tuple(r) for r in panel.sectors.collect()} == {("BRK.B", "Fin"), ("AAA", "Tech")}
    assert panel.rebalances.count() == 0  # too short a history


def test_any_failure_of_the_base_leaves_the_vendor(spark, tmp_path):
    vendor, wanted = bars(spark, A=[1, 2], B=[3]), spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    (tmp_path / "part.parquet").write_text("no parquet")

    def missing():
        return spark.read.parquet(str(tmp_path / "absent"))

    def broken():
        return spark.read.schema(BARS).parquet(str(tmp_path))

    def odd():
        return spark.range(3)

    for read in (missing, broken, odd):
        prices, source = jobs.base_first(read, vendor, wanted)
        assert prices.count() == 3 and {tuple(r) for r in source.collect()} == {("A", "fetch"), ("B", "fetch"), ("C", "missing")}
    prices, source = jobs.base_first(lambda: bars(spark, A=[9]), vendor, wanted)
    assert {tuple(r) for r in source.collect()} == {("A", "base"), ("B", "fetch"), ("C", "missing")} and {r["close"] for r in prices.collect()} == {9.0, 3.0}


def test_names_without_prices_stay_and_are_marked(spark):
    universe = spark.createDataFrame([(t, "one") for t in ("LONG", "SHORT", "ONE", "NONE")], "ticker string, sector string")
    history = bars(spark, LONG=[100 + i % 9 for i in range(400)], SHORT=[50 + i for i in range(80)], ONE=[7])
    got = {r["ticker"]: r for r in jobs.ranked_factors(universe, history, spark.createDataFrame([("LONG", 0.2)], "ticker string, roe double")).collect()}
    assert {t: r["data_quality"] for t, r in got.items()} == {"LONG": "ok", "SHORT": "partial_prices", "ONE": "missing_prices", "NONE": "missing_prices"}
    assert got["LONG"]["price_asof"] == "2021-02-03" and got["ONE"]["price_asof"] is got["NONE"]["price_asof"] is None
    assert got["NONE"]["ret_12_1"] is None and got["NONE"]["trend_score"] == 0.0 and got["LONG"]["roe"] == 0.2


def test_publishing_nothing(spark):
    assert jobs.published(None, F.current_date()) == {}


def test_backtest_without_membership_has_no_bias(spark):
    rows = [(dt.date(2020, m, 1), f"n{i}", "f", 21, float(i * m % 7), i / 100 - m / 50) for m in range(1, 7) for i in range(12)]
    panel = spark.createDataFrame(rows, "t date, ticker string, factor string, horizon int, score double, fwd double")
    out = jobs.backtested(panel, None, ["factor", "horizon"])
    assert "bias" not in out and out["ic_summary"].first()["n"] == 6 and out["quintiles"].columns[-1] == "turnover" and out["decay"].first()["n_21"] == 6
    flat = jobs.backtested(panel.withColumn("score", F.lit(1.0)), None, ["factor", "horizon"])
    assert {r["ic"] for r in flat["ic_series"].collect()} == {None}  # a constant side has no correlation


def test_digests_of_inputs(spark, tmp_path):
    import hashlib

    (tmp_path / "weights.yml").write_text("a: 1")
    got = {r["input"]: (r["bytes"], r["sha256"]) for r in jobs.input_digests(spark, [str(tmp_path / "weights.yml"), str(tmp_path / "absent")]).collect()}
    assert got == {str(tmp_path / "weights.yml"): (4, hashlib.sha256(b"a: 1").hexdigest()), str(tmp_path / "absent"): (None, None)}
