"""One pass over filings against the answers for single dates, and rolling betas against single ones."""

import datetime as dt
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zscape.operators import pit, prices, replay
from zscape.plans import catalog

DAY = dt.date(2020, 1, 1)
SCHEMA = "ticker string, concept string, period_start date, period_end date, filed date, fy double, value double, seq long"


def messy(seed=4, n=900):
    """Quarters, year-to-date values and levels: restated, out of order, under wrong years, with holes."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        concept = rng.choice(["revenues", "capex", "total_assets", "goodwill"])
        year, q = rng.choice([2020, 2021]), rng.randint(1, 4)
        end = dt.date(year, 3 * q, 28)
        start = dt.date(year, 1, 1) if rng.random() < 0.5 else dt.date(year, 3 * q - 2, 1)
        start = None if concept == "total_assets" else rng.choice([start, start, start, end - dt.timedelta(days=rng.randint(1, 400))])
        filed = end + dt.timedelta(days=rng.choice([20, 20, 40, 200, 400]))
        fy = rng.choice([year, year, year, year, year + 1, None])
        rows.append((rng.choice("AB"), concept, start, end if rng.random() > 0.03 else None, filed if rng.random() > 0.02 else None, fy and float(fy), rng.choice([None, *map(float, range(1, 40))])))
    rng.shuffle(rows)
    return [(*r, i) for i, r in enumerate(rows)]


def test_all_dates_at_once_equal_single_dates(spark):
    facts = spark.createDataFrame(messy(), SCHEMA)
    days = [DAY + dt.timedelta(days=k) for k in (10, 120, 241, 333, 480, 611, 700, 1200)]
    dates = spark.createDataFrame([(d,) for d in days], "t date")
    got = {(r["t"], r["ticker"]): r.asDict() for r in replay.as_known_on(facts, dates).collect()}
    want = {}
    for d in days:
        for r in pit.as_known_at(facts, F.lit(d)).collect():
            want[d, r["ticker"]] = r.asDict()
    assert got.keys() == want.keys() and len(got) > 8
    for k, row in want.items():
        for c, v in row.items():
            assert got[k][c] == (pytest.approx(v) if isinstance(v, float) else v), (k, c)
    assert any(r["revenues_ttm"] is not None for r in want.values()) and any(r["capex_ttm"] is None for r in want.values())



def test_facts_and_dates_are_computed_once(spark):
    seen = {n: spark.sparkContext.accumulator(0) for n in ("facts", "dates")}

    def counted(df, name):
        def passed(batches):
            for b in batches:
                seen[name].add(b.num_rows)
                yield b

        return df.mapInArrow(passed, df.schema)

    facts = counted(spark.createDataFrame(messy(n=200), SCHEMA), "facts")
    dates = counted(spark.createDataFrame([(DAY + dt.timedelta(days=k),) for k in (300, 700)], "t date"), "dates")
    assert len(replay.as_known_on(facts, dates).collect()) == 4
    assert {n: c.value for n, c in seen.items()} == {"facts": 200, "dates": 2}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver tables are not here")
def test_the_query_begins_at_written_tables(spark):
    plan = catalog.queries()["nj8_as_known_on_dates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "MapInArrow" not in plan


def test_small_series_are_not_joined_in_one_task(spark):
    assert replay._replayed(spark.createDataFrame(messy(), SCHEMA)).rdd.getNumPartitions() == 4


def test_columns_as_lists():
    days = pa.array([DAY, None, DAY]).cast(pa.int32()).to_pylist()
    assert replay._values(pa.array([DAY, None, DAY])) == days and replay._values(pa.array([], pa.date32())) == []
    for column in (pa.array(["a", None, "", "a"]), pa.array(["a", None], pa.large_string()), pa.array([1 << 60, None, 0, -3]), pa.array([None, -0.0, 2.5]), pa.array([None, None], pa.int32()), pa.array([], pa.string())):
        assert repr(replay._values(column)) == repr(column.to_pylist())


def test_intervals_meet_and_values_change(spark):
    rows = replay.intervals(spark.createDataFrame(messy(9), SCHEMA)).orderBy("ticker", "concept", "valid_from").collect()
    for a, b in zip(rows, rows[1:]):
        if (a["ticker"], a["concept"]) == (b["ticker"], b["concept"]):
            assert a["valid_to"] == b["valid_from"] and a["value"] != b["value"]
        else:
            assert a["valid_to"] is None
    assert replay.intervals(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rolling_betas_equal_single_ones(spark):
    rng = random.Random(3)
    bars = [(t, DAY + dt.timedelta(days=k), 50 + 20 * rng.random()) for t in ("M", "X", "Y") for k in range(700) if rng.random() < (0.7 if t != "Y" else 0.05)]
    p = spark.createDataFrame([*bars, ("Z", DAY, 3.0)], "ticker string, date date, close double")
    days = [DAY + dt.timedelta(days=k) for k in (30, 260, 401, 405, 408, 690)]
    market = prices.market(p, "M")
    got = {(r["t"], r["ticker"]): r for r in prices.betas(p, market, spark.createDataFrame([(d,) for d in days], "t date")).collect()}
    for d in days:
        want = {r["ticker"]: r for r in prices.beta(p, market, F.lit(d)).collect()}
        for t in ("M", "X", "Y", "Z"):
            assert got[d, t]["n"] == (want[t]["n"] if t in want else 0), (d, t)
            assert got[d, t]["beta_52w"] == (pytest.approx(want[t]["beta"]) if t in want and want[t]["beta"] is not None else None)
