"""Files under the names that other readers expect, and nothing of a job that fails."""

import datetime as dt
import gzip

import pandas as pd
import pytest
from pyspark.sql import functions as F

from zscape.sources import readers, writers
from zscape.sources.named import write_named

BARS = "ticker string, date date, close double"


def names(path):
    return sorted(p.name for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_a_file_for_each_name(spark, tmp_path):
    days = [dt.date(2024, 1, d) for d in range(1, 29)]
    rows = [(t, d, i + d.day / 3) for i, t in enumerate(["BRK.B", "A", "Ä B"]) for d in reversed(days)]
    bars = spark.createDataFrame([*rows, ("A", dt.date(2024, 2, 1), None), (None, days[0], 1.0)], BARS).repartition(7)
    writers.write_price_files(bars, str(tmp_path))
    assert names(tmp_path) == ["A.csv", "BRK.B.csv", "Ä B.csv"]
    got = pd.read_csv(tmp_path / "BRK.B.csv", parse_dates=["Date"], float_precision="round_trip")
    assert list(got.columns) == ["Date", "Close"] and got.Date.is_monotonic_increasing
    assert got.Close.tolist() == [d.day / 3 for d in days]  # in full
    assert sorted(map(tuple, readers.read_price_files(spark, str(tmp_path)).collect())) == sorted(rows)
    writers.write_price_files(bars.where("ticker = 'A'"), str(tmp_path))
    assert names(tmp_path) == ["A.csv"]
    writers.write_price_files(bars.where("false"), str(tmp_path))
    assert names(tmp_path) == []


def test_files_larger_than_a_batch_and_quoting(spark, tmp_path):
    rows = spark.range(0, 25_000, 1, 5).select(F.concat(F.lit("f"), (F.col("id") % 2).cast("string"), F.lit(".csv")).alias("file"), "id", F.when(F.col("id") % 3 == 0, F.lit('a,"b"\nc')).alias("text"))
    write_named(rows, str(tmp_path), ["id"])
    for n in (0, 1):
        got = pd.read_csv(tmp_path / f"f{n}.csv")
        assert got.id.tolist() == list(range(n, 25_000, 2))
        assert got.text.dropna().unique().tolist() == ['a,"b"\nc'] and (got.text.notna() == (got.id % 3 == 0)).all()


def test_one_gzipped_panel(spark, tmp_path):
    kinds = "ticker string, cik string, concept string, unit string, period_start date, period_end date, filed date, form string, fy double, fp string, value double"
    row = lambda t, v: (t, "0000000012", "revenues", "USD", None, dt.date(2021, 3, 31), dt.date(2021, 5, 1), "10-Q", 2021.0, "Q1", v)
    writers.write_fact_file(spark.createDataFrame([row("B", 1e12), row("A", 0.1)], kinds).repartition(3), str(tmp_path))
    assert names(tmp_path) == ["edgar_pit_panel.csv.gz"]
    assert gzip.open(tmp_path / "edgar_pit_panel.csv.gz", "rt").readline().strip() == ",".join(writers.PANEL_COLUMNS)
    got = readers.read_fact_panel(spark, str(tmp_path)).orderBy("ticker").drop("seq")
    assert [(r.ticker, r.cik, r.value) for r in got.collect()] == [("A", "12", 0.1), ("B", "12", 1e12)]


def test_an_aborted_job_shows_nothing_and_keeps_what_was(spark, tmp_path):
    (tmp_path / "old.csv").write_text("Date,Close\n")
    rows = spark.range(2000).select(F.concat(F.lit("f"), (F.col("id") % 20).cast("string"), F.lit(".csv")).alias("file"), "id")
    failing = rows.withColumn("id", F.when((F.col("file") == "f7.csv") & (F.col("id") > 1000), F.raise_error(F.lit("no more")).cast("long")).otherwise(F.col("id")))
    failing = rows.unionByName(failing.where("file = 'f7.csv'"))
    with pytest.raises(Exception, match="no more"):
        write_named(failing, str(tmp_path), ["id"])
    assert names(tmp_path) == ["old.csv"]
    bad = spark.createDataFrame([("a.csv", 1), ("../b.csv", 2)], "file string, id int")
    with pytest.raises(Exception, match="no file's name"):
        write_named(bad, str(tmp_path), ["id"])
    with pytest.raises(Exception, match="several tasks"):
        rows.where("file = 'f1.csv'").repartition(4).write.format("named_files").mode("overwrite").option("path", f"file://{tmp_path}").save()
    assert names(tmp_path) == ["old.csv"] and [p.name for p in tmp_path.iterdir()] == ["old.csv"]
    write_named(rows, str(tmp_path), ["id"], mode="append")
    assert len(names(tmp_path)) == 21
