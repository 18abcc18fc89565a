"""What the sinks write, the readers give back."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.errors import AnalysisException

from zscape.operators import facts
from zscape.operators.scoring import WEIGHTS
from zscape.sources import readers, writers


def test_prices(spark, tmp_path):
    rows = [("BRK.B", dt.date(2024, 1, 2), 10.0), ("BRK.B", dt.date(2024, 1, 3), None), ("A", dt.date(2024, 1, 2), 1.5)]
    path = str(tmp_path / "prices")
    writers.write_prices(spark.createDataFrame([*rows, (None, dt.date(2024, 1, 2), 1.0)], "ticker string, date date, close double"), path)
    assert sorted(map(tuple, readers.read_prices(spark, path).collect()), key=str) == sorted(rows, key=str)


def test_fact_panel(spark, tmp_path):
    row = ("AAA", "0000000012", "revenues", "USD", dt.date(2021, 1, 1), dt.date(2021, 3, 31), dt.date(2021, 5, 1), "10-Q", 2021.0, "Q1", 100.0)
    kinds = "ticker string, cik string, concept string, unit string, period_start date, period_end date, filed date, form string, fy double, fp string, value double"
    path = tmp_path / "panel"
    writers.write_fact_panel(spark.createDataFrame([row], kinds), str(path))
    assert gzip.open(next(path.glob("*.csv.gz")), "rt").readline().strip() == ",".join(writers.PANEL_COLUMNS)
    assert tuple(readers.read_fact_panel(spark, str(path)).drop("seq").first()) == row


def test_membership_keeps_the_last_row(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ticker,added_date,source_note\nAAA,,\nBBB,2020-01-01,\nBBB,2022-06-15,\n")
    got = {r["ticker"]: r["added_date"] for r in readers.read_membership(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"AAA": None, "BBB": dt.date(2022, 6, 15)}
    assert readers.read_membership(spark, str(tmp_path / "none.csv")) is None


def test_weights(tmp_path):
    (tmp_path / "w.yml").write_text("composite:\n  trend: 1.0\n")
    assert readers.load_weights(tmp_path / "w.yml") == WEIGHTS == readers.load_weights(tmp_path / "none.yml")


def test_summary_and_objects(spark, tmp_path):
    one = spark.createDataFrame([(3, None)], "n int, top string")
    writers.write_summary(one, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0] == '{"n":3,"top":null}'
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "rank int, json string")
    writers.write_objects(rows, str(tmp_path / "o"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "o")).collect()) == ["a", "b"]


def weights_text(style):
    import json

    flat = json.loads(json.dumps(WEIGHTS))
    flat["composite"] = {"trend": 0.5, "quality": 0.3, "value": 0.2}
    if style == "json":
        return json.dumps(flat)
    if style == "flow":
        return "composite: {trend: 0.5, quality: 0.3, value: 0.2}  # shares\nsubfactors: " + json.dumps(flat["subfactors"])
    lines = ["composite:", *(f"  {k}: {v}" for k, v in flat["composite"].items()), "subfactors:"]
    for b, s in flat["subfactors"].items():
        lines += [f"    {b}:", *(f"      {n}: {w}" for n, w in s.items())]
    return "\n".join(lines)


@pytest.mark.parametrize("style", ["json", "flow", "block"])
def test_weights_in_every_style(tmp_path, style):
    if style != "json":
        pytest.importorskip("yaml")
    path = tmp_path / "weights"
    path.write_text(weights_text(style))
    got = readers.load_weights(path)
    assert got["composite"] == {"trend": 0.5, "quality": 0.3, "value": 0.2} and got["subfactors"] == WEIGHTS["subfactors"]


@pytest.mark.parametrize("text", ["composite: [", "- 1\n- 2", "composite: {trend: x, quality: 0.3, value: 0.2}", "", "12", '{"composite": {"trend": 1}}'])
def test_weights_that_are_not_as_they_should_be(tmp_path, text):
    pytest.importorskip("yaml")
    (tmp_path / "w").write_text(text)
    assert readers.load_weights(tmp_path / "w") is WEIGHTS


def test_weights_without_a_parser_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "yaml", None)
    (tmp_path / "w.yml").write_text(weights_text("block"))
    with pytest.raises(RuntimeError):
        readers.load_weights(tmp_path / "w.yml")
    (tmp_path / "w.json").write_text(weights_text("json"))
    assert readers.load_weights(tmp_path / "w.json")["composite"]["trend"] == 0.5


def test_later_files_and_rows_win_however_they_are_split(spark, tmp_path):
    many = "".join(f"T{i},2001-01-0{1 + i % 9}\n" for i in range(400))
    (tmp_path / "a.csv").write_text("ticker,added_date\nX,2000-01-01\n" + many + "X,2000-01-02\n")
    (tmp_path / "b.csv").write_text("ticker,added_date\nX,2000-01-03\n" + many + "X,2000-01-04\nY,2000-02-02\n")
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {r["ticker"]: str(r["added_date"]) for r in readers.read_membership(spark, str(tmp_path)).collect()}
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got["X"] == "2000-01-04" and got["Y"] == "2000-02-02" and len(got) == 402


def test_universe_files(spark, tmp_path):
    (tmp_path / "u.csv").write_text(" Symbol ,NAME,Sector,cik,enabled\n brk.b ,Berk, Fin ,12,1\nx,X,,34,\ny,Y,A,,0\nz,Z,A,56,maybe\n")
    got = {r["ticker"]: (r["cik"], r["sector"], r["enabled"]) for r in readers.read_universe(spark, str(tmp_path / "u.csv")).collect()}
    assert got["BRK.B"] == ("0000000012", "Fin", 1) and got["X"][2] == got["Z"][2] == 0
    assert [r["ticker"] for r in readers.read_universe(spark, str(tmp_path / "u.csv"), enabled_only=True).collect()] == ["BRK.B"]
    (tmp_path / "bad.csv").write_text("symbol,name\na,b\n")
    with pytest.raises(ValueError):
        readers.read_universe(spark, str(tmp_path / "bad.csv"))


def test_filing_documents(spark, tmp_path):
    record = '{"end":"2020-12-31","val":5,"accn":"a","fy":2020,"fp":"FY","form":"10-K","filed":"2021-02-01"}'
    (tmp_path / "CIK0000000012.json").write_text('{"facts":{"us-gaap":{"Assets":{"units":{"USD":[' + record + ']}},"Other":{"units":{"USD":[' + record + "]}}}}}")
    (tmp_path / "CIK0000000013.json").write_text("no json")
    (tmp_path / "notes.json").write_text("{}")
    docs = readers.read_filings(spark, str(tmp_path))
    assert tuple(readers.malformed(docs).first()) == (1, 2)
    assert [(r["cik"], r["tag"], r["value"]) for r in facts.records(docs, facts.WANTED).collect()] == [("12", "Assets", 5.0)] and facts.records(docs).count() == 2


def filing(**tags):
    """``namespace__tag=(unit, records)`` as a document."""
    out = {}
    for name, (unit, records) in tags.items():
        ns, tag = name.split("__")
        out.setdefault(ns.replace("_", "-"), {})[tag] = {"label": "x", "units": {unit: records}}
    return json.dumps({"cik": 1, "facts": out})


def record(val, end="2020-12-31", filed="2021-02-01", **more):
    return {"end": end, "val": val, "accn": "a", "fy": 2020, "fp": "FY", "form": "10-K", "filed": filed, **more}


def test_variant_documents_give_the_records_of_parsed_ones(spark, tmp_path):
    texts = {
        "12": filing(us_gaap__Assets=("USD", [record(5), record("7"), record("none"), record(1e7, filed=None)]), us_gaap__Other=("USD", [record(1)])),
        "13": "no json",
        "14": filing(us_gaap__Assets=("USD", "no list"), us_gaap__GrossProfit=("USD", [record(1.25, start="2020-01-01"), 3, None])),
        "15": '{"facts": 3}', "16": "[]", "17": "", "18": '{"facts": {"us-gaap": {"Assets": {"units": null}, "GrossProfit": 4}}}',
    }
    writers.write_filings(spark.createDataFrame([*texts.items()], "cik string, text string"), str(tmp_path))
    assert sorted(f.name for f in tmp_path.glob("*.json")) == [f"CIK00000000{c}.json" for c in sorted(texts)]
    assert (tmp_path / "CIK0000000012.json").read_text() == texts["12"]  # as it stands
    fields = ("cik", "namespace", "tag", "unit", "period_start", "period_end", "filed", "accn", "fy", "fp", "form", "value")
    kept = lambda df: sorted((tuple(map(str, (r[c] for c in fields))) for r in df.where("period_end IS NOT NULL").collect()))
    got = kept(facts.records_on_paths(readers.read_filings(spark, str(tmp_path), variant=True)))
    assert sorted((g[0], g[2], g[-1]) for g in got) == [*[("12", "Assets", v) for v in ("10000000.0", "5.0", "7.0", "None")], ("14", "GrossProfit", "1.25")]
    whole = kept(facts.records(readers.read_filings(spark, str(tmp_path)).where("cik = '12'"), facts.WANTED))
    assert [g for g in got if g[0] == "12"] == whole and len(whole) == 4


def test_counts_of_the_panel_are_observed_as_it_is_built(spark):
    legs = dict(us_gaap__LongTermDebtNoncurrent=("USD", [record(5)]), us_gaap__LongTermDebtCurrent=("USD", [record(2, filed="2021-03-01")]))
    shares = dict(dei__EntityCommonStockSharesOutstanding=("shares", [record(2e6), record(1, end="2019-12-31")]), us_gaap__CommonStockSharesOutstanding=("shares", [record(3), record(4, end="2019-12-31")]))
    docs = [("1", filing(us_gaap__Assets=("EUR", [record(1), record(2)]), **legs)), ("2", filing(us_gaap__Assets=("USD", [record(1)]), other__X=("EUR", [record(1)]), **shares)), ("3", "{"), ("4", filing(us_gaap__Assets=("EUR", [record(1)])))]
    universe = spark.createDataFrame([("A", "1"), ("B", "2"), ("B2", "2"), ("C", "3"), ("D", "5"), ("E", None)], "ticker string, cik string")
    panel, counts = facts.counted_panel(facts.variants(spark.createDataFrame(docs, "cik string, text string")), universe)
    assert {k: counts[k] for k in ("malformed", "seen", "foreign", "placeholders")} == {"malformed": 1, "seen": 3, "foreign": 2, "placeholders": 4}
    missing = {k.removeprefix("missing "): n for k, n in counts.items() if k.startswith("missing ")}
    assert len(missing) == len(facts.CHAINS) + 2 and missing["total_assets"] == 1 and missing["shares_outstanding"] == 1 and missing["total_debt"] == missing["revenues"] == 3
    assert sorted((r["ticker"], r["concept"], r["value"]) for r in panel.collect()) == [(t, c, v) for t in ("B", "B2") for c, v in (("shares_outstanding", 2e6), ("total_assets", 1.0))]
    nothing, counts = facts.counted_panel(facts.variants(spark.createDataFrame([], "cik string, text string")), universe)
    assert nothing.count() == 0 and set(counts.values()) == {0}



def test_observed_counts_are_plain_columns(spark, monkeypatch):
    plans, real = [], facts.written
    monkeypatch.setattr(facts, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    docs = spark.createDataFrame([("1", filing(us_gaap__Assets=("USD", [record(1)])))], "cik string, text string")
    facts.counted_panel(facts.variants(docs), spark.createDataFrame([("A", "1")], "ticker string, cik string"))
    observed = [line for plan in plans for line in plan.splitlines() if "CollectMetrics" in line]
    # every task sends these expressions to the driver
    assert len(observed) == 1 and "sum(_seen" in observed[0] and not any(x in observed[0] for x in ("CASE", "variant", "lambda"))



def test_a_document_is_parsed_once(spark, tmp_path):
    writers.write_filings(spark.createDataFrame([("1", filing(us_gaap__Assets=("USD", [record(1)])))], "cik string, text string"), str(tmp_path))
    rows = facts.records_on_paths(readers.read_filings(spark, str(tmp_path), variant=True))
    assert rows.count() == 1 and rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_rankings(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"ticker": "A", "rank": 1, "name": "x"},\n {"ticker": "B", "rank": 2}]')
    assert sorted(map(tuple, readers.read_ranking(spark, str(tmp_path / "r.json")).collect())) == [("A", 1), ("B", 2)]
    rows = spark.createDataFrame([("A", 1.5), ("B", None)], "ticker string, composite_score double")
    writers.write_ranks(rows, str(tmp_path / "ranks"))
    assert sorted(map(tuple, readers.read_ranks(spark, str(tmp_path / "ranks")).collect())) == [("A", 1.5), ("B", None)]
    writers.write_ranks(rows.where("false"), str(tmp_path / "none"))
    assert readers.read_ranks(spark, str(tmp_path / "none")) is None
    with pytest.raises(AnalysisException):
        readers.read_ranks(spark, str(tmp_path / "absent"))
