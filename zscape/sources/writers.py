"""File sinks: prices, rankings, the fact panel, result tables, published JSON.

Everything large is written by Spark in as many files as it has partitions; only what is one small
document by nature (a summary of one row) is gathered in a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cik_bare, cik_padded
from .named import write_named

# The columns of the fact panel, in the order of the file.
PANEL_COLUMNS = ("ticker", "cik", "concept", "unit", "period_start", "period_end", "filed", "form", "fy", "fp", "value")


def write_prices(prices: DataFrame, path: str) -> None:
    """``Date,Close`` files in ``ticker=<name>`` folders; dots in names stay."""
    rows = prices.where("ticker IS NOT NULL AND date IS NOT NULL").select("ticker", F.col("date").alias("Date"), F.col("close").alias("Close"))
    rows.repartition("ticker").sortWithinPartitions("ticker", "Date").write.partitionBy("ticker").option("header", True).mode("overwrite").csv(path)


def write_price_files(prices: DataFrame, path: str) -> None:
    """``Date,Close`` in ``<ticker>.csv`` files, dots in names kept; bars without a close are left out."""
    rows = prices.where("ticker IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL")
    rows = rows.select(F.concat("ticker", F.lit(".csv")).alias("file"), F.col("date").alias("Date"), F.col("close").alias("Close"))
    write_named(rows, path, ["Date", "Close"])


def write_fact_file(panel: DataFrame, path: str, name: str = "edgar_pit_panel.csv.gz") -> None:
    """The whole panel as one gzipped CSV file ``path/name``: one task's stream, whatever its size (``write_fact_panel`` shards)."""
    rows = panel.withColumn("cik", cik_bare(F.col("cik"))).select(F.lit(name).alias("file"), *PANEL_COLUMNS)
    write_named(rows, path, ["ticker", "concept", "period_end", "filed", "period_start", "value"])


def write_filings(docs: DataFrame, path: str) -> None:
    """Each ``cik, text`` as ``CIK<ten digits>.json``; a name may come once."""
    rows = docs.where("cik IS NOT NULL").select(F.concat(F.lit("CIK"), cik_padded(F.col("cik")), F.lit(".json")).alias("file"), "text")
    write_named(rows, path, [], form="text")


def write_ranks(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).mode("overwrite").csv(path)


def write_fact_panel(panel: DataFrame, path: str) -> None:
    """Gzipped CSV files of the panel's columns, in their order."""
    out = panel.withColumn("cik", cik_padded(F.col("cik"))).select(*PANEL_COLUMNS)
    out.write.option("header", True).option("compression", "gzip").mode("overwrite").csv(path)


def write_results(tables: dict[str, DataFrame], path: str, order: dict[str, list] | None = None) -> None:
    """A folder with a CSV file for each named result (small tables: a row for a factor, date or regime), sorted as told."""
    for name, df in tables.items():
        one = df.repartition(1)  # a shuffle, so that the work before it keeps its tasks
        one = one.sortWithinPartitions(*order[name]) if order and name in order else one
        one.write.option("header", True).mode("overwrite").csv(f"{path}/{name}")


def write_objects(objects: DataFrame, path: str) -> None:
    """``json`` texts, one to a line, in the order of ``rank``."""
    objects.orderBy("rank").select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A table of one row as a JSON object; NULL is written as null."""
    summary.limit(1).coalesce(1).write.option("ignoreNullFields", False).mode("overwrite").json(path)


def write_price_source(source: DataFrame, path: str) -> None:
    """``ticker, source`` as lines of JSON, sorted by ticker."""
    source.select("ticker", "source").orderBy("ticker").write.mode("overwrite").json(path)


def write_coverage(by_concept: DataFrame, by_year: DataFrame, path: str) -> None:
    """The coverage report: a section for each table, both small, as CSV folders below ``path``."""
    write_results({"by_concept": by_concept, "by_year": by_year}, path, {"by_concept": [F.desc("tickers"), "concept"], "by_year": ["year"]})
