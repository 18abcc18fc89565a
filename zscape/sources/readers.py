"""File sources: universe, prices, fact panel, filing documents, membership, rankings, weights.

Readers give DataFrames and never touch files in the driver, apart from the small weights file.
"""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import cik_padded, number
from ..operators.facts import parsed, variants
from ..operators.membership import keep_last
from ..operators.scoring import WEIGHTS

try:
    import yaml
except ModuleNotFoundError:  # the weights file may then be JSON only
    yaml = None

log = logging.getLogger(__name__)

FACT_COLUMNS = "ticker string, cik string, concept string, unit string, period_start string, period_end string, filed string, form string, fy string, fp string, value string"


def _in_order() -> Column:
    """Orders the rows of a file source by file, block and place, however the blocks are packed into tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _renamed(df: DataFrame) -> DataFrame:
    out = df.withColumnsRenamed({c: c.strip().lower() for c in df.columns})
    return out.withColumnRenamed("symbol", "ticker") if "symbol" in out.columns else out


def normalised_universe(raw: DataFrame, enabled_only: bool = False) -> DataFrame:
    """``ticker, cik, sector, name, enabled`` of an all-text table; required columns must be there."""
    df = _renamed(raw)
    if missing := {"ticker", "cik", "sector", "name", "enabled"} - set(df.columns):
        raise ValueError(f"universe: missing columns {sorted(missing)}")
    out = df.select(F.upper(F.trim("ticker")).alias("ticker"), cik_padded(F.col("cik")).alias("cik"), F.trim("sector").alias("sector"), F.trim("name").alias("name"), F.coalesce(F.col("enabled").try_cast("int"), F.lit(0)).alias("enabled"))
    return out.where("enabled = 1") if enabled_only else out


def read_universe(spark: SparkSession, path: str, enabled_only: bool = False) -> DataFrame:
    return normalised_universe(spark.read.option("header", True).csv(path), enabled_only)


def research_universe(raw: DataFrame) -> DataFrame:
    """``ticker, cik`` of names with a CIK; without an ``enabled`` column all count as enabled."""
    df = _renamed(raw)
    enabled = F.coalesce(F.trim("enabled"), F.lit("1")) if "enabled" in df.columns else F.lit("1")
    return df.where(enabled.isin("1", "") & (F.trim(F.coalesce("cik", F.lit(""))) != "")).select(F.upper(F.trim("ticker")).alias("ticker"), cik_padded(F.col("cik")).alias("cik"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, date, close`` of ``ticker=<name>`` folders of ``Date,Close`` files; bad rows leave."""
    raw = spark.read.option("header", True).schema("Date string, Close string, ticker string").csv(path)
    return raw.select("ticker", F.col("Date").try_cast("date").alias("date"), number(F.col("Close")).alias("close")).where("date IS NOT NULL")


def read_price_files(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, date, close`` of ``<ticker>.csv`` files of ``Date,Close``; bad rows leave."""
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").schema("Date string, Close string").csv(path)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # Spark gives it URL-encoded
    ticker = F.regexp_extract(name, r"^(.*)\.csv$", 1)
    return raw.select(ticker.alias("ticker"), F.col("Date").try_cast("date").alias("date"), number(F.col("Close")).alias("close")).where("date IS NOT NULL")


def read_fact_panel(spark: SparkSession, path: str) -> DataFrame:
    """The fact panel of (gzipped) CSV files, typed; ``seq`` orders rows by file name and place in the file."""
    raw = spark.read.option("header", True).schema(FACT_COLUMNS).csv(path).withColumn("seq", _in_order())
    dates = {c: F.col(c).try_cast("date") for c in ("period_start", "period_end", "filed")}
    return raw.withColumns({**dates, "fy": number(F.col("fy")), "value": number(F.col("value"))})


def read_filings(spark: SparkSession, path: str, variant: bool = False) -> DataFrame:
    """``cik, text, doc`` of a folder of ``CIK<digits>.json`` files; ``doc`` is NULL for malformed ones.

    As a VARIANT ``doc`` is for ``facts.records_on_paths`` and ``facts.counted_panel``, which read what they name alone.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="CIK*.json")
    digits = F.regexp_extract(F.col("_metadata.file_name"), r"CIK0*([0-9]+)", 1)
    return (variants if variant else parsed)(raw.select(digits.alias("cik"), F.col("value").alias("text")))


def malformed(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.col("doc.facts").isNull()).alias("malformed"), F.count("*").alias("files"))


def read_membership(spark: SparkSession, path: str) -> DataFrame | None:
    """``ticker, added_date``, the last row of a ticker; None (no filter) if it can't be read as such."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return None
    if not {"ticker", "added_date"} <= set(raw.columns):
        return None
    rows = raw.select("ticker", F.col("added_date").try_cast("date").alias("added_date"), _in_order().alias("_seq"))
    return keep_last(rows.where("ticker IS NOT NULL"), ["ticker"], "_seq").drop("_seq")


def read_ranks(spark: SparkSession, path: str) -> DataFrame | None:
    """The ranks table as it was published, typed by its values; None if it has no rows.

    A path that isn't there is an error, as nothing should be published then.
    """
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if rows.isEmpty():
        log.warning("%s has no rows", path)
        return None
    return rows


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, rank`` of a published ranking (a JSON array of objects)."""
    return spark.read.option("multiLine", True).schema("ticker string, rank int").json(path)


def valid_weights(data: object) -> bool:
    """Whether ``data`` has exactly the buckets and factors of the defaults, with numbers."""
    try:
        shape = {"composite": data["composite"], **data["subfactors"]}
        want = {"composite": WEIGHTS["composite"], **WEIGHTS["subfactors"]}
        return set(shape) == set(want) and all(set(shape[k]) == set(want[k]) and [float(v) for v in shape[k].values()] is not None for k in want)
    except (AttributeError, KeyError, TypeError, ValueError):
        return False


def load_weights(path: str | Path) -> dict:
    """Weights of a YAML or JSON file; the defaults if it is missing or not as it should be.

    A file that is no JSON is an error where no YAML parser is installed: it can't be told whether it
    is as it should be.
    """
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError:
        return WEIGHTS
    data = _parsed(text, path)
    if valid_weights(data):
        return data
    log.warning("weights in %s are malformed; defaults are used", path)
    return WEIGHTS


def _parsed(text: str, path: str | Path) -> object:
    try:
        return json.loads(text)
    except ValueError:
        if yaml is None:
            raise RuntimeError(f"{path} is no JSON, and no YAML parser is installed") from None
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None
