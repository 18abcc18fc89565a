"""Gates on what goes out: provenance, coverage, spot checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio, verdict

# Thresholds, the names that may be fetched, and the concepts that must be covered.
LEAST_BASE, LEAST_COVERED, ALLOWED = 0.90, 0.90, ("HON",)
REQUIRED, LEAST_REQUIRED, RECENT_YEAR, FIRST_YEAR, LAST_YEAR = ("revenues", "net_income", "stockholders_equity", "total_assets"), 0.90, 2024, 2009, 2026


def vendor_clash(universe: DataFrame) -> DataFrame:
    """``symbol, n`` of vendor symbols that more than one ticker maps to (must be empty)."""
    return universe.groupBy(F.replace("ticker", F.lit("."), F.lit("-")).alias("symbol")).agg(F.count("*").alias("n")).where("n > 1")


def provenance(source: DataFrame) -> DataFrame:
    """``total, base, fetch``: fetch is all that is not base, missing tickers too."""
    return source.agg(F.count("*").alias("total"), F.count_if(F.col("source") == "base").alias("base"), (F.count("*") - F.count_if(F.col("source") == "base")).alias("fetch"))


def base_sourced(source: DataFrame, expected: int, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``covered, base, unexpected, base_share, ok``: enough tickers, and enough of them from base."""
    fetched = F.col("source") != "base"
    out = source.agg(F.count("*").alias("covered"), F.count_if(~fetched).alias("base"), F.count_if(fetched & ~F.col("ticker").isin(*allowed)).alias("unexpected"))
    share = F.coalesce(ratio(F.col("base").cast("double"), F.col("covered").cast("double")), F.lit(0.0))
    return out.select("covered", "base", "unexpected", share.alias("base_share"), ((F.col("covered") > 0) & (F.col("covered") >= LEAST_COVERED * expected) & (share >= LEAST_BASE)).alias("ok"))


def coverage(facts: DataFrame, concepts: tuple[str, ...], universe_size: int, year: int = RECENT_YEAR) -> DataFrame:
    """``concept, tickers, share, required, ok``: every concept, also those without facts."""
    spark = facts.sparkSession
    every = spark.createDataFrame([(c,) for c in concepts], "concept string")
    seen = facts.where(F.year("period_end") >= year).groupBy("concept").agg(F.count_distinct("ticker").alias("tickers"))
    n = F.coalesce("tickers", F.lit(0))
    share = n / F.lit(float(universe_size))
    need = F.col("concept").isin(*REQUIRED)
    return F.broadcast(every).join(seen, "concept", "left").select("concept", n.alias("tickers"), share.alias("share"), need.alias("required"), (~need | (share >= LEAST_REQUIRED)).alias("ok"))


def coverage_by_year(facts: DataFrame, concept: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """``year, tickers`` for every year, 0 where there is none."""
    years = facts.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    seen = facts.where(F.col("concept") == concept).groupBy(F.year("period_end").alias("year")).agg(F.count_distinct("ticker").alias("tickers"))
    return years.join(seen, "year", "left").select("year", F.coalesce("tickers", F.lit(0)).alias("tickers"))


def spot_check(ours: DataFrame, theirs: DataFrame, tickers: tuple[str, ...]) -> DataFrame:
    """``ticker, ours, theirs, ratio, verdict`` for a few names."""
    a = ours.where(F.col("ticker").isin(*tickers)).select("ticker", F.col("value").alias("ours"))
    b = theirs.select("ticker", F.col("value").alias("theirs"))
    r = ratio(F.col("ours"), F.col("theirs"))
    return a.join(b, "ticker", "left").select("ticker", "ours", "theirs", r.alias("ratio"), verdict(r).alias("verdict"))


def missing_concepts(facts: DataFrame, most: int) -> DataFrame:
    """``concept, missing``: how many of all tickers have no fact of it, the ``most`` that are lacked by most."""
    tickers = facts.agg(F.count_distinct("ticker").alias("all"))
    own = facts.groupBy("concept").agg(F.count_distinct("ticker").alias("n")).crossJoin(F.broadcast(tickers))  # one row
    return own.select("concept", (F.col("all") - F.col("n")).alias("missing")).where("missing > 0").orderBy(F.desc("missing"), "concept").limit(most)
