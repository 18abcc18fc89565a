"""Index membership: matching changes to the universe, and who was eligible when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import company_name, ticker_class


def eligible(rows: DataFrame, members: DataFrame | None) -> DataFrame:
    """``rows(t, ticker, ...)`` of names that were members at ``t``; without membership, all rows.

    A NULL added date means always; unknown tickers are not members.
    """
    if members is None:
        return rows
    m = members.select(F.col("ticker").alias("_m"), "added_date")
    return rows.join(m, (F.col("ticker") == F.col("_m")) & (F.col("added_date").isNull() | (F.col("added_date") <= F.col("t"))), "left_semi")


def excluded(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``t, excluded``: how many names of each date were not members."""
    kept = eligible(rows, members).groupBy("t").agg(F.count("*").alias("kept"))
    return rows.groupBy("t").agg(F.count("*").alias("n")).join(kept, "t", "left").select("t", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("excluded"))


def latest_events(changes: DataFrame) -> DataFrame:
    """``changes``, of each ticker the row of the latest date; of several the first in the order of ``seq``."""
    own = Window.partitionBy("ticker").orderBy(F.desc("date"), "seq")
    return changes.withColumn("_rn", F.row_number().over(own)).where("_rn = 1").drop("_rn")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def matched(universe: DataFrame, changes: DataFrame) -> DataFrame:
    """``ticker, added_date, how``: the latest addition by ticker; only without one, by company name.

    ``changes`` has ``ticker, name, date, seq``; of equal dates the first row counts.
    """
    u = universe.select("ticker", ticker_class(F.col("ticker")).alias("tc"), company_name(F.col("name")).alias("cn"))
    c = changes.where("date IS NOT NULL").select(ticker_class(F.col("ticker")).alias("tc"), company_name(F.col("name")).alias("cn"), "date", "seq")
    newest = lambda key: c.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max("date").alias(f"d_{key}"))
    out = u.join(newest("tc"), "tc", "left").join(newest("cn"), "cn", "left")
    how = F.when(F.col("d_tc").isNotNull(), "ticker").when(F.col("d_cn").isNotNull(), "name").otherwise("none")
    return out.select("ticker", F.coalesce("d_tc", "d_cn").alias("added_date"), how.alias("how"))


def overridden(rows: DataFrame, manual: DataFrame) -> DataFrame:
    """``rows(ticker, added_date)`` with the manual dates where there are some."""
    m = manual.select("ticker", F.col("added_date").alias("_d"))
    return rows.join(m, "ticker", "left").withColumn("added_date", F.coalesce("_d", "added_date")).drop("_d")
