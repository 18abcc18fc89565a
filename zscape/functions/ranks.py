"""Cross-sectional transforms as window expressions; ``by`` names the columns of one cross-section."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .expr import norm_ppf

#: A sector with fewer names, or without spread, is measured against its whole cross-section.
LEAST_SECTOR, LEAST_SPREAD = 10, 1e-9


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1 of the values that are there; ties share their mean rank; NULL stays NULL."""
    own = Window.partitionBy(*by, F.col(value).isNull())
    ties = Window.partitionBy(*by, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(own.orderBy(value)) + (F.count("*").over(ties) - 1) / 2.0)


def gaussian_rank(value: str, by: list[str]) -> Column:
    """The normal quantile of (average rank - 0.5) / n."""
    return norm_ppf((average_rank(value, by) - 0.5) / F.count(value).over(Window.partitionBy(*by)))


def sector_neutral(z: str, sector: str, by: list[str]) -> Column:
    """z within its sector; against the cross-section for small or flat sectors; else only de-meaned.

    NULL sectors are one sector.
    """
    own, all_ = Window.partitionBy(*by, sector), Window.partitionBy(*by)
    c = F.col(z)
    n, mean, spread = F.count(c).over(own), F.avg(c).over(own), F.stddev_pop(c).over(own)
    mean_all, spread_all = F.avg(c).over(all_), F.stddev_pop(c).over(all_)
    return F.when((n >= LEAST_SECTOR) & (spread > LEAST_SPREAD), (c - mean) / spread).when(spread_all > LEAST_SPREAD, (c - mean_all) / spread_all).otherwise(c - mean)


def restandardized(value: str, by: list[str]) -> Column:
    """Filled with 0, then measured against the mean and spread of the values that were there.

    Without spread everything is neutral, 0.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    filled, mean, spread = F.coalesce(value, F.lit(0.0)), F.avg(value).over(w), F.stddev_pop(value).over(w)
    return F.when(spread > LEAST_SPREAD, (filled - mean) / spread).otherwise(F.lit(0.0))


def quantile_label(value: str, by: list[str], tie: str, q: int = 5) -> Column:
    """1 to ``q`` by linear quantile breaks of the order (ties by ``tie``); NULL below ``q`` names."""
    own = Window.partitionBy(*by, F.col(value).isNull())
    n = F.count(value).over(Window.partitionBy(*by))
    place = F.row_number().over(own.orderBy(value, tie))
    label = F.greatest(F.lit(1), F.ceil((place - 1) * q / (n - 1)).cast("int"))
    return F.when(F.col(value).isNotNull() & (n >= q), label)
