"""Ranks and sector-neutral scores of cross-sections of any size.

The window forms in ``functions.ranks`` sort a cross-section in one task. Here equal values are one row
with their number before anything is sorted, the distinct values are numbered over range partitions, and
only each partition's counts meet; means and spreads are grouped sums that are joined back. So ties
share a rank wherever a partition ends, and no task sees a whole cross-section.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import norm_ppf
from ..functions.ranks import LEAST_SECTOR, LEAST_SPREAD
from ..shared import BROADCAST_BYTES, checked, placed, written

#: A value with more rows isn't dealt out by its key; the bytes that a value and its rank take.
HOT, VALUE_BYTES = 100_000, 128


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys])


def beside(rows: DataFrame, facts: DataFrame, keys: list[str], small: bool = False, hint: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each ``keys`` (NULL is a key); broadcast if ``small``, or joined as ``hint`` says."""
    if not keys:
        return rows.crossJoin(F.broadcast(facts))  # one row
    named = facts.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    named = checked(named, 128) if small else named.hint(hint) if hint else named
    return rows.join(named, _same(rows, named, keys)).drop(*(f"_k_{k}" for k in keys))


def value_ranks(rows: DataFrame, value: str, own: list[str]) -> DataFrame:
    """``<own>, <value>, times, rank, n``: each value that is there, its number of rows and mean rank, and how many there are in all."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*own, value).agg(F.count("*").alias("_times"))
    parts = placed(counted, [*map(F.col, own), F.col(value)], "ranks")
    here = Window.partitionBy("pid", *own).orderBy("pos")  # one range partition's rows
    parts = parts.withColumn("_seen", F.sum("_times").over(here))
    sums = parts.groupBy(*own, "pid").agg(F.sum("_times").alias("_in"))
    every = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))  # a row for each range partition
    sums = sums.select(*own, "pid", (F.sum("_in").over(every.orderBy("pid")) - F.col("_in")).alias("_before"), F.sum("_in").over(every).alias("n"))
    return beside(parts, sums, [*own, "pid"], small=True).select(*own, value, F.col("_times").alias("times"), (F.col("_before") + F.col("_seen") - (F.col("_times") - 1) / 2.0).alias("rank"), "n")


def beside_values(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row for each ``keys`` and its number of rows, ``times``.

    Few values are broadcast, and no row moves. Of many only those with more than ``HOT`` rows are; the other
    rows are dealt out by their keys, none of which is large.
    """
    most = BROADCAST_BYTES // VALUE_BYTES
    if values.limit(most + 1).count() <= most:
        return beside(rows, values.drop("times"), keys, hint="broadcast")
    hot = F.col("times") > HOT
    often = values.where(hot).drop("times").withColumnsRenamed({k: f"_k_{k}" for k in keys})
    seldom = rows.join(F.broadcast(often), _same(rows, often, keys), "left_anti")
    return beside(rows, values.where(hot).drop("times"), keys, hint="broadcast").unionByName(beside(seldom, values.where(~hot).drop("times"), keys, hint="merge"))


def neutral_scores(rows: DataFrame, value: str, sector: str, own: list[str]) -> DataFrame:
    """``rows`` whose ``value`` is there, with ``z``: its Gaussian rank, measured within its sector.

    As ``ranks.sector_neutral`` of ``ranks.gaussian_rank``.
    """
    ranked = value_ranks(rows, value, own).withColumn("_g", norm_ppf((F.col("rank") - 0.5) / F.col("n"))).drop("rank", "n")
    scored = beside_values(rows.where(F.col(value).isNotNull()), ranked, [*own, value])
    moments = lambda tag: [f("_g").alias(f"_{n}{tag}") for n, f in (("c", F.count), ("m", F.avg), ("d", F.stddev_pop))]
    in_sectors = written(scored.groupBy(*own, sector).agg(*moments("s")), "sectors")  # written: counted and joined, worked out once
    in_all = written(scored.groupBy(*own).agg(*moments("a")), "sections")
    scored = beside(beside(scored, in_sectors, [*own, sector], small=True), in_all, own, small=True)
    g = F.col("_g")
    z = F.when((F.col("_cs") >= LEAST_SECTOR) & (F.col("_ds") > LEAST_SPREAD), (g - F.col("_ms")) / F.col("_ds")).when(F.col("_da") > LEAST_SPREAD, (g - F.col("_ma")) / F.col("_da")).otherwise(g - F.col("_ms"))
    return scored.withColumn("z", z).drop("_g", *(f"_{n}{tag}" for n in "cmd" for tag in "sa"))
