"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) weigh 5, 2, 1, repeating. They share ``BUDGET`` times all
words; a source stops at ``MOST`` times its own words, and what it leaves is shared again by weight
until none is above. A source's target over its words is each of its documents' expected copies.
Documents stand in the order of their size, then of a hash of their id; the expected copies are summed along that
order, a random offset of the source (a hash of its name) is added, and a document is emitted once for
each integer boundary that its part of the sum crosses. As sizes ascend, the words taken stay near the
target; as the rate is at most 2, no document is taken more than twice.

The running sum is taken over range partitions: counts of each partition give the offset at which
it begins, so that a hot source is spread over many tasks. Everything random is a hash of the seed:
reruns agree.

Null texts have size 0 (and are never worth a word), a null source is a source, rows with equal ids
(or none) are ordered by size, then by a hash of their text and columns, so only equal rows are
interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, placed, written

WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2
SEED = "mix"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(rows: DataFrame) -> DataFrame:
    """``source, source_size, target`` of a table with ``source`` and ``size``."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = placed(sources, [F.col("source").asc_nulls_last()], "sources")
    # one row for each partition: the number of rows before it
    before = numbered.groupBy("pid").agg(F.count("*").alias("n")).select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))
    turn = (F.col("before") + F.col("pos")) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int"))
    weighed = written(numbered.join(before, "pid").select("source", "source_size", weight.alias("weight")), "weights")
    full, level, capped = F.col("source_size") * MOST, None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > full
        total, taken, weights, n = weighed.agg(F.sum("source_size"), F.sum(F.when(above, full)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == capped or not weights:
            break
        capped, level = n, (BUDGET * total - (taken or 0)) / weights
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level or 0)), full.cast("double")).alias("target"))


def mix(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every document, with ``size, source_size, target, copies, taken``."""
    rows = docs.select(F.struct(*columns).alias("row"), "source", size(F.col("text")).alias("size"), F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("o"), F.xxhash64("text", *columns).alias("tie"), F.monotonically_increasing_id().alias("last"))
    # the last key parts rows that are equal in every way, so that no range holds all of them
    numbered = placed(rows, [F.col("source").asc_nulls_last(), *map(F.col, ("size", "o", "tie", "last"))], "placed").drop("o", "tie", "last")
    goals = targets(numbered.select("source", "size"))
    parts = numbered.groupBy("pid", "source").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    # a row for each range partition that a source touches
    before = F.sum("n").over(Window.partitionBy("source").orderBy("pid")) - F.col("n") - F.col("first")
    parts = parts.select("pid", F.col("source").alias("_source"), before.alias("shift"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("double") / (1 << 20)
    parts = parts.join(goals, parts["_source"].eqNullSafe(goals["source"])).select(F.col("pid").alias("_pid"), "_source", "shift", "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    i = F.col("pos") + F.col("shift") + 1
    copies = F.least(F.floor(i * F.col("rate") + F.col("offset")) - F.floor((i - 1) * F.col("rate") + F.col("offset")), F.lit(MOST).cast("long"))
    parts = written(parts, "parts")
    joined = numbered.join(broadcast_if_small(parts, parts.count(), 128), (numbered["pid"] == parts["_pid"]) & numbered["source"].eqNullSafe(parts["_source"]))
    out = joined.select("row", "size", "source_size", "target", copies.alias("copies"))
    return out.select(*(F.col("row")[c].alias(c) for c in columns), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emitted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each document once for every copy that the mix takes, and ``copy`` from 1."""
    mixed = mix(docs, columns).where("copies > 0")
    return mixed.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat('mix', doc_id)) AS o FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
     w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
     f AS (SELECT *, row_number() OVER c AS k, sum(2 * source_size) OVER c - 2 * source_size AS filled, sum(weight) OVER () - sum(weight) OVER c + weight AS open,
                  1.5::DOUBLE * sum(source_size) OVER () AS budget
           FROM w WINDOW c AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
     l AS (SELECT coalesce(arg_min((budget - filled) / open, k) FILTER (weight * ((budget - filled) / open) <= 2 * source_size), 0) AS level FROM f),
     t AS (SELECT source, source_size, least(weight * level, 2 * source_size)::DOUBLE AS target,
                  ('0x' || md5(concat('mix', source))[1:5])::BIGINT / 1048576 AS u FROM w, l),
     r AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                  row_number() OVER (PARTITION BY d.source ORDER BY size, o) AS i
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, least(floor(i * rate + u) - floor((i - 1) * rate + u), 2)::BIGINT * size AS taken FROM r
"""
