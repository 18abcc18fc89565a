"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, discard, placed, scratch, stored, written

__all__ = ["broadcast_if_small", "discard", "evenly_joined", "held_out", "pieces", "placed", "scratch", "share_of_hash", "stored", "table", "written"]

#: Most keys that ``evenly_joined`` deals out, so its broadcast list of them stays below 2 MB.
HOT_KEYS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices that stay small as Python objects (Spark bounds a batch's bytes itself)."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def evenly_joined(many: DataFrame, one: DataFrame, key: str, sizes: DataFrame, spread: Column, together: int = 100_000, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``many`` joined to ``one`` (a row for each key at most) so that no task gets all rows of a hot key.

    ``sizes`` has ``key, n``: the rows of ``many`` by key, and ``rows`` is their sum where it is known
    (or a number above it). Keys with more than ``together`` rows are
    dealt out: their row of ``one`` is copied for each part, and ``spread`` (a hash of other columns
    of ``many``) picks a row's part. At most ``HOT_KEYS`` keys can be so large, as ``together`` is
    raised to their share of all rows; their hashes are broadcast. So few rows that no key can be
    hot are joined as they are.
    """
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if rows is None else rows
    if total <= together:
        return many.join(one, key, how)
    limit = max(together, total // HOT_KEYS + 1)
    hot = sizes.where(F.col("n") > limit).groupBy(F.xxhash64(key).alias("_hot")).agg(F.ceil(F.sum("n") / limit).cast("int").alias("_parts"))
    hot = F.broadcast(hot)  # HOT_KEYS rows of 12 bytes at most
    parts = F.coalesce("_parts", F.lit(1))
    left = many.withColumn("_h", F.xxhash64(key)).join(hot, F.col("_h") == F.col("_hot"), "left").withColumn("_part", F.pmod(spread, parts).cast("int")).drop("_h", "_hot", "_parts")
    right = one.withColumn("_h", F.xxhash64(key)).join(hot, F.col("_h") == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_h", "_hot", "_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def share_of_hash(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on ``key`` alone."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 31)) / float(1 << 31)
