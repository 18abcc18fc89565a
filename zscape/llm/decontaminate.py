"""Benchmark decontamination by size-partitioned MinHash containment search.

A document is contaminated by an item if it has at least ``threshold`` of the item's distinct
five-word shingles. Items are partitioned by their number of shingles, in classes of powers of two. A
class's upper bound u sets its search: an item of the class may lack floor((1 - threshold) * u) of its
shingles, its signature is the 2 * that + 1 smallest hashes of its shingles (all, if it has fewer),
and a document is a candidate if it has all of the signature but the number that may lack. As only the
item is sketched, the length of the document doesn't matter (in a sketch of its own, a short item
would be lost), and no pair can be missed. Hashes that more than ``FREQUENT`` items have (a stock phrase, in a
question's form say) leave a signature, most frequent first, while one match would still be needed of the
rest; each lowers the number by one, so still no pair can be missed, and a phrase in all items and documents
makes no pairs. Only candidates are verified: the item's shingles are looked up in the document, as strings.
Equal texts are searched as one item.

Words are runs of letters and digits of the lower-cased text. Items with fewer than five words can't
be evidence and match nothing. Null texts have no words. Rows without an id can't be named, so they are
left out of the pairs; ``clean`` judges every row by its own text, with an id or without. Rows that
repeat an id count as one document with all their shingles; rows that repeat an item's id with another
text are items of their own, and equal ones count once. Empty tables give no pairs. Other columns are
never read.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, evenly_joined, written

SHINGLE = 5
THRESHOLD = 0.8
#: Items that may share a hash before it leaves their signatures (no result depends on it).
FREQUENT = 100


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingles(w: Column, make) -> Column:
    """``make`` of the five columns of each shingle of the word array ``w``; empty if there are too few."""
    at = F.sequence(F.lit(0), F.size(w) - SHINGLE)
    each = F.transform(at, lambda i: make(*(F.get(w, i + k) for k in range(SHINGLE))))
    return F.when(F.size(w) >= SHINGLE, each)


def _hash(*w: Column) -> Column:
    return F.xxhash64(*w)


def _joined(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def _both(*w: Column) -> Column:
    return F.struct(_hash(*w).alias("h"), _joined(*w).alias("shingle"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``item, item_id, h, shingle, total, needed, wanted``: each item's distinct shingles.

    ``needed`` is set where the shingle is in the item's signature: the least number of the
    signature's hashes that a document with ``threshold`` of the item must have. ``wanted`` is set where it
    stays there without the frequent hashes: the least number of those that stay.
    """
    rows = items.where("item_id IS NOT NULL").select(F.sha2("text", 256).alias("item"), "item_id", F.explode(shingles(words(F.col("text")), _both)).alias("s"))
    rows = rows.select("item", "item_id", "s.h", "s.shingle").distinct()
    own = Window.partitionBy("item_id", "item")
    rows = rows.withColumn("total", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("h", "shingle")))
    upper = F.pow(F.lit(2.0), F.floor(F.log2("total")) + 1) - 1
    rows = rows.withColumn("lacking", F.floor(upper * (1 - threshold) + 1e-9)).withColumn("length", F.least("total", 2 * F.col("lacking") + 1))
    rows = written(rows.withColumn("in_it", F.col("place") <= F.col("length")), "signatures")
    common = rows.where("in_it").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT)
    rows = rows.join(common.withColumnsRenamed({"h": "_h", "n": "_n"}), F.col("in_it") & (F.col("h") == F.col("_h")), "left")
    rows = rows.withColumn("rarity", F.row_number().over(own.orderBy(F.desc("in_it"), F.coalesce("_n", F.lit(0)), "h", "shingle")))
    kept = F.greatest(F.col("length") - F.count_if(F.col("_n").isNotNull()).over(own), F.least("length", F.col("lacking") + 1))
    rows = rows.withColumn("kept", kept)
    needed = F.when(F.col("in_it"), F.col("length") - F.col("lacking"))
    return rows.select("item", "item_id", "h", "shingle", "total", needed.alias("needed"), F.when(F.col("rarity") <= F.col("kept"), F.col("kept") - F.col("lacking")).alias("wanted"))


#: Words of 64 bits that a filter of hashes has: a table of two longs each, so about 8 MB to broadcast.
FILTER_WORDS = 1 << 19


def _may_be_in(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """``rows`` whose ``h`` may be one of ``hashes``: a bit for each hash, in a table of bounded size."""
    word, bit = F.pmod(F.col("h"), F.lit(FILTER_WORDS)), F.pmod(F.shiftright("h", 32), F.lit(64)).cast("int")
    bits = hashes.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    kept = rows.withColumn("_w", word).join(F.broadcast(bits), F.col("_w") == F.col("_word"))
    return kept.where(F.call_function("bit_get", F.col("_bits"), bit) == 1).drop("_w", "_word", "_bits")


def _of_items(pairs: DataFrame, items: DataFrame, rows: int) -> DataFrame:
    """``pairs`` joined to the ``rows`` rows of ``items`` by ``item``, of which one may be in any share of the documents."""
    small = broadcast_if_small(items, rows, 256)
    if small is not items:
        return pairs.join(small, "item")
    return evenly_joined(pairs, items, "item", pairs.groupBy("item").agg(F.count("*").alias("n")), F.xxhash64("doc_id"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, matched, total, containment`` for each pair at ``threshold`` or above."""
    known = items.where("item_id IS NOT NULL")
    names = written(known.select(F.sha2("text", 256).alias("item"), "item_id").distinct(), "items")
    marks = written(sketches(known.groupBy("text").agg(F.min("item_id").alias("item_id")), threshold), "sketches")
    named = docs.where("doc_id IS NOT NULL")
    size = marks.agg(F.count("*"), F.count("wanted")).first()
    probe = marks.where("wanted IS NOT NULL").select("item", "h", "wanted")
    seen = named.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(shingles(F.col("w"), _hash))).alias("h"))
    small = broadcast_if_small(probe, size[1], 128)
    if small is not probe:
        met = seen.join(small, "h")
    else:  # most shingles go before the shuffle, and popular ones are dealt out
        seen = written(_may_be_in(seen, probe.select("h")).select("doc_id", "h").distinct(), "seen")
        met = evenly_joined(seen, probe, "h", seen.groupBy("h").agg(F.count("*").alias("n")), F.xxhash64("doc_id"))
    found = met.groupBy("doc_id", "item").agg(F.count_distinct("h").alias("n"), F.max("wanted").alias("wanted"))
    found = written(found.where("n >= wanted").select("doc_id", "item"), "candidates")
    ids = found.select("doc_id").distinct()
    few = broadcast_if_small(ids, found.count(), 16)
    again = named.join(few, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    its = marks.select("item", "h", "shingle", "total")
    own = its.select("shingle").distinct()
    own_small = broadcast_if_small(own, size[0], 256)
    if own_small is not own:
        again = again.select("doc_id", F.explode(shingles(F.col("w"), _joined)).alias("shingle")).join(own_small, "shingle", "left_semi")
    else:
        again = _may_be_in(again.select("doc_id", F.explode(shingles(F.col("w"), _both)).alias("s")).select("doc_id", "s.*"), its.select("h"))
    pairs = _of_items(found, its.drop("h"), size[0])
    hits = pairs.join(again.select("doc_id", "shingle").distinct(), ["doc_id", "shingle"], "left_semi")
    counted = hits.groupBy("doc_id", "item").agg(F.count("*").alias("matched"), F.max("total").alias("total"))
    counted = counted.where(F.col("matched") >= threshold * F.col("total") - 1e-9)
    return _of_items(counted, names, names.count()).select("doc_id", "item_id", "matched", "total", F.round(F.col("matched") / F.col("total"), 6).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of the rows whose text no item contaminates; null texts stay.

    Texts are named by their SHA-256, so equal texts are one document and rows need no id.
    """
    key = F.sha2("text", 256)
    found = written(contaminated(docs.select(key.alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    rows = docs.select(*columns, F.coalesce(key, F.concat(F.lit("null "), F.xxhash64(*columns).cast("string"))).alias("_key"))
    return rows.join(broadcast_if_small(found, found.count(), 80), "_key", "left_anti").select(*columns)


ORACLE_SQL = r"""
WITH i AS (SELECT DISTINCT item_id, text, array_to_string(w[k + 1:k + 5], ' ') AS s
           FROM (SELECT item_id, text, w, unnest(range(0, len(w) - 4)) AS k
                 FROM (SELECT item_id, text, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE item_id IS NOT NULL))),
     d AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 5], ' ') AS s
           FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS k
                 FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id IS NOT NULL))),
     n AS (SELECT item_id, text, count(*) AS total FROM i GROUP BY 1, 2)
SELECT doc_id, item_id, count(*) AS matched, total, round(count(*) / total, 6) AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id, text) GROUP BY doc_id, item_id, text, total HAVING count(*) >= 0.8 * total - 1e-9
"""
