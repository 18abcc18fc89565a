"""Importance resampling: documents drawn by how much their words look like a target's.

Words are runs of ASCII letters, digits and all characters beyond ASCII of the text with A-Z lower-cased.
A feature is a run of 1 to ``longest`` words joined by one space, its bucket the CRC32 of its UTF-8 bytes
modulo ``BUCKETS``. A bucket's gain is 1000 times the logarithm of its share of the target's features over its
share of the documents', smoothed by one; a document's weight is the sum of its features' gains, and its score
adds Gumbel noise that a hash of its id gives. The documents with the highest scores are drawn, which
samples them by their importance without replacement.

The words are found by an Aho-Corasick automaton. Its dictionary holds distinct words between delimiters,
each with its CRC and its length as payload, so that a scan of a text emits payloads and never cuts or
hashes a known word; neighbours share a delimiter. The payload of a longer run is composed of those of
adjacent words: appending bytes is a linear map on a CRC, with a table for each length. The dictionary is
a bounded one, of frequent words (``WORDS`` of a sample of ``SAMPLE`` texts of each table, so that a worker
holds it); what lies between two emitted words has the words that it lacks, whose CRC is computed there, so
results do not depend on the dictionary.

The texts are scanned once; two bytes a feature are kept. Buckets are summed within each task (a row for each
bucket leaves it), and ranks come from range partitions. Nothing but the counts of buckets and the dictionary
reaches the driver.

A null text has no words, and a text without words has weight 0. A null id is hashed as the empty text
and comes last among ties; rows that repeat an id are documents of their own, ordered among ties by their
numbers of words and features, so only rows equal in all these are interchangeable. Empty tables: without documents
no rows, without a target all gains come from the smoothing. Other columns are never read.
"""

from __future__ import annotations

from functools import cached_property, lru_cache
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import numbered
from .common import pieces, share_of_hash, written

BUCKETS, LONGEST = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Most words of the dictionary and most characters of one; texts of each table that they are counted in.
WORDS, WORD_CHARS, SAMPLE = 50_000, 40, 4096

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_KEPT = np.isin(_BYTES, list(b"0123456789abcdefghijklmnopqrstuvwxyz")) | (_BYTES >= 0x80)
_TABLE = np.where(_KEPT, _BYTES, 0x20).astype(np.uint8).tobytes()


def normal(text: str | None) -> str:
    """The text with A-Z lower-cased and each delimiter as a space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass")


class Dictionary:
    """Words as an automaton, which each worker builds once (only the words are sent)."""

    def __init__(self, words: list[str]) -> None:
        self.words = words

    def __getstate__(self) -> dict:
        return {"words": self.words}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for w in self.words:
            raw = w.encode("utf-8", "surrogatepass")
            out.add_word(f" {w} ", (crc32(raw), len(raw), len(w) + 1))
        out.make_automaton()
        return out

    def scan(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length in bytes of each word of a text, in order."""
        s = f" {normal(text)} "
        crcs: list[int] = []
        sizes: list[int] = []
        last = 0  # the delimiter after the last word
        for end, (crc, size, back) in self.automaton.iter(s) if self.words else ():
            if end - back > last:
                for w in filter(None, s[last : end - back].split(" ")):
                    raw = w.encode("utf-8", "surrogatepass")
                    crcs.append(crc32(raw))
                    sizes.append(len(raw))
            crcs.append(crc)
            sizes.append(size)
            last = end
        for w in filter(None, s[last:].split(" ")):
            raw = w.encode("utf-8", "surrogatepass")
            crcs.append(crc32(raw))
            sizes.append(len(raw))
        return np.array(crcs, np.uint32), np.array(sizes, np.int64)


def _byte_table() -> np.ndarray:
    """What a zero byte makes of each low byte of a CRC."""
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(0xEDB88320), v >> 1).astype(np.uint32)
    return v


@lru_cache(maxsize=4096)
def _shift_table(size: int) -> np.ndarray:
    """For each of a CRC's four bytes, what it becomes when ``size`` zero bytes are appended."""
    step = _byte_table()
    v = np.array([[b << (8 * k) for b in range(256)] for k in range(4)], np.uint32)
    if size > 64:  # twice half of it, and one more if odd
        v = shifted(shifted(v.ravel(), size // 2), size // 2).reshape(4, 256)
        size %= 2
    for _ in range(size):
        v = (v >> 8) ^ step[v & 255]
    return v


def shifted(crcs: np.ndarray, size: int) -> np.ndarray:
    """The part that CRCs have in those of texts that go on for ``size`` bytes."""
    t = _shift_table(size)
    return t[0][crcs & 255] ^ t[1][(crcs >> 8) & 255] ^ t[2][(crcs >> 16) & 255] ^ t[3][crcs >> 24]


def composed(crcs: np.ndarray, sizes: np.ndarray, longest: int) -> np.ndarray:
    """The CRCs of all runs of 1 to ``longest`` adjacent words, joined by a space, from those of the words."""
    out = [crcs]
    if longest > 1 and len(crcs) > 1:
        spaced, kinds = np.empty_like(crcs), np.unique(sizes)
        gap = np.array([crc32(b" ")], np.uint32)
        for k in kinds.tolist():
            own = sizes == k
            spaced[own] = shifted(gap, k)[0] ^ crcs[own]
        run = crcs
        for n in range(2, longest + 1):
            if len(crcs) < n:
                break
            head, tail = run[:-1], sizes[n - 1 :]
            run = np.empty(len(head), np.uint32)
            for k in np.unique(tail).tolist():
                own = tail == k
                run[own] = shifted(head[own], k + 1)
            run ^= spaced[n - 1 :]
            out.append(run)
    return np.concatenate(out)


def dictionary(*tables: DataFrame, words: int = WORDS, sample: int = SAMPLE) -> Dictionary:
    """Frequent words of a bounded sample of each table's texts."""
    spoken = None
    for t in tables:
        share = sample / max(1, t.count())
        some = t.where(share_of_hash(F.col("text"), "dictionary") < min(1.0, 2 * share)).select("text").limit(sample)
        spoken = some if spoken is None else spoken.union(some)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = spoken.select(F.explode(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("w")).where((F.col("w") != "") & (F.char_length("w") <= WORD_CHARS))
    return Dictionary([r[0] for r in each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect()])


def scanned(texts: DataFrame, columns: list[str], known: Dictionary, longest: int = LONGEST) -> DataFrame:
    """``columns`` of every row, with ``n_words`` and ``buckets``: its features' buckets, two bytes each."""
    held = texts.sparkSession.sparkContext.broadcast(known)  # WORDS words of WORD_CHARS characters at most
    extra = [] if "text" in columns else ["text"]

    def run(batches):
        for b in pieces(batches):
            words, features = [], []
            for t in b.column("text").to_pylist():
                crcs, sizes = held.value.scan(t)
                words.append(len(crcs))
                features.append((composed(crcs, sizes, longest) % BUCKETS).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(words, pa.int64()), pa.array(features, pa.binary())], [*columns, "n_words", "buckets"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*columns).schema]
    return texts.select(*columns, *extra).mapInArrow(run, ", ".join([*fields, "n_words long", "buckets binary"]))


def bucket_counts(rows: DataFrame) -> DataFrame:
    """``bucket, n``: the features of all scanned rows by bucket; each task adds up its own."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for b in pieces(batches):
            for x in b.column("buckets").to_pylist():
                counts += np.bincount(np.frombuffer(x, "<u2"), minlength=BUCKETS)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own])], ["bucket", "n"])

    return rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain, from scanned rows of both."""
    both = bucket_counts(docs).withColumn("side", F.lit("s")).union(bucket_counts(target).withColumn("side", F.lit("t")))
    counts = {side: np.zeros(BUCKETS) for side in "st"}
    for r in both.collect():  # two rows a bucket at most
        counts[r["side"]][r["bucket"]] = r["n"]
    s, t = counts["s"], counts["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Scanned rows with ``n_features`` and ``weight`` in place of their buckets."""
    held = rows.sparkSession.sparkContext.broadcast(gain)
    columns = [c for c in rows.columns if c != "buckets"]

    def run(batches):
        for b in pieces(batches):
            features = [np.frombuffer(x, "<u2") for x in b.column("buckets").to_pylist()]
            own = [pa.array([len(f) for f in features], pa.int64()), pa.array([int(held.value[f].sum()) for f in features], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *own], [*columns, "n_features", "weight"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema]
    return rows.mapInArrow(run, ", ".join([*fields, "n_features long", "weight long"]))


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` with ``score``: the weight and the noise of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))))


def _scores(docs: DataFrame, target: DataFrame, columns: list[str], longest: int, seed: int) -> DataFrame:
    known = dictionary(docs, target)
    rows = written(scanned(docs, columns, known, longest), "scanned")
    wanted = written(scanned(target, [], known, longest), "scanned-target")
    return scored(weighed(rows, gains(rows, wanted)), seed)


def _ranked(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """Scored rows with ``rank``, null where they aren't drawn."""
    take = rows.where(F.col("n_words") >= least).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight"), F.col("last")]
    ranked = numbered(rows.where(F.col("n_words") >= least).withColumn("last", F.monotonically_increasing_id()), order, kind="long")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).drop("last")
    return ranked.unionByName(rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; the rank is null where it isn't drawn.

    Of the documents with at least ``least`` words ``percent`` in a hundred are drawn.
    """
    rows = written(_scores(docs, target, ["doc_id"], longest, seed), "weighed")
    return _ranked(rows, percent, least).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, columns: list[str], percent: int = PERCENT, least: int = LEAST_WORDS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``columns`` of the documents that are drawn; rows that tie in score and id with the last all are.

    Only scores are ranked; whole rows are held against the last one drawn, and never sorted.
    """
    kept = [*columns, *(c for c in ("doc_id",) if c not in columns)]
    rows = written(_scores(docs, target, kept, longest, seed), "weighed")
    last = _ranked(rows.select("doc_id", "n_words", "n_features", "weight", "score"), percent, least).where("rank IS NOT NULL").agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("x")).first()["x"]
    if last is None:
        return rows.select(*columns).limit(0)
    tie = F.coalesce(F.col("doc_id") <= F.lit(last["doc_id"]), F.lit(False)) if last["doc_id"] is not None else F.lit(True)
    return rows.where((F.col("n_words") >= least) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tie))).select(*columns)


ORACLE_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
     w AS (SELECT 's' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
           UNION ALL SELECT 't', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
     u AS (SELECT w, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || x[2 * i - 1:2 * i])::BIGINT) AS bytes FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM w))),
     b AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM u, tab),
     f AS (SELECT side, id, bucket, count(*) AS n FROM w JOIN b USING (w) GROUP BY ALL),
     c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM f GROUP BY 1),
     z AS (SELECT sum(s) AS s, sum(t) AS t FROM c),
     g AS (SELECT bucket, floor(1000 * ln((c.t + 1) * (z.s + 10000) / ((c.s + 1) * (z.t + 10000))))::BIGINT AS gain FROM c, z),
     d AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 's' GROUP BY 1),
     k AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN d ON doc_id = id),
     r AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM k),
     o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS take FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= take THEN place END AS rank FROM o
"""
