"""Toxicity by non-negative positive-unlabelled learning.

Some documents are confirmed toxic; all others are unlabelled, toxic ones among them. A linear
classifier on the presence of words and of their beginnings is trained in numpy with the class-prior-corrected risk

    prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0))

with the logistic loss, so its score estimates the chance that a text is toxic; where the second term
goes below zero, the step climbs it instead, as else the classifier would overfit the positives. The
prior is the share of toxic rows among the labelled ones of the learning fold. Words are chosen by how
much more often confirmed texts have them than unlabelled ones; one confirmed text is enough to learn from.

Null and empty texts have no words and get the score of a text without any. Null labels are no labels;
an id with several labels is toxic if one says so; rows without an id teach nothing. Without any
confirmed text or label every score is 0. Repeated rows get equal results, an empty table gives no
rows, other columns are never read, and texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, held_out, pieces, share_of_hash, written

#: Most confirmed and most unlabelled texts that the classifier is fitted on, and its words.
POSITIVE, UNLABELLED, WORDS = 4000, 16000, 512
#: A word must be in this share of the confirmed texts, and in ``SEVERAL`` or, of fewer than twice as many,
#: in half of them: rarer ones tell copies apart.
SUPPORT, SEVERAL = 0.01, 8
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The words of a text, and the first four and five letters of longer ones (with a star)."""
    own = set(TOKEN.findall((text or "").lower()))
    return own | {w[:n] + "*" for w in own for n in (4, 5) if len(w) > n}


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known, out = self.words, np.zeros(len(texts))
        for i, t in enumerate(texts):
            out[i] = sum(self.weights[known[w]] for w in words(t) if w in known)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a 0/1 matrix, with a column of ones, and the share of each."""
    packed, count = np.unique(np.packbits(rows > 0, axis=1), axis=0, return_counts=True)
    own = np.unpackbits(packed, axis=1)[:, : rows.shape[1]].astype(np.float64)
    return np.column_stack([own, np.ones(len(own))]), count / count.sum()


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk's minimum, by Adam over all rows at once."""
    p, share_p = _distinct(positive)
    u, share_u = _distinct(unlabelled)
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    ridge = np.full(len(w), decay)
    ridge[-1] = 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        negative_risk = share_u @ np.logaddexp(0, zu) - prior * share_p @ np.logaddexp(0, zp)
        as_one = prior * ((share_p * (sigmoid(zp) - 1)) @ p)
        rest = (share_u * sigmoid(zu)) @ u - prior * (share_p * sigmoid(zp)) @ p
        g = (as_one + rest if negative_risk >= 0 else -rest) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of bounded samples, picked by a hash of the id, of documents outside the held-out fold."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return None
    prior = float(np.clip(n_toxic / n, 0.001, 0.9))
    learn = docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    order = share_of_hash(F.col("doc_id"), "toxicity sample")
    ids = known.where("toxic = 1").where(order < min(1.0, 1.2 * POSITIVE / n_toxic)).orderBy(order, "doc_id").limit(POSITIVE).select("doc_id")
    total = learn.select("doc_id").count()
    confirmed = learn.join(broadcast_if_small(ids, POSITIVE, 16), "doc_id", "left_semi").select("text", F.lit(1).alias("y"))
    others = learn.where(order < min(1.0, 1.1 * UNLABELLED / max(1, total))).select("text", F.lit(0).alias("y"))

    def split(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([sorted(words(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], ["y", "words"])

    sample = written(confirmed.union(others).mapInArrow(split, "y int, words array<string>").distinct(), "toxicity-sample")
    count = dict(sample.groupBy("y").count().collect())
    if not count.get(1):
        return None
    n_p, n_u = count[1], max(1, count.get(0, 0))
    seen = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("u")).where(F.col("p") >= max(SUPPORT * n_p, min(SEVERAL, n_p / 2)))
    share = (F.col("u") + 1) / (n_u + 2)
    gain = (F.col("p") / n_p - share) / F.sqrt(share * (1 - share) / n_p)
    best = seen.orderBy(F.desc(gain), "word").limit(WORDS).select("word").collect()
    place = {r[0]: i for i, r in enumerate(best)}

    def indexed(batches):
        for b in pieces(batches):
            rows = [np.array(sorted(place[w] for w in ws if w in place), np.int16).tobytes() for ws in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.binary())], ["y", "at"])

    matrices = {1: [], 0: []}
    for r in sorted(sample.mapInArrow(indexed, "y int, at binary").collect()):  # the bounded sample, a few bytes a row
        matrices[r["y"]].append(np.frombuffer(bytes(r["at"]), np.int16))

    def dense(rows):
        x = np.zeros((len(rows), len(place)), np.float32)
        for i, at in enumerate(rows):
            x[i, at] = 1
        return x

    weights, bias = fit(dense(matrices[1]), dense(matrices[0] or [np.zeros(0, np.int16)]), prior)
    return Model(place, weights, bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            s = m.scores(texts) if m else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
