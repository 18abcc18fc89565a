"""Language identification with presence string kernels.

A text becomes the set of its letter n-grams of one to three symbols (the blended spectrum, presence
only). The kernel of two texts is the number of n-grams they share over the root of the product of
their numbers of n-grams. Nyström landmarks stand for the whole kernel matrix, and one ridge
regression for each language against the rest is solved on them, each language with equal weight. A batch of texts is scored by two
matrix products: presence times landmarks, then kernel values times coefficients.

Nulls and texts without a letter are ``und`` with score 0. Ties go to the language that sorts first.
Repeated rows get equal results, an empty table gives no rows, and other columns are never read.
Texts of any length are read whole, a million characters at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces, share_of_hash

#: a-z have a symbol each, other letters share the rest by code point; 0 is anything that is no letter.
SYMBOLS = 96
DIMENSIONS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
CHUNK = 1_000_000
UNKNOWN = "und"
#: Most n-grams of a text that the model is fitted on (a text of 20,000 words of prose has fewer), so that
#: the sample is bounded in bytes too; most entries of a presence matrix at once (8 MB in a task).
FITTED, ENTRIES = 16_384, 1 << 21
#: A text with fewer distinct n-grams (about 80 characters of prose) says too little to be rejected.
ENOUGH = 150


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table = np.where(letters, 27 + np.arange(0x110000) % (SYMBOLS - 27), 0).astype(np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


@lru_cache(1)
def _stamp() -> np.ndarray:
    return np.zeros(DIMENSIONS, np.int64)


def spectrum(text: str | None) -> np.ndarray:
    """The distinct n-gram ids of a whole text; empty if it has no letter."""
    low, table = (text or "").lower(), _symbol_table()
    pieces = [table[np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)] for at in range(0, len(low), CHUNK)]
    s = np.concatenate([np.zeros(1, np.uint8), *pieces, np.zeros(1, np.uint8)])
    s = s[np.append(True, (s[1:] > 0) | (s[:-1] > 0))]  # one boundary between words
    if not s.any():
        return np.zeros(0, np.int32)
    found, stamp = [], _stamp()
    for at in range(0, len(s), CHUNK):
        part = s[at : at + CHUNK + 2].astype(np.int64)
        two = part[:-1] * SYMBOLS + part[1:]
        ids = np.concatenate((part, SYMBOLS + two, SYMBOLS + SYMBOLS**2 + two[:-1] * SYMBOLS + part[2:]))
        order = np.arange(len(ids))
        stamp[ids] = order  # the last of equal ids stays
        found.append(ids[stamp[ids] == order])
    return (found[0] if len(found) == 1 else np.unique(np.concatenate(found))).astype(np.int32)


def thinned(ids: np.ndarray) -> np.ndarray:
    """``ids``, or of too many those ``FITTED`` that a fixed mixing of their bits puts first."""
    if len(ids) <= FITTED:
        return ids
    mixed = (ids.astype(np.uint32) * np.uint32(2654435761)) ^ np.uint32(0x9E3779B9)
    return np.sort(ids[np.argsort(mixed, kind="stable")[:FITTED]])


@dataclass
class Model:
    """``columns`` maps an n-gram id to its row of ``landmarks`` (-1: none of them has it).

    With L languages of equal weight, a text without evidence gets values near 2 / L - 1, and 0 is a
    tie. ``floor`` is half way between, so texts in two learned languages stay. Up to two languages the
    classifiers can't tell junk (one of their values is never below 0), and there is no floor. A text in
    more languages than two falls below it too, but the landmarks explain it as well as other prose:
    its features by ``whiten`` are its projection on them, whose squared length (0 to 1) is one language's
    or the mean of several. ``familiar`` is half the length that all but a hundredth of the fitted rows
    reach (those with ``ENOUGH`` n-grams that are no landmarks; without any, nothing is familiar).
    """

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    roots: np.ndarray
    coefficients: np.ndarray
    bias: np.ndarray
    floor: float = -np.inf
    familiar: float = np.inf
    whiten: np.ndarray | None = None

    def kernel(self, spectra: list[np.ndarray]) -> np.ndarray:
        rows = max(1, ENTRIES // max(1, len(self.landmarks)))
        out = [np.zeros((0, len(self.roots)), np.float32)]
        for at in range(0, len(spectra), rows):
            part = spectra[at : at + rows]
            presence = np.zeros((len(part), len(self.landmarks)), np.float32)
            for i, ids in enumerate(part):
                c = self.columns[ids]
                presence[i, c[c >= 0]] = 1
            sizes = np.sqrt(np.array([max(1, len(x)) for x in part], np.float32))
            out.append((presence @ self.landmarks) / (sizes[:, None] * self.roots))
        return np.concatenate(out)

    def decide(self, near: np.ndarray) -> np.ndarray:
        """Of kernel values: a value near 1 for the text's language and near -1 for each other one."""
        return near @ self.coefficients + self.bias

    def explained(self, near: np.ndarray) -> np.ndarray:
        """Of kernel values: the share of a text's squared length that the landmarks span."""
        return ((near.astype(float) @ self.whiten) ** 2).sum(1)


def fit(spectra: list[np.ndarray], langs: list[str], landmarks: int = 96, ridge: float = 1e-2) -> Model | None:
    """Landmarks are taken in turn from each language, in the order of the sample."""
    if not langs:
        return None
    names = sorted(set(langs))
    by = {x: [i for i, y in enumerate(langs) if y == x] for x in names}
    turns = [by[x][k] for k in range(max(map(len, by.values()))) for x in names if k < len(by[x])]
    marked = dict.fromkeys(turns[: max(landmarks, len(names))])
    chosen = [spectra[i] for i in marked]
    ids = np.unique(np.concatenate(chosen))
    columns = np.full(DIMENSIONS, -1, np.int32)
    columns[ids] = np.arange(len(ids))
    marks = np.zeros((len(ids), len(chosen)), np.float32)
    for j, x in enumerate(chosen):
        marks[columns[x], j] = 1
    k = len(chosen)
    model = Model(names, columns, marks, np.sqrt(marks.sum(0)), np.eye(k, dtype=np.float32), np.zeros(k, np.float32))
    values, vectors = np.linalg.eigh(model.kernel(chosen).astype(float))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    near = np.concatenate([model.kernel(spectra[i : i + 256]) for i in range(0, len(spectra), 256)]).astype(float)
    x = near @ whiten
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    weight = np.array([len(x) / (len(names) * len(by[z])) for z in langs])  # each language weighs the same
    middle, level = np.average(x, 0, weight), np.average(y, 0, weight)
    own = (x - middle).T * weight
    a = np.linalg.solve(own @ (x - middle) + ridge * len(x) * np.eye(x.shape[1]), own @ (y - level))
    model.coefficients = (whiten @ a).astype(np.float32)
    model.bias = (level - middle @ a).astype(np.float32)
    model.floor = 1 / len(names) - 0.5 if len(names) > 2 else -np.inf
    telling = (x**2).sum(1)[[len(s) >= ENOUGH and i not in marked for i, s in enumerate(spectra)]]
    model.whiten = whiten
    model.familiar = float(np.quantile(telling, 0.01)) / 2 if len(telling) else np.inf
    return model


def train(docs: DataFrame, sample_rows: int = 2000, landmarks: int = 96) -> Model | None:
    """A model of at most ``sample_rows`` labelled rows outside the held-out fold, languages in equal parts.

    Each language gives the same number of rows, or all that it has if these are fewer; at least one.
    Rows without a letter don't count, and neither do repeated ids. The rows are picked by a hash of
    their id; their n-grams (``FITTED`` of a text at most) are found on the executors. None if no labelled row has a letter.
    """
    rows = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    count = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not count:
        return None
    each = max(1, sample_rows // len(count))
    order = share_of_hash(F.col("doc_id"), "language sample")
    by_lang = lambda values: F.create_map(*[F.lit(v) for x in values.items() for v in x])[F.col("lang")]
    thin = rows.where(order < by_lang({x: min(1.0, (2 * each + 64) / n) for x, n in count.items()}))  # enough of each, few in all
    seen = {x: [] for x in count}
    for r in thin.select("lang", order.alias("o")).distinct().collect():
        seen[r["lang"]].append(r["o"])
    last = {x: sorted(o)[:each][-1] for x, o in seen.items() if o}
    if not last:
        return None

    def find(batches):
        for b in pieces(batches):
            ids = [thinned(spectrum(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([x.tobytes() for x in ids], pa.binary()), b.column("o")], ["lang", "ids", "o"])

    picked = rows.where(order <= by_lang(last)).select("text", "lang", order.alias("o"))
    found = picked.mapInArrow(find, "lang string, ids binary, o double").where("length(ids) > 0").groupBy("lang", "o").agg(F.min("ids").alias("ids"))
    got = sorted((r["o"], r["lang"], bytes(r["ids"])) for r in found.collect())
    return fit([np.frombuffer(x, np.int32) for _, _, x in got], [x for _, x, _ in got], landmarks)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``lang_pred`` and ``score`` (the winner's value, scaled to 0..1).

    ``accepted`` is true for a text with a letter, unless it has at least ``ENOUGH`` n-grams, the
    winner's value is below the model's ``floor`` and the landmarks explain less of it than is ``familiar``.
    Without a model every text with a letter is accepted. A text goes to the task's Python once, also where it is kept.
    For the four languages of the test tables ``familiar`` is 0.2; base64 of random bytes has 0.1 at most, prose 0.22 at least.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)

    def run(batches):
        m = held.value
        for b in pieces(batches):
            spectra = [spectrum(t) for t in b.column("text").to_pylist()]
            size = np.array([len(x) for x in spectra], int)
            lang, score, yes = [UNKNOWN] * len(spectra), np.zeros(len(spectra)), size > 0
            if m and spectra:
                near = m.kernel(spectra)
                values = m.decide(near)
                best = values.argmax(1)
                top = values[np.arange(len(best)), best]
                has = size > 0
                lang = [m.languages[k] if h else UNKNOWN for k, h in zip(best, has)]
                score = np.where(has, np.clip((top.astype(float) + 1) / 2, 0, 1), 0.0)
                yes = has & ((size < ENOUGH) | (top >= m.floor) | (m.explained(near) >= m.familiar))
            own = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score), pa.array(yes)], [*keep, "lang_pred", "score", "accepted"])

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, f"{fields}lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows, train(docs), ["doc_id", "held_out"]).drop("accepted")
