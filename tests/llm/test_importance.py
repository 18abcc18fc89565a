"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from zscape.llm import importance

from .helpers import corpus, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    ws = WORD.findall((text or "").translate(LOWER))
    return ws, [crc32(" ".join(ws[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def plain(docs, target, longest=1, percent=10, least=20):
    s, t = (Counter(b for x in xs for b in features(x, longest)[1]) for xs in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in s}
    rows = []
    for doc_id, text in docs:
        ws, f = features(text, longest)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    eligible = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def rows():
    rng = random.Random(5)
    out = [(i, t) for i, t, *_ in corpus(150, seed=9)]
    out += [(500 + i, " ".join(rng.choice(["Straße", "x1", "été", "日本", "under", f"rare{rng.random()}"]) for _ in range(rng.randint(15, 60)))) for i in range(80)]
    out += [(700, None), (701, ""), (702, " .,; "), (703, "A-b_c.D"), (3, "another text " * 20), (3, "another text " * 20), (None, "no id " * 15), (None, "none " * 25), (704, "long word " * 40_000), (705, "z" * 300_000 + " end")]
    return out


TARGET = ["under water there was a house", None, "STRASSE straße x1 x1", ""]


def _key(xs):
    return sorted(map(repr, map(tuple, xs)))


@pytest.mark.parametrize("longest", [1, 3])
def test_equals_the_plain_version(spark, longest):
    docs, target = rows(), spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = importance.drawn(documents(spark, docs).repartition(3), target, percent=40, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert _key(got.collect()) == _key(plain(docs, TARGET, longest, 40))


def test_results_do_not_depend_on_the_dictionary():
    texts = [t for _, t in rows()]
    every = importance.Dictionary(sorted({w for t in texts for w in features(t, 1)[0]}))
    some, none = importance.Dictionary(every.words[::3]), importance.Dictionary([])
    for t in texts:
        want = [crc32(w.encode()) for w in features(t, 1)[0]]
        for d in (every, some, none):
            crcs, sizes = d.scan(t)
            assert crcs.tolist() == want and sizes.tolist() == [len(w.encode()) for w in features(t, 1)[0]]


def test_runs_are_composed_from_payloads():
    words = ["a", "bb", "straße", "c" * 300, "d"]
    crcs, sizes = np.array([crc32(w.encode()) for w in words], np.uint32), np.array([len(w.encode()) for w in words])
    want = [crc32(" ".join(words[i : i + n]).encode()) for n in range(1, 5) for i in range(len(words) - n + 1)]
    assert importance.composed(crcs, sizes, 4).tolist() == want
    assert importance.composed(crcs[:1], sizes[:1], 4).tolist() == want[:1]


def test_drawn_documents_keep_their_columns(spark):
    docs, target = rows(), spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    want = sorted(str(r[0]) for r in plain(docs, TARGET, 1, 30) if r[4] is not None)
    got = importance.resampled(documents(spark, docs), target, ["text", "lang", "doc_id"], percent=30)
    assert got.columns == ["text", "lang", "doc_id"] and sorted(str(r["doc_id"]) for r in got.collect()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.drawn(documents(spark, []), none).collect() == []
    assert importance.resampled(documents(spark, []), none, ["text"]).collect() == []
    docs = rows()[:60]
    assert _key(importance.drawn(documents(spark, docs), none).collect()) == _key(plain(docs, []))
