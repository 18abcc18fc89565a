import random
import zlib

import numpy as np

from zscape.llm import toxicity as T

from .helpers import corpus, documents


def data(n=1500):
    rng = random.Random(5)
    rows, labels = [], []
    for i, t, lang, s in corpus(n, 3):
        bad = rng.random() < 0.2
        rows.append((i, t + " " + rng.choice(["idiot", "scum", "vileness"]) + " x" if bad else t, lang, s))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    return rows, labels


def test_held_out_quality_and_contract(spark):
    rows, labels = data()
    truth = {i: any(w in t for w in ("idiot", "scum", "vileness")) for i, t, *_ in rows}
    docs = documents(spark, [*rows, (9000, None), (9001, ""), (None, "idiot")])
    table = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    out = T.score(docs, T.train(docs, table)).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    seen = [r for r in out if r["held_out"] and r["doc_id"] < 9000]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out if r["doc_id"] is not None)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in seen)
    assert right / len(seen) > 0.97


def test_no_labels(spark):
    docs = documents(spark, [(1, "x"), (2, None)])
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert T.train(docs, labels) is None and T.train(docs, labels.where("false")) is None
    assert [r["score"] for r in T.score(docs, None).collect()] == [0.0, 0.0] and T.score(docs.where("false"), None).count() == 0


def test_risk_is_not_fooled_by_hidden_positives():
    rng = np.random.default_rng(0)
    p = (rng.random((300, 5)) < [0.9, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    u = (rng.random((3000, 5)) < [0.1, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    u[:600] = p[rng.integers(0, 300, 600)]  # a fifth of the unlabelled are positive
    w, b = T.fit(p, u, 0.2)
    score = lambda x: 1 / (1 + np.exp(-(x @ w + b)))
    assert score(np.eye(5)[0]) > 0.5 > score(np.eye(5)[1])


def test_few_confirmed_texts(spark):
    kept = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows, _ = data(400)
    clean = [(i, t) for i, (_, t, *_) in zip(kept, rows) if not any(w in t for w in ("idiot", "scum", "vileness"))]
    for n in range(1, 8):
        bad = [(kept[1000 + k], f"you idiot {'the house water people'.split()[k % 4]} {k}") for k in range(n)]
        labels = [(i, 1) for i, _ in bad] + [(i, 0) for i, _ in clean[:40]]
        docs = documents(spark, [*clean, *bad, *bad[:1]])  # one of them repeated
        m = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        a, b, c = m.scores(["what an idiot", "water under the house", "what an idiot " * 100_000])
        assert a > b and a == c, n


def test_no_confirmed_text_in_the_table(spark):
    docs = documents(spark, [(1, "x y"), (3, "z")])
    assert T.train(docs, spark.createDataFrame([(77, 1), (1, 0)], "doc_id long, toxic int")) is None
