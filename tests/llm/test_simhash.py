import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from zscape.llm import simhash as S

from .helpers import documents


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, budget=4):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    for text in ("", None, "a", "A b C", "a b\tc\nd É", "x y z w v u t s r " * 3, "  ", "É a b c d e"):
        assert S.fingerprint(text) == brute_fingerprint(text), text


def near(rng, n, flips):
    base = [rng.getrandbits(64) for _ in range(5)]
    out = set()
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_trie_finds_every_component(monkeypatch):
    rng = random.Random(0)
    monkeypatch.setattr(S, "FRONTIER", 64)
    for _ in range(15):
        fps = near(rng, 120, 7)
        a = np.array(fps, np.uint64)
        assert S.linked(a, np.zeros(len(a), np.int8), np.array([[0, len(a), 0, len(a)]])).tolist() == brute_components(fps)


def test_blocks_cover_every_pair_within_budget():
    rng = random.Random(5)
    for n in (1000, 50_000_000, 10_000_000_000):
        masks = S.blocks(n)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)
    assert len(S.blocks(1000)) < len(S.blocks(50_000_000))


def test_links_with_and_without_parts(spark, monkeypatch):
    fps = near(random.Random(9), 400, 6)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = brute_components(fps)

    def got():
        from zscape.llm.graph import connected_components

        found = {r["node"]: r["component"] for r in connected_components(S.links(frame)).collect()}
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        groups = {}
        for i, x in enumerate(signed):
            groups.setdefault(found.get(x, x), []).append(i)
        return sorted(map(tuple, groups.values()))

    expected = {}
    for i, r in enumerate(want):
        expected.setdefault(r, []).append(i)
    expected = sorted(map(tuple, expected.values()))
    assert got() == expected
    monkeypatch.setattr(S, "GROUP", 16)
    assert got() == expected


def test_components_contract(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, long), (3, long + " end"), (9, "quite another text of some words here"), (7, None), (2, ""), (7, None), (11, "A b"), (12, "a B")]
    out = {r["doc_id"]: r for r in S.components(documents(spark, rows)).collect()}
    for i, t in rows:
        assert out[i]["fingerprint"] == f"{brute_fingerprint(t):016x}"
    assert out[5]["component_id"] == out[3]["component_id"] == 3
    assert out[7]["component_id"] == out[2]["component_id"] == 2 and out[9]["component_id"] == 9 and out[12]["component_id"] == 11
    assert S.components(documents(spark, rows)).count() == 8 and S.components(documents(spark, rows).where("false")).count() == 0
    kept = sorted(r["doc_id"] for r in S.representatives(documents(spark, rows), ["doc_id", "text"]).collect())
    assert kept == [2, 3, 9, 11]


def test_null_ids(spark):
    docs = documents(spark, [(None, "one two three four five"), (4, "one two three four five"), (None, "other words entirely standing here")])
    out = S.components(docs).collect()
    assert sorted((r["component_id"] is None, r["component_id"] or 0) for r in out) == [(False, 4), (False, 4), (True, 0)]
    assert S.representatives(docs, ["doc_id", "text"]).count() == 3


def test_an_id_with_several_texts(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(3, text), (5, text + " end"), (5, "a text of its own under the id of a copy"), (9, "other words"), (3, "and the smallest id again with another text")]
    got = sorted((r["doc_id"], r["text"]) for r in S.representatives(documents(spark, rows), ["doc_id", "text"]).collect())
    assert got == sorted(r for r in rows if r[1] != text + " end")
    columns = S.representatives(documents(spark, rows), ["text", "lang"]).columns
    assert columns == ["text", "lang"]
