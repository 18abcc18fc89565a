"""The LSH forest against brute force over all pairs."""

import random

import numpy as np

from zscape.llm import forest

from .helpers import DOCS, corpus, documents


def plain_set(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3)) if len(words) >= 4 else frozenset([tuple(words)])


def plain(rows):
    """``doc_id, n, component, kept`` by all pairs of rows."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), c, c is None or doc_id == c))
    return out


def edited(rng, text, share):
    words = text.split()
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def planted(seed=2, families=25):
    """Families of copies with more and more edits, boilerplate that many share, and odd rows."""
    rng = random.Random(seed)
    boiler = " ".join(f"b{i}" for i in range(60))
    rows, n = [], 1000
    for f in range(families):
        base = " ".join(f"f{f}x{rng.randrange(400)}" for _ in range(rng.randint(5, 150)))
        if f % 3 == 0:
            base = boiler + " " + base
        for _ in range(rng.randint(1, 9)):
            n -= 1
            rows.append((n, edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.06, 0.1]))))
    rows += [(2000 + i, t) for i, t, *_ in corpus(60)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "ONE"), (3005, "one two three"), (3006, "one two\tthree"), (3007, "three two one"), (3008, "one two three four")]
    rows += [(rows[0][0], "an id with two texts"), (5000, "an ID with two  texts"), (None, "an id with two texts"), (None, "nobody names this text at all"), (None, "nobody names this text at all"), (None, None)]
    rows += [(6000, long := " ".join(f"l{i}" for i in range(60_000))), (6001, long + " end"), (4000, rows[5][1]), (4000, rows[5][1])]
    return rows


def _key(rows):
    return sorted(map(repr, map(tuple, rows)))


def check(spark, rows):
    got = forest.components(documents(spark, rows).repartition(3)).drop("place")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert _key(got.collect()) == _key(plain(rows))


def test_equals_all_pairs(spark):
    check(spark, planted())


def test_large_regions_in_parts(spark, monkeypatch):
    monkeypatch.setattr(forest, "GROUP", 7)  # the driver deals out parts
    rng = random.Random(8)
    base = " ".join(f"g{i}" for i in range(120))
    rows = [(i, edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05, 0.08]))) for i in range(120)]
    check(spark, rows)


def test_chain_of_links(spark):
    words = [f"c{i}" for i in range(400)]
    rows = [(50 - k, " ".join(words[8 * k : 8 * k + 100])) for k in range(30)]  # each links to the next alone
    assert len({c for _, _, c, _ in plain(rows)}) == 1
    check(spark, rows)


def test_signatures_estimate_and_sets_are_exact():
    rng = random.Random(4)
    for share in (0.0, 0.02, 0.05, 0.2):
        a = " ".join(f"s{rng.randrange(10**6)}" for _ in range(2000))
        b = edited(rng, a, share)
        x, y = forest.shingles(a), forest.shingles(b)
        p, q = plain_set(a), plain_set(b)
        assert len(x) == len(p) and len(np.intersect1d(x, y)) == len(p & q)
        assert forest.alike(x, y) == (100 * len(p & q) >= 80 * len(p | q))
        assert abs((forest.signature(x) == forest.signature(y)).mean() - len(p & q) / len(p | q)) < 0.15


def test_deduplicated_rows(spark):
    rows = planted(6, 10)
    kept = [(i, t) for (i, t), (_, _, _, k) in zip(rows, plain(rows)) if k]
    got = forest.deduplicated(documents(spark, rows), ["text", "doc_id"])
    assert got.columns == ["text", "doc_id"] and _key((r["doc_id"], r["text"]) for r in got.collect()) == _key(kept)


def test_empty_table(spark):
    assert forest.components(spark.createDataFrame([], DOCS)).collect() == []
    assert forest.deduplicated(documents(spark, [(1, None)]), ["doc_id"]).collect() == [(1,)]
