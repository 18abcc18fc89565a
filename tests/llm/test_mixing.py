import math
import random

from zscape.llm import mixing as M

from .helpers import documents


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        if not open_:
            return {s: 2.0 * sizes[s] for s in names}
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= more


def rows():
    rng = random.Random(8)
    out = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), "en", rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(600)]
    return [*out, (700, None, "en", "a"), (701, "", None, "empty"), (702, "x y z", None, "b"), (5, "dup id here", None, "b"), (5, "dup id here", None, "b")]


def test_contract(spark):
    docs = rows()
    out = M.mix(documents(spark, docs), ["doc_id", "source"]).collect()
    assert len(out) == len(docs)
    sizes = {}
    for _, t, _, s in docs:
        sizes[s] = sizes.get(s, 0) + len([w for w in (t or "").replace("\t", " ").split(" ") if w])
    want = brute_targets(sizes)
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2 * 60, (s, t, want[s])
    again = M.mix(documents(spark, docs).repartition(7), ["doc_id", "source"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_copies_cross_integer_boundaries(spark):
    docs = [(i, "one two three", "en", "a" if i % 4 else "b") for i in range(400)]
    out = M.mix(documents(spark, docs), ["doc_id", "source"]).collect()
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["copies"] for r in own) - len(own) * own[0]["target"] / own[0]["source_size"]) <= 1


def test_emitted_and_empty(spark):
    docs = rows()
    mixed = M.mix(documents(spark, docs), ["doc_id"])
    total = sum(r["copies"] for r in mixed.collect())
    emitted = M.emitted(documents(spark, docs), ["doc_id", "text", "source"])
    assert emitted.columns == ["doc_id", "text", "source", "copy"] and emitted.count() == total
    assert M.mix(documents(spark, docs).where("false"), ["doc_id"]).count() == 0
    blank = M.mix(documents(spark, [(1, None, None, "a"), (2, " ", None, "b")]), ["doc_id"]).collect()
    assert all(r["target"] == 0 and r["taken"] == 0 for r in blank)


def test_copies_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    same = [(i % 5 if i % 3 else None, " ".join(rng.choice("abc") for _ in range(6)), None, "s") for i in range(300)]  # ids and sizes repeat, texts differ
    seen = []
    for parts in (1, 7):
        docs = documents(spark, sorted(same, key=str) if parts == 1 else same).repartition(parts)
        seen.append(sorted((str(r["doc_id"]), r["text"], r["copy"]) for r in M.emitted(docs, ["doc_id", "text"]).collect()))
    assert seen[0] == seen[1] and seen[0]
