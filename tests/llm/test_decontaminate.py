import math
import random
import re

from zscape.llm import decontaminate as D

from .helpers import documents

W = [f"w{i}" for i in range(40)]


def shingles(text):
    w = re.sub(r"[^\w]|_", " ", (text or "").lower()).split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    own = {}
    for i, t, *_ in docs:
        if i is not None:
            own.setdefault(i, set()).update(shingles(t))
    return sorted((i, k, len(s & own[i])) for i in own for k, t in set(items) if k is not None and (s := shingles(t)) and len(s & own[i]) >= 0.8 * len(s) - 1e-9)


def run(spark, docs, items):
    found = D.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r["doc_id"], r["item_id"], r["matched"]) for r in found.collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice(W) for _ in range(rng.randint(3, 60)))) for k in range(25)] + [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y z u v w"), (50, None), (51, "")]
    docs = []
    for i in range(80):
        parts = [rng.choice(W) for _ in range(rng.randint(0, 80))]
        if i % 2:
            w = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
            parts[len(parts) // 2 : len(parts) // 2] = w
        docs.append((i, " ".join(parts).title() if i % 3 else ", ".join(parts)))
    docs += [(200, "A b, C d! e f"), (200, "A b, C d! e f"), (None, "a b c d e f"), (201, None), (202, "")]
    want = brute(docs, items)
    assert len(want) > 20 and run(spark, docs, items) == want


def test_signatures_are_the_smallest_hashes_and_long_enough(spark):
    items = [(n, " ".join(f"t{n}x{i}" for i in range(n + 4))) for n in (1, 2, 3, 7, 8, 40, 63, 64, 300)]
    rows = D.sketches(spark.createDataFrame(items, "item_id long, text string"), 0.8).collect()
    for n, _ in items:
        own = [r for r in rows if r["item_id"] == n]
        marked = sorted(r["h"] for r in own if r["needed"] is not None)
        lacking = n - math.ceil(0.8 * n)
        assert len(own) == n and marked == sorted(r["h"] for r in own)[: len(marked)]
        assert {r["needed"] for r in own} - {None} <= {k for k in range(1, len(marked) - lacking + 1)}  # so no pair is missed
        assert n < 3 or len(marked) < n or n < 8


def test_empty_tables_and_clean(spark):
    item = [(1, "one two three four five six seven")]
    docs = [(1, "so One two three four five six seven then"), (2, "nothing of it here"), (None, "one two three four five six seven")]
    assert run(spark, docs, []) == [] and run(spark, [], item) == []
    kept = D.clean(documents(spark, docs), spark.createDataFrame(item, "item_id long, text string"), ["doc_id", "text"]).collect()
    assert [tuple(r) for r in kept] == [(2, "nothing of it here")]


def test_clean_judges_rows_by_their_text(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = [(1, "ONE two three; four five six seven"), (1, "nothing of it here"), (None, None), (None, None), (None, "one two three four five six seven"), (2, ""), (2, "")]
    kept = D.clean(documents(spark, docs), items, ["doc_id", "text"]).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, "nothing of it here"), (None, None), (None, None), (2, ""), (2, "")]))


def test_common_phrases_and_long_documents(spark):
    rng = random.Random(8)
    common = "which of the following is the best answer to the question"
    items = [(k, f"{common} {' '.join(f'i{k}w{rng.randrange(999)}' for _ in range(12))}") for k in range(30)]
    filler = [rng.choice(W) for _ in range(20_000)]
    docs = [(i, " ".join([common] * 3 + filler[: 50 * i])) for i in range(30)]
    docs += [(100 + k, " ".join([*filler[: 10_000], items[k][1], *filler[10_000:]])) for k in range(3)]
    want = brute(docs, items)
    assert {(i, k) for i, k, _ in want} == {(100 + k, k) for k in range(3)} and run(spark, docs, items) == want


def test_no_broadcast_gives_the_same(spark, monkeypatch):
    from zscape import shared

    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(W) for _ in range(20))) for k in range(40)]
    docs = [(i, " ".join([rng.choice(W) for _ in range(60)]) + (" " + items[i % 40][1] if i % 2 else "")) for i in range(60)]
    want = brute(docs, items)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    assert len(want) >= 30 and run(spark, docs, items) == want


def test_a_phrase_in_every_item_and_document(spark, monkeypatch):
    from zscape import shared
    from zscape.llm import common

    phrase = "choose the best answer to this question and say why"
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(k, f"{phrase} " + " ".join(word() for _ in range(20))) for k in range(60)] + [(k, phrase) for k in (100, 101)] + [(102, f"{phrase} {phrase} now")]
    docs = [(i, f"{word()} {phrase} " + (items[i][1] if i < 20 else " ".join(word() for _ in range(30)))) for i in range(120)]
    docs += [(7, docs[3][1]), (7, docs[3][1])]
    want = brute(docs, items)
    assert len(want) > 200
    monkeypatch.setattr(D, "FREQUENT", 5)
    rows = D.sketches(spark.createDataFrame(items, "item_id long, text string"), 0.8)
    probes = {r["item_id"]: r["n"] for r in rows.where("wanted IS NOT NULL AND shingle LIKE 'choose the best%'").groupBy("item_id").count().withColumnRenamed("count", "n").collect()}
    assert not set(probes) & set(range(60)) and rows.where("wanted < 1").isEmpty()  # the phrase stays a probe only of items that are nothing else
    assert run(spark, docs, items) == want
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    whole, dealt = common.evenly_joined, []

    def in_parts(*args, **kw):
        dealt.append(args[2])
        return whole(*args, **{**kw, "together": 10})

    monkeypatch.setattr(D, "evenly_joined", in_parts)
    assert run(spark, docs, items) == want and dealt == ["h", "item", "item"]
    monkeypatch.setattr(D, "FREQUENT", 100)
    assert run(spark, docs, items) == want
