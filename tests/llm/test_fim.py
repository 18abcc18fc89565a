"""Fill-in-the-middle against a plain version, and round trips."""

import hashlib
import random
import re

import pytest

from zscape.llm import fim

from .helpers import corpus, documents

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n, sha = len(units), lambda s: hashlib.sha256(s.encode()).hexdigest()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def odd_rows():
    rng = random.Random(3)
    rows = [(i, t) for i, t, *_ in corpus(120)]
    rows += [(200 + i, t) for i, t in enumerate(["", None, " ", "\t\n", "a", " a", "a ", "<P>", "x <M> y", "x <S", "P> y <", "straße  über uns", "😀 😀", "\x0b\x0c a b"])]
    rows += [(300 + i, " ".join(rng.choice(["<", "P>", "<S", ">", "<M", "é", "word"]) for _ in range(30))) for i in range(60)]
    rows += [(7, "other text under the same id"), (7, "other text under the same id"), (None, "no id"), (None, "no id"), (None, None)]
    rows += [(400 + i, "x" * 700_000 + " y" * 9_000 + " " * 300_000) for i in range(6)]
    return rows


def test_equals_the_plain_version(spark):
    rows = odd_rows()
    got = fim.digests(documents(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(plain(*r)) for r in rows)


def test_many_pieces(spark):
    rows = [(i, t) for i, t, *_ in corpus(60)] * 2
    docs = documents(spark, rows).coalesce(1)
    cut = fim.pieces(docs, units=3)
    assert cut.count() > fim.pieces(docs).count() + len(rows)
    assert sorted(map(repr, map(tuple, fim.digests(docs, units=3).collect()))) == sorted(repr(plain(*r)) for r in rows)
    text = b"one two  three four five "
    ends = fim.unit_ends(fim.np.frombuffer(text, fim.np.uint8))
    assert list(fim._cut(memoryview(text), ends, 3, 25, 2)) == [b" two  three", b" four five", b" "]
    assert list(fim._cut(memoryview(text), ends, 7, 7, 2)) == []


@pytest.mark.parametrize("rate, spm", [(100, 100), (100, 0), (0, 50)])
def test_texts_are_restored_from_output_and_form(spark, rate, spm):
    rows = odd_rows()[:190]
    out = fim.transformed(documents(spark, rows), ["doc_id", "lang"], rate=rate, spm=spm).collect()
    assert out[0].asDict().keys() == {"doc_id", "lang", "fim_form", "fim_text"}
    assert sorted(fim.restore(r["fim_form"], r["fim_text"]) for r in out) == sorted(t or "" for _, t in rows)
    forms = {r["fim_form"] for r in out}
    assert forms == ({"plain"} if rate == 0 else {"plain", "spm"} if spm == 100 else {"plain", "psm"})


def test_one_shuffle(spark):
    plan = fim.digests(documents(spark, corpus(10)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_table(spark):
    assert fim.digests(documents(spark, [])).collect() == []
    assert fim.transformed(documents(spark, []), ["doc_id"]).collect() == []
