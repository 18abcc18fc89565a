import random

import corpus_pipeline as C
from zscape.llm import decontaminate, language_id, mixing, secret_scan, simhash

from .helpers import corpus, sentence


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(0)
    item = sentence(rng, "en", 20)
    rows = corpus(90)
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(10)]  # exact copies
    rows += [(300, "so " + item + " it was", "en", "s0"), (301, "key token=abcdef123456 " + sentence(rng, "en", 12), "en", "s2"), (302, None, None, None), (303, "12345 !!", None, "s0")]
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    keep = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    fps = [simhash.fingerprint(r[1]) for r in keep]
    label = list(range(len(keep)))
    for _ in keep:
        for i in range(len(keep)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for r, k in zip(keep, label):
        least[k] = min(least.get(k, r[0]), r[0])
    keep = [r for r, k in zip(keep, label) if least[k] == r[0]]
    keep = [r for r in keep if r[0] != 300]
    texts = {r[0]: r[1].replace("token=abcdef123456", "[SECRET]") for r in keep}

    stages, before = dict(C.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash", "decontaminate", "secret_scan", "mixing"]
    for name in list(stages)[:-1]:
        before = stages[name](spark, before, str(tmp_path))
        assert before.columns == C.COLUMNS
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in before.collect()}
    assert got == {i: (t, len(t)) for i, t in texts.items()}
    want = {}
    for r in mixing.mix(before, ["doc_id"]).collect():
        want[r["doc_id"]] = r["copies"]
    copies = {}
    for r in C.run(spark, str(tmp_path)).collect():
        assert r["text"] == texts[r["doc_id"]]
        copies[r["doc_id"]] = max(copies.get(r["doc_id"], 0), r["copy"])
    assert copies == {i: c for i, c in want.items() if c}
    assert language_id.UNKNOWN == "und" and decontaminate.SHINGLE == 5 and secret_scan.RULES


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_language_stage_follows_the_classifiers(spark):
    rng = random.Random(2)
    junk = [(1000 + i, "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(600)), None, "s0") for i in range(20)]
    long = [(2000 + i, sentence(rng, lang, 120), None, "s1") for i, lang in enumerate(["en", "de", "fr"] * 10)]
    both = [(3000, sentence(rng, "en", 60) + " " + sentence(rng, "fr", 60), None, "s1"), (3001, "q", None, None), (3002, "12 !", None, None)]
    frame = lambda rows: spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in C.language(spark, frame(corpus(400) + junk + long + both), "").collect()}
    assert kept == {*range(400), *(r[0] for r in long), 3000, 3001}
    # no label, so no model: texts with a letter stay
    bare = [(i, t, None, s) for i, t, _, s in corpus(30)] + [(900, None, None, None), (901, "12 !", None, None)]
    assert {r["doc_id"] for r in C.language(spark, frame(bare), "").collect()} == set(range(30))


def test_odd_rows_pass_the_stages(spark, tmp_path):
    rng = random.Random(5)
    item = sentence(rng, "en", 25)
    plain = [(i, t, lang, s) for i, t, lang, s in corpus(40)]
    odd = [(None, "an own text without an id " + sentence(rng, "en", 9), None, None), (None, "so " + item, "en", "s0"), (None, None, None, None), (500, "", "en", "s1"), (7, *plain[7][1:]), (7, *plain[7][1:]), (501, sentence(rng, "de", 20_000), None, "s2")]
    rows = [(i, t, lang, s, len(t) if t is not None else None, 1.0, "x", "y") for i, t, lang, s in plain + odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, copy string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = C.run(spark, str(tmp_path)).collect()
    assert {r["copy"] for r in got} <= {1, 2} and all(r["text"] for r in got)
    kept = {(r["doc_id"], r["text"]) for r in got}
    assert not any(item in t for _, t in kept) and 500 not in {i for i, _ in kept}  # contaminated by its text, and without a letter
    assert any(i == 501 for i, _ in kept) or any(i is None for i, _ in kept) or len(kept) > 20
