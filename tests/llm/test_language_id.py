import random
import zlib

import numpy as np

from zscape.llm import language_id as L

from .helpers import corpus, documents


def test_spectrum_is_the_set_of_ngrams():
    a, b = L.spectrum("abab"), L.spectrum("ab")
    assert len(a) == len(set(a.tolist())) and set(b.tolist()) <= set(L.spectrum("ab ab").tolist())
    assert len(L.spectrum(None)) == len(L.spectrum("")) == len(L.spectrum("12 !?")) == 0
    assert set(L.spectrum("A-b").tolist()) == set(L.spectrum("a   b").tolist())


def test_long_text_in_pieces_is_as_whole(monkeypatch):
    text = "".join("abcdefghij klmnop"[i * 7 % 17] for i in range(5000))
    whole = set(L.spectrum(text).tolist())
    monkeypatch.setattr(L, "CHUNK", 64)
    assert set(L.spectrum(text).tolist()) == whole


def test_kernel_is_shared_ngrams_over_roots():
    texts = ["hello world", "hallo welt", "bonjour"]
    spectra = [L.spectrum(t) for t in texts]
    m = L.fit(spectra, ["a", "b", "c"], landmarks=3)
    want = [[len(set(x.tolist()) & set(y.tolist())) / np.sqrt(len(x) * len(y)) for y in spectra] for x in spectra]
    assert np.allclose(m.kernel(spectra), want, atol=1e-5)


def test_held_out_accuracy_and_contract(spark):
    rows = corpus(400) + [(900, None, "en"), (901, "", None), (902, "123 !!", None), (0, corpus(1)[0][1], "en")]
    out = L.identify(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    seen = [r for r in out if r["held_out"] and r["doc_id"] < 900]
    assert len(seen) > 50 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in seen) / len(seen) > 0.97
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["doc_id"] >= 900:
            assert r["lang_pred"] == "und" and r["score"] == 0


def test_no_labels_and_no_rows(spark):
    docs = documents(spark, [(1, "some text", None), (2, None, None)])
    assert {r["lang_pred"] for r in L.identify(docs).collect()} == {"und"}
    assert L.identify(docs.where("false")).count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows = corpus(120)
    flipped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    a = {r["doc_id"]: r["lang_pred"] for r in L.identify(documents(spark, rows)).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in L.identify(documents(spark, flipped)).collect()}
    assert a == b


def test_sample_has_languages_in_equal_parts(spark, monkeypatch):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    langs = ["en"] * 1500 + ["de"] * 1300 + ["fr"] * 90 + ["xx"] * 2
    ids = [i for i in range(5000) if not held(i)][: len(langs)]
    rows = [(i, f"text {x} {chr(97 + i % 26)}", x) for i, x in zip(ids, langs)]
    rows += rows[:50] + [(9000 + i, "12 !", "fr") for i in range(400)]  # repeated rows, and rows without a letter
    taken = {}

    def fit(spectra, names, landmarks):
        taken.update({x: names.count(x) for x in names})

    monkeypatch.setattr(L, "fit", fit)
    L.train(documents(spark, rows), sample_rows=200)
    assert taken == {"en": 50, "de": 50, "fr": 50, "xx": 2}


def test_a_rare_language_is_predicted(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rare = [i for i in range(40_000, 50_000) if not held(i)][:2] + [i for i in range(50_000, 60_000) if held(i)][:1]
    rows = [(i, t, lang) for i, t, lang, _ in corpus(20_000)]
    rows += [(i, "вода под домом и люди на улице " * (k + 1), "ru") for k, i in enumerate(rare)]  # 2 of 20,000 labelled rows
    out = {r["doc_id"]: r["lang_pred"] for r in L.identify(documents(spark, rows)).collect()}
    assert [out[i] for i in rare] == ["ru"] * 3


def test_long_spectra_are_thinned_for_fitting_alone():
    ids = np.arange(0, 200_000, 3, dtype=np.int32)
    short = L.thinned(ids)
    assert len(short) == L.FITTED and set(short.tolist()) <= set(ids.tolist()) and (np.diff(short) > 0).all()
    assert L.thinned(ids[:100]) is not None and (L.thinned(ids[:100]) == ids[:100]).all()
    m = L.fit([L.spectrum("hello world"), L.spectrum("bonjour monde")], ["en", "fr"], landmarks=2)
    many = [L.spectrum(t) for t in ("hello", "bonjour", "") * 50]
    whole = m.kernel(many)
    L.ENTRIES, before = 50, L.ENTRIES
    try:
        assert np.allclose(m.kernel(many), whole)
    finally:
        L.ENTRIES = before


def test_a_text_in_all_languages_is_accepted_and_junk_is_not(spark):
    rng = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx", "dd": "acegikmo"}
    words = {x: ["".join(rng.choice(y) for _ in range(rng.randint(2, 6))) for _ in range(80)] for x, y in letters.items()}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(i, say(x := "abcd"[i % 4] * 2, rng.randint(60, 150)), x) for i in range(400)]
    rows += [(1000 + i, " ".join(say(x, 60) for x in letters), None) for i in range(20)]
    rows += [(2000 + i, "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(600)), None) for i in range(20)]
    docs = documents(spark, rows)
    accepted = {r["doc_id"] for r in L.predict(docs, L.train(docs), ["doc_id"]).where("accepted").collect()}
    assert accepted == {*range(400), *range(1000, 1020)}


def test_a_kept_text_goes_to_python_once(spark):
    docs = documents(spark, corpus(40))
    keep = ["doc_id", "text", "lang"]
    out = L.predict(docs, L.train(docs), keep)
    sent = out._jdf.queryExecution().analyzed().children().head().output()
    assert [sent.apply(i).name() for i in range(sent.size())] == keep
    with_id_alone = {r["doc_id"]: tuple(r)[1:] for r in L.predict(docs, L.train(docs), ["doc_id"]).collect()}
    assert {r["doc_id"]: tuple(r)[3:] for r in out.collect()} == with_id_alone
    assert {tuple(r)[:3] for r in out.collect()} == {tuple(r) for r in docs.select(*keep).collect()}


def test_presence_matrices_are_bounded_and_change_nothing(monkeypatch):
    spectra = [L.spectrum(t) for _, t, _, _ in corpus(60)]
    m = L.fit(spectra, [x for _, _, x, _ in corpus(60)], landmarks=12)
    whole = m.kernel(spectra)
    monkeypatch.setattr(L, "ENTRIES", 7 * len(m.landmarks))
    assert (m.kernel(spectra) == whole).all()
