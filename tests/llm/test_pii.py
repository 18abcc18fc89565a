import hashlib
import random
import re

from zscape.llm import pii as P

from .helpers import documents


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 16 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


PARTS = ["a", "b.c", "@", "@", ".", "com", "1", "23", "255", "256", ".", "-", " ", "+", "+1", "(555)", "4532015112830366", "4111 1111 1111 1111", "é", "%", "_", "\n", "0", "00", "1.2.3.4"]


def test_base_is_the_patterns():
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16)))
        assert P.base(text) == brute(text), text


def people(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        found = [f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"n{i}.{rng.randint(1, 99)}@mail{i % 9}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), "4532015112830366", f"pass{rng.randint(1, 9**9)}", f"v{i}."]
        out.append((i, f"some words {rng.choice(found)} and then {rng.choice(found)} end"))
    return out


def test_field_learns_the_base_and_goes_beyond():
    m = P.fit([x for _, t in people(200) for x in P.examples(t)])
    same = total = 0
    for _, t in people(200, 9):
        own = P.base(t)
        same += len(set(own) & set(m.decode(t)))
        total += len(own)
    assert same / total > 0.95
    assert ("phone", 5, 19) in m.decode("call (212) 555-0186 now") and m.decode("plain words only") == []
    assert all(b - a <= 200 for _, a, b in m.decode("1 " * 2000))


def features(text, start, stop, tokens):
    """What ``Tokens`` computes for all candidates at once, for one of them and word for word."""
    x, before, after, digits = text[start:stop], text[start - 1 : start], text[stop : stop + 1], re.sub("[^0-9]", "", text[start:stop])
    n, letters = len(digits), any(c.isalpha() for c in x)
    ip = not letters and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", x) is not None
    said = {
        0: True, 1: re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x) is not None, 2: letters, 3: ip, 4: ip and all(int(p) < 256 for p in x.split(".")), 5: x[0] == "+",
        6: 16 <= n <= 19 and not letters and P.luhn(digits), 7: n == 0, 8: 1 <= n <= 3, 9: 4 <= n <= 7, 10: 8 <= n <= 9, 11: 10 <= n <= 11, 12: 12 <= n <= 15, 13: 16 <= n <= 19, 14: n > 19,
        15: "(" in x, 16: "-" in x, 17: " " in x, 18: "." in x, 19: any(not c.isalnum() and c not in "+()-. @" for c in x),
        20: before.isalnum() and x[0].isalnum(), 21: after.isalnum(), 22: before != "" and not before.isalnum() and not before.isspace(), 23: x[-1] in "0123456789", 24: tokens == 1, 25: 1 < tokens < 6,
        26: "(" in x and "-" in x and not letters, 27: after != "" and not after.isalnum() and not after.isspace() and text[stop + 1 : stop + 2].isalnum(),
    }
    return {k for k, v in said.items() if v}


def candidates(text):
    out = {}
    for start, stop in P.islands(text):
        cuts = [m.start() for m in re.compile("[0-9]+|[A-Za-z]+|[^0-9A-Za-z]").finditer(text, start, stop)] + [stop]
        for i in range(len(cuts) - 1):
            for j in range(i + 1, min(len(cuts), i + P.TOKENS + 1)):
                x = text[cuts[i] : cuts[j]]
                if (x[0].isalnum() or x[0] in "+(") and re.search("[0-9@]", x) and x[-1].isalnum():
                    out[cuts[i], cuts[j]] = features(text, cuts[i], cuts[j], j - i)
    return out


def test_candidates_and_features_are_those_of_the_definition(monkeypatch):
    rng = random.Random(6)
    for window in (3, 2048):
        monkeypatch.setattr(P, "WINDOW", window)
        for _ in range(120):
            texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4)]
            t = P.Tokens(texts)
            got = [{} for _ in texts]
            for i, j, x in t.windows():
                for a, b, row in zip(i.tolist(), j.tolist(), x):
                    n = t.island(a)
                    got[t.text[n]][int(t.cuts[a] + t.shift[n]), int(t.cuts[b] + t.shift[n])] = {k for k, v in enumerate(row) if v}
            assert got == [candidates(x) for x in texts], texts


def test_decoding_is_the_best_segmentation(monkeypatch):
    m = P.fit([x for _, t in people(120) for x in P.examples(t)])
    rng = random.Random(7)
    for text in ["+1 (212) 555-0186 4532015112830366", *("".join(rng.choice(PARTS) for _ in range(14)) for _ in range(60))]:
        score = {s: max(sum(w[x] for x in f) for w in m.weights) for s, f in candidates(text).items()}
        ends = sorted({0, len(text), *(e for s in score for e in s)})
        best = {0: 0.0}
        for before, e in zip(ends, ends[1:]):
            best[e] = max([best[before], *(best[a] + v for (a, b), v in score.items() if b == e)])
        for window in (4, 2048):
            monkeypatch.setattr(P, "WINDOW", window)
            found = m.decode(text)
            assert abs(sum(score[a, b] for _, a, b in found) - best[len(text)]) < 1e-6
            assert all(x[2] <= y[1] for x, y in zip(found, found[1:]))
        assert m.decode_all([text, "x", text]) == [found, [], found]


def test_added_spans_overlap_none_of_their_kind():
    own = [("card", 5, 9), ("card", 12, 20), ("phone", 0, 3)]
    spans = [("card", 0, 5), ("card", 0, 6), ("card", 8, 12), ("card", 9, 12), ("card", 13, 14), ("card", 20, 22), ("phone", 5, 9), ("ip", 0, 30)]
    slow = [s for s in spans if not any(o[0] == s[0] and o[1] < s[2] and s[1] < o[2] for o in own)]
    assert P.without_overlaps(spans, own) == slow


def test_an_island_of_two_million_characters():
    import time
    import tracemalloc

    m = P.fit([x for _, t in people(120) for x in P.examples(t)])
    text = "0,1,2,+1 (212) 555-0186," * (2_000_000 // 24)
    began = time.perf_counter()
    found = m.decode(text)
    assert len(found) > 10_000 and time.perf_counter() - began < 120
    tracemalloc.start()
    m.decode(text[:100_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert len(P.without_overlaps(found, P.base(text))) <= len(found)


def test_query(spark):
    rows = [*people(60), (100, None), (101, ""), (102, "é x@y.zz"), (102, "é x@y.zz"), (103, "word " * 50000 + "a@b.cc"), (104, "9" * 20000), (None, "8.8.8.8")]
    docs = documents(spark, rows)
    out = P.find(docs, P.train(docs)).collect()
    assert len(out) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for r in out:
        own = brute(by[r["doc_id"]] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in own) for k in P.KINDS]
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))
    assert P.train(docs.where("false")) is None and P.find(docs.where("false"), None).count() == 0
