import numpy as np

from zscape.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"


def vectors(spark, x, first=0, extra=()):
    rows = [(first + i, [float(v) for v in r], 1, 2.0) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def check(spark, x, table, least=0.9):
    rows = A.usable(table)
    out = A.search(rows, rows.where("vec_id % 20 = 0")).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    x = x.astype(np.float32).astype(float)
    hit = total = 0
    for q in range(0, len(x), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        got = found[q]
        assert [g[2] for g in got] == list(range(1, min(10, len(x) - 1) + 1))
        assert all(abs(s - d[i]) < 1e-9 for i, s, _ in got) and got == sorted(got, key=lambda g: (g[1], g[0]))
        hit += len({g[0] for g in got} & set(true))
        total += len(true)
    assert set(found) == set(range(0, len(x), 20)) and hit / total >= least


def test_recall_on_isotropic_and_clustered(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    check(spark, x, vectors(spark, x))
    centres = rng.normal(size=(12, 16)) * 5
    y = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.3
    check(spark, y, vectors(spark, y))


def test_many_copies_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "BUCKET_ROWS", 32)
    monkeypatch.setattr(A, "QUERIES", 4)
    monkeypatch.setattr(A, "PIECE", 50)
    monkeypatch.setattr(A, "PAIRS", 300)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[::3] = x[0]
    check(spark, x, vectors(spark, x))


def test_repeated_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    other = [(100, [float(v) for v in x[7]], 1, 2.0)]  # the query's id with another vector
    repeats = [(100, [float(v) for v in x[100]], 1, 2.0)] * 3 + [(104, [float(v) for v in x[104]], 1, 2.0)]
    for extra in (repeats, repeats + other):
        rows = A.usable(vectors(spark, x, extra=extra))
        got = [(r["vec_id"], r["score"]) for r in sorted(A.search(rows, rows.where("vec_id = 100"), recall=1.0).collect(), key=lambda r: r["rank"])]
        q = min([x[100].tolist()] + ([x[7].tolist()] if extra[-1:] == other else []))
        every = [*enumerate(x), (104, x[104])]
        want = sorted((float(np.sqrt(((v.astype(float) - q) ** 2).sum())), i) for i, v in every if i != 100)[:10]
        assert [g[0] for g in got] == [i for _, i in want] and np.allclose([g[1] for g in got], [d for d, _ in want], atol=1e-12)


def test_nearest_of_far_and_huge_vectors():
    rng = np.random.default_rng(5)
    for scale, shift in ((1, 1e6), (1e-12, 0), (1e160, 0)):
        x = rng.normal(size=(300, 6)) * scale + shift
        n, at, score = A.nearest(np.arange(300), x, np.array([5, 6]), x[5:7], 10)
        for q in (0, 1):
            with np.errstate(over="ignore"):
                d = np.sqrt(((x - x[5 + q]) ** 2).sum(1))
            want = [i for i in np.lexsort((np.arange(300), d)) if i != 5 + q][:10]
            assert at[n == q].tolist() == want and (score[n == q] == d[want]).all()


def test_unusable_rows(spark):
    x = np.eye(4)[[0, 1, 2, 3, 0]]
    bad = [(100, None, 1, 1.0), (120, [0.0] * 4, 1, 1.0), (140, [1.0, None, 0.0, 0.0], 1, 1.0), (160, [float("nan"), 1.0, 0.0, 0.0], 1, 1.0), (180, [float("inf"), 1.0, 0.0, 0.0], 1, 1.0), (200, [], 1, 1.0), (None, [1.0, 0.0, 0.0, 0.0], 1, 1.0), (220, [1.0], 1, 1.0)]
    table = vectors(spark, x, extra=bad)
    check(spark, x, table, 1.0)
    none = A.usable(table.where("vec_id >= 100"))
    assert A.search(none.where("vec_id = 1"), none.where("vec_id = 1")).count() == 0


def test_walk_is_in_order():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, (6, 5))
    index = A.Index(np.zeros((6, 1)), np.zeros((5, 1)), reach=9)
    index.occupy(*np.nonzero(counts), counts[np.nonzero(counts)])
    assert index.of_first().tolist() == counts.sum(1).tolist()
    a, b = rng.random(6), rng.random(5)
    seen = list(index.walk(a, b))
    cells = sorted((a[i] + b[j], i, j) for i, j in zip(*np.nonzero(counts)))
    assert [(s, i, j) for i, j, s, _ in seen] == cells
    before = 0
    for i, j, _, passed in seen:
        assert passed == before
        before += counts[i, j]
    end, entered = index.entered(a, b, 1)
    walked = [c for c in cells if c[0] <= end]
    assert sum(counts[i, j] for _, i, j in walked) >= 9 > sum(counts[i, j] for _, i, j in walked[:-1])
    assert sorted({i for _, i, _ in walked}) == entered.tolist()


def test_buckets_cover_every_centroid_once():
    counts = np.array([3, 0, 5, 40, 2, 9, 10, 0, 21])
    first, parts = A._buckets(counts, 10)
    spans = [(f, f + p) for f, p in zip(first, parts)]
    assert parts.tolist() == [1, 1, 1, 4, 1, 1, 1, 1, 3]
    for b in range(spans[-1][1]):
        assert sum(-(-n // p) for n, (f, e), p in zip(counts, spans, parts) if f <= b < e) <= 10


def test_walk_opens_only_the_centroids_that_are_due():
    a, b = np.arange(50.0), np.arange(40.0)
    i, j = np.divmod(np.random.default_rng(6).permutation(2000)[:900], 40)
    index = A.Index(np.zeros((50, 1)), np.zeros((40, 1)), reach=1)
    index.occupy(i, j, np.ones(900, int))
    opened = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, int):
                opened.append(at)
            return super().__getitem__(at)

    index.starts = index.starts.view(Watched)
    total = next(index.walk(a, b))[2]
    least = min(a[x] + b[y] for x, y in zip(i, j))
    assert total == least and {x for x in opened} <= set(range(int(least) + 2))
