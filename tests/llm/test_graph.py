import random

from zscape.llm.graph import connected_components


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 380)] + [(400, 400), (None, 3), (5, None)]
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    want = {x: root(x) for x in label}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_no_edges_and_text_nodes(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    got = connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "a")], "src string, dst string")).collect()
    assert {tuple(r) for r in got} == {("a", "a"), ("b", "a"), ("c", "a")}
