"""SimHash near-duplicates by a self-join of binary tries.

Words are what stands between the ASCII white space characters of the text with A-Z lower-cased;
a feature is a shingle of four words, repeats included (fewer words: the whole sequence; none: the
fingerprint is zero). A fingerprint bit is set if more than half of the shingles' XXH64 values
(seed 42) have it. Documents whose fingerprints differ in at most four bits are linked.

Finding the links: of m disjoint blocks of bits, fingerprints that differ in at most four bits agree in
at least m - 4. So each distinct fingerprint goes, once for each choice of m - 4 blocks, to the group
that has the same bits there, and a group is a trie over the other bits. m is 5, or more where groups
would be large (``blocks``): the links are the same for every m. Pairs of trie nodes are walked together from the
root: a pair of children adds one differing bit if their branches differ, and is pruned when the sum
exceeds the budget. Groups above ``GROUP`` fingerprints are cut in parts that meet pairwise in
separate tasks, so that no task holds more than two parts; no link is lost. A task returns a spanning
forest of the links it finds instead of all pairs, and connected components join the forests.

Null ids take part in no minimum; a document with a null id belongs to its fingerprint's component.
Repeated rows get equal results, null texts count as empty, an empty table gives no rows, and other
columns are never read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import broadcast_if_small, evenly_joined, pieces, written
from .graph import connected_components

SHINGLE, SEED, BITS, BUDGET = 4, 42, 64, 4
#: Most fingerprints of a group that are walked as one trie, and most node pairs held at once.
GROUP, FRONTIER = 8192, 1 << 18


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[len(words) - n :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, with_place: bool = False) -> DataFrame:
    """``doc_id, fp`` (a signed long with the fingerprint's bits), and ``place``, which names the text, if asked."""

    def run(batches):
        for b in pieces(batches):
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            own = [n for n in ("doc_id", "place") if n in b.schema.names]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in own), pa.array(fps.view(np.int64))], [*own, "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    if with_place:
        return docs.select("doc_id", _place().alias("place"), "text").mapInArrow(run, f"doc_id {kind}, place binary, fp long")
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _place():
    """What names a text in a join: null and empty texts have one fingerprint, and one name."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


class Forest:
    """Smallest-index labels of points that links join, kept as links arrive."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                return
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]


def linked(points: np.ndarray, sides: np.ndarray, roots: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each point the smallest index of those that a chain of links joins to it.

    ``points`` are fingerprints in ascending order within each root; ``roots`` rows are node pairs
    ``(a_lo, a_hi, b_lo, b_hi)`` of index ranges, a root with itself to begin with. ``sides`` tells
    parts apart: links inside part 1 or inside part 2 of a pair of parts are found elsewhere (0: all).
    """
    n = len(points)
    ones = np.zeros((BITS, n + 1), np.int32)
    for d in range(BITS):  # from the highest bit, as the points are sorted
        np.cumsum((points >> np.uint64(BITS - 1 - d)) & np.uint64(1), out=ones[d, 1:])
    forest = Forest(n)

    def finish(pairs: np.ndarray) -> None:
        """Pairs of nodes with few points: compares the points themselves."""
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        size = na * nb
        which = np.repeat(np.arange(len(pairs)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        i, j = pairs[which, 0] + k // nb[which], pairs[which, 2] + k % nb[which]
        ok = (i < j) & ((sides[i] == 0) | (sides[i] != sides[j]))
        i, j = i[ok], j[ok]
        near = np.bitwise_count(points[i] ^ points[j]) <= budget
        forest.join(i[near], j[near])

    todo = [(0, np.column_stack([roots, np.zeros(len(roots), np.int64)]))]
    while todo:
        depth, pairs = todo.pop()
        if len(pairs) > FRONTIER:
            todo += [(depth, x) for x in np.array_split(pairs, 2)]
            continue
        a_lo, a_hi, b_lo, b_hi, diff = pairs.T
        small = ((a_hi - a_lo) * (b_hi - b_lo) <= 16) | (depth == BITS)
        if small.any():
            finish(pairs[small])
            a_lo, a_hi, b_lo, b_hi, diff = pairs[~small].T
        if not len(a_lo):
            continue
        a_mid = a_hi - (ones[depth, a_hi] - ones[depth, a_lo])
        b_mid = b_hi - (ones[depth, b_hi] - ones[depth, b_lo])
        same = a_lo == b_lo
        children = [(a_lo, a_mid, b_lo, b_mid, diff), (a_mid, a_hi, b_mid, b_hi, diff), (a_lo, a_mid, b_mid, b_hi, diff + 1), (a_mid, a_hi, b_lo, b_mid, np.where(same, budget + 1, diff + 1))]
        down = np.concatenate([np.column_stack(c) for c in children])
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)]
        one = (down[:, 1] - down[:, 0] == 1) & (down[:, 3] - down[:, 2] == 1)
        down = down[~(one & (forest.label[down[:, 0]] == forest.label[down[:, 2]]))]
        if len(down):
            todo.append((depth + 1, down))
    return forest.label


def _forests(batches):
    """Of rows sorted by key and fingerprint: the links of each key's trie, as a spanning forest."""

    def links(table: pa.Table):
        keys, sides = table.column("key").to_numpy(), table.column("side").to_numpy().astype(np.int8)
        fps = table.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((fps, keys))
        keys, sides, fps = keys[order], sides[order], fps[order]
        edge = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        stop = np.append(edge[1:], len(keys))
        many = stop - edge > 1
        label = linked(fps, sides, np.column_stack([edge, stop, edge, stop])[many])
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fps[own].view(np.int64)), pa.array(fps[label[own]].view(np.int64))], ["src", "dst"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        while b.num_rows:
            if rows >= 2 * GROUP and held:  # ends the block at the next change of the key
                last = held[-1].column("key")[-1].as_py()
                stop = int(np.searchsorted(b.column("key").to_numpy(), last, side="right"))
                held.append(b.slice(0, stop))
                rows += stop
                b = b.slice(stop)
                if b.num_rows:
                    yield links(pa.Table.from_batches(held))
                    held, rows = [], 0
            else:
                held.append(b)
                rows += b.num_rows
                b = b.slice(b.num_rows)
    if rows:
        yield links(pa.Table.from_batches(held))


def blocks(n: int) -> list[int]:
    """Masks of the bits in which a group agrees: each choice of m - 4 out of m blocks.

    ``n`` fingerprints of independent bits make groups of 1024 on average at most, up to m = 8.
    """
    for m in range(BUDGET + 1, 9):
        ends = [BITS * i // m for i in range(m + 1)]
        parts = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
        if n >> (BITS * (m - BUDGET) // m) <= 1024:
            break
    return [sum(c) for c in combinations(parts, m - BUDGET)]


def links(fps: DataFrame) -> DataFrame:
    """``src, dst``: links between distinct fingerprints whose components are those of all links."""
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in blocks(fps.count())]
    groups = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(m)) for i, m in enumerate(signed)])
    rows = fps.select("fp", F.explode(groups).alias("group"))
    large = rows.groupBy("group").count().where(F.col("count") > GROUP).select("group", F.ceil(F.col("count") / GROUP).cast("int").alias("parts"))
    rows = rows.join(large, "group", "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    with_others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(part, o).alias("i"), F.greatest(part, o).alias("j"), F.when(part == o, 0).when(part < o, 1).otherwise(2).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    dealt = rows.select("fp", "group", "parts", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(with_others)).alias("p"))
    dealt = dealt.select("fp", F.when(F.col("parts").isNull(), F.col("group")).otherwise(F.xxhash64("group", "p.i", "p.j")).alias("key"), F.col("p.side").alias("side"))
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_forests, "src long, dst long")


def components(docs: DataFrame, with_place: bool = False) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``, and ``place``, which names its text, if asked."""
    own = ["doc_id", "place"] if with_place else ["doc_id"]
    fps = written(fingerprints(docs, with_place), "fingerprints")
    each = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = connected_components(links(each.select("fp")))
    named = each.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    classes = evenly_joined(named, least.drop("n"), "component", least.select("component", "n"), F.xxhash64("fp"), rows=each.count())
    rows = evenly_joined(fps, classes.select("fp", "component_id"), "fp", each.select("fp", "n"), F.xxhash64(*own))
    return rows.select(*own, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the document of each component that has the smallest id.

    A row is dropped by its id and its text together: of rows that repeat an id, each is judged by its own
    text. Rows that repeat the smallest id within its component all stay, as nothing tells which of them to
    keep, and so do rows without an id, which no decision names.
    """
    found = components(docs, with_place=True).where("doc_id <> component_id")
    dropped = written(found.select(F.col("doc_id").alias("_id"), F.col("place").alias("_place")).distinct(), "near-duplicates")
    rows = docs.select(*columns, F.col("doc_id").alias("_own"), _place().alias("_text"))
    small = broadcast_if_small(dropped, dropped.count(), 48)
    return rows.join(small, (F.col("_own") == F.col("_id")) & (F.col("_text") == F.col("_place")), "left_anti").select(*columns)
