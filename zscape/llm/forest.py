"""MinHash near-duplicates by an LSH forest.

A document's set has its distinct shingles of four words (fewer words: the whole sequence as one; none:
empty, and linked with nothing); words stand between the ASCII white space characters of the text with
A-Z lower-cased. Documents are linked if 100 times their sets' intersection is at least 80 times the union.

Equal sets are one node. A node's signature has ``HASHES`` minima, and the forest has ``TREES`` sorted
orders of the nodes: order t reads the signature from its own place on and round, so its first ``DEPTH``
minima, which part the order in regions, are its own. Within a region the neighbours in the order are those
with the longest common prefix, and these are the candidates. How far a node looks, and so how short a
prefix may be, depends on the region: the first rounds take nearest neighbours only, in a few orders and then
in all; a region whose nodes are one component by then is done, and the others are looked through wholly. A
dense group of copies is thus joined by its deepest neighbours with a few comparisons a node, while no
pair of a region that could still join components is left out. A whole region's task has its texts: it confirms
pairs itself, each in the first of the orders that have it, and returns a spanning forest of the links.

Candidates whose signatures agree in ``LEAST`` minima are confirmed on their full sets, built again from the
texts. A pair at the threshold is missed if it shares no region, or agrees in too few minima: less than one in
a hundred thousand (0.8 ** 4 is 0.41, missed by 32 orders with 5e-8; 80 of 128 with less than 1e-5).

Regions above ``GROUP`` nodes, or ``SHINGLES`` shingles in all, are cut in parts by a hash: at first each part
is looked through alone, and where components still differ the parts meet pairwise, so no task holds more than
two. Sets are compared by 64-bit hashes of their shingles.

A null id takes part in no minimum, and a component without any id has a null id. Rows that repeat an id with other
texts are documents of their own; repeated rows get equal results; null texts have no words. An empty
table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import evenly_joined, pieces, written
from .graph import connected_components

SHINGLE = 4
#: A link has at least ``OVER`` hundredths of the union in the intersection.
OVER = 80
HASHES, DEPTH = 128, 4
TREES = HASHES // DEPTH
LEAST = 80
#: Most nodes of a part of a region and shingles of their sets, about, and values of a signature by which an order is sorted.
GROUP, SHINGLES, SORTED = 2048, 1 << 22, 16
#: Rounds before whole regions: orders that are looked at, and neighbours on each side.
ROUNDS = ((4, 1), (TREES, 2))

_RNG = np.random.default_rng(11)
_FACTORS, _SHIFTS = _RNG.integers(0, 1 << 63, (2, HASHES), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        return _mixed((w * _PLACES[: len(w)]).sum(keepdims=True) + np.array([len(w)], np.uint64) * _MIX)
    n = len(w) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += w[k : k + n] * _PLACES[k]
    return np.unique(_mixed(total))


def signature(own: np.ndarray) -> np.ndarray:
    """16 bits of each of the minima of a set that isn't empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (np.multiply.outer(_FACTORS, own[at : at + 1024]) + _SHIFTS[:, None]).min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype("<u2")


def alike(a: np.ndarray, b: np.ndarray, over: int = OVER) -> bool:
    """Whether two sets are linked."""
    if 100 * min(len(a), len(b)) < over * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= over * (len(a) + len(b) - both)


def marks(docs: DataFrame) -> DataFrame:
    """``doc_id, place, n_shingles, own, sig`` of every row; ``place`` names the text, ``own`` the set."""

    def run(batches):
        for b in pieces(batches):
            n, name, sig = [], [], []
            for t in b.column("text").to_pylist():
                own = shingles(t)
                n.append(len(own))
                name.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sig.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "place", "n_shingles", "own", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _place().alias("place"), "text").mapInArrow(run, f"doc_id {kind}, place binary, n_shingles long, own binary, sig binary")


def _place():
    return F.unhex(F.md5("text"))


def members(nodes: DataFrame) -> DataFrame:
    """``region, tree, node, parts``: the nodes of each order's regions that have several, and the region's parts."""
    keys = [F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sig", 2 * DEPTH * t + 1, 2 * DEPTH)).alias("region")) for t in range(TREES)]
    rows = nodes.select("node", "n_shingles", F.explode(F.array(*keys)).alias("k")).select("node", "n_shingles", "k.tree", "k.region")
    parts = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n_shingles") / SHINGLES)).cast("int")
    crowded = written(rows.groupBy("region").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1"), "regions")
    return evenly_joined(rows.drop("n_shingles"), crowded.drop("n"), "region", crowded.select("region", "n"), F.xxhash64("node"))


def _by_key(batches):
    """Of rows sorted by key, the table of each key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column("key").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            if held and held[-1].column("key")[0].as_py() != keys[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)


def _meeting(label: np.ndarray, side: np.ndarray, step: int) -> np.ndarray:
    """The rows that may be joined to that ``step`` after them."""
    return np.flatnonzero((label[:-step] != label[step:]) & ((side[:-step] == 0) | (side[:-step] != side[step:])))


def _neighbours(window: int):
    """Pairs of near neighbours in the order of each key that may join components."""

    def run(batches):
        for table in _by_key(batches):
            node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
            sig = _signatures(table)
            turned = np.roll(sig, -DEPTH * table.column("tree")[0].as_py(), axis=1)[:, :SORTED]
            order = np.lexsort((node, *turned.T[::-1]))
            node, label, side, sig = node[order], label[order], side[order], sig[order]
            for step in range(1, min(len(node), window + 1)):
                i = _meeting(label, side, step)
                i = i[(sig[i] == sig[i + step]).sum(axis=1) >= LEAST]
                x, y = node[i], node[i + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _whole(batches):
    """Confirmed links that join components, as a spanning forest of each key's rows."""
    for table in _by_key(batches):
        node, label, side = (table.column(c).to_numpy().copy() for c in ("node", "label", "side"))
        tree, sig, texts = table.column("tree")[0].as_py(), _signatures(table), table.column("text")
        sets: dict[int, np.ndarray] = {}
        links = []
        for step in range(1, len(node)):
            i = _meeting(label, side, step)
            same = sig[i] == sig[i + step]
            i, same = i[ok := same.sum(axis=1) >= LEAST], same[ok]
            i = i[same.reshape(-1, TREES, DEPTH).all(axis=2).argmax(axis=1) == tree]  # the first order that has the pair
            for x in i.tolist():
                y = x + step
                if label[x] == label[y]:
                    continue
                for k in (x, y):
                    if k not in sets:
                        sets[k] = shingles(texts[k].as_py())
                if alike(sets[x], sets[y]):
                    links.append((int(node[x]), int(node[y])))
                    label[label == label[y]] = label[x]
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def dealt(rows: DataFrame, meet: bool) -> DataFrame:
    """``key, tree, node, label, side`` of ``rows(region, tree, node, parts, label)``: what one task sees together.

    Parts of large regions ``meet`` pairwise, or stay each for itself.
    """
    part = F.pmod(F.xxhash64("node", "tree"), F.col("parts")).cast("int")
    alone = F.array(F.struct(part.alias("i"), part.alias("j"), F.lit(0).alias("side")))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(part, o).alias("i"), F.greatest(part, o).alias("j"), F.when(part == o, 0).when(part < o, 1).otherwise(2).alias("side")))
    out = rows.withColumn("p", F.explode(others if meet else alone))
    return out.select(F.xxhash64("region", "p.i", "p.j").alias("key"), "tree", "node", "label", F.col("p.side").alias("side"))


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` those that are linked; ``texts`` has ``node, text``.

    A node's text meets those of its partners in one task, which holds one set and streams the others.
    """

    def run(batches):
        held = own = None
        for b in pieces(batches):
            found = []
            for a, other, text in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text").to_pylist()):
                if other is None:
                    held, own = a, shingles(text)
                elif a == held and alike(own, shingles(text)):
                    found.append((a, other))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    ones = texts.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    others = pairs.join(texts.withColumnRenamed("node", "b"), "b").select("a", "b", "text")
    return ones.union(others).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links(a, b)`` have joined components."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("src")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("dst")), "b")
    merged = connected_components(ends.select("src", "dst")).withColumnRenamed("node", "label")
    return written(labels.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("label")), "labels")


def linked(nodes: DataFrame, texts_of) -> DataFrame:
    """``node, label`` of the nodes that have company in some region: label is one node of the component.

    ``nodes`` has ``node, n_shingles, sig``; ``texts_of`` gives ``node, text`` for a table of nodes.
    """
    rows = written(members(nodes), "members")
    some = written(rows.select("node").distinct(), "candidates")
    texts = written(texts_of(some), "texts")
    signatures = written(nodes.select("node", "sig").join(some, "node", "left_semi"), "signatures")
    labels, tried = some.withColumn("label", F.col("node")), None

    def opened(own: DataFrame) -> DataFrame:
        """The rows of regions that have several components."""
        several = own.groupBy("region").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("region")
        return own.join(several, "region", "left_semi")

    for trees, window in ROUNDS:
        own = rows.where(F.col("tree") < trees).join(labels, "node")
        own = own if tried is None else opened(own)
        pairs = _together(dealt(own, meet=False).join(signatures, "node")).select("key", "tree", "node", "label", "side", "sig").mapInArrow(_neighbours(window), "a long, b long").distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        labels = _joined(labels, written(confirmed(pairs, texts), "links"))
    last = _together(dealt(opened(rows.join(labels, "node")), meet=True).join(signatures, "node").join(texts, "node"))
    links = last.select("key", "tree", "node", "label", "side", "sig", "text").mapInArrow(_whole, "a long, b long")
    return _joined(labels, written(links, "links"))


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``, and ``place``, which names its text.

    ``kept`` marks the document that stands for its component; without any id in it, all stay.
    """
    every = written(marks(docs), "marks")
    full = every.where("own IS NOT NULL")
    each = full.groupBy("own").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("place").alias("place"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n_shingles"))
    each = written(each.withColumn("node", F.monotonically_increasing_id()), "sets")

    def texts_of(some: DataFrame) -> DataFrame:
        """A text of each of some nodes; of a text's many copies those that share a task are one before they are sent."""
        wanted = each.join(some, "node", "left_semi").select("node", "place")
        sizes = every.groupBy("place").agg(F.count("*").alias("n"))
        found = evenly_joined(docs.select(_place().alias("place"), "text", "doc_id"), wanted, "place", sizes, F.xxhash64("doc_id"))
        return found.groupBy("node").agg(F.min("text").alias("text"))

    labels = linked(each, texts_of)
    named = each.join(labels, "node", "left").select("own", "least", "n", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    classes = evenly_joined(named, least.drop("m"), "label", least.select("label", F.col("m").alias("n")), F.xxhash64("own"))
    rows = evenly_joined(full, classes.select("own", "component_id"), "own", each.select("own", "n"), F.xxhash64("doc_id", "place"))
    alone = every.where("own IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "place"]
    return rows.select(*columns).union(alone.select(*columns))


def deduplicated(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows that stand for their component; repeated rows of the smallest id all stay."""
    gone = written(components(docs).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("place").alias("_place")).distinct(), "near-duplicates")
    kept = [F.col(c) for c in columns]
    rows = docs.select(*kept, F.col("doc_id").alias("_own"), _place().alias("_text"))
    return rows.join(gone, F.col("_own").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_place")), "left_anti").select(*columns)


ORACLE_SQL = r"""
WITH RECURSIVE
     w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
     r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM r JOIN w ON doc_id = a LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
