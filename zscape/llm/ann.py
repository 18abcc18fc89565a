"""Approximate nearest neighbours with an inverted multi-index.

A vector is cut in two halves, each quantised by its own codebook (k-means on a bounded sample); the
pair of centroids is its cell, and every vector is in the index. A query sorts each half's centroids
by distance and walks the occupied centroid pairs in the order of the summed distance with a heap,
until the cells it has passed hold ``reach`` vectors; all of these are then ranked by their exact
distance.

``reach`` is measured, not guessed: for a bounded sample of queries the true neighbours are found
among all vectors, and ``reach`` is what the walk needs to meet ``recall`` of them. So data with
clusters need few cells, and data without structure many, at the recall asked for either way.

How the work is dealt out: the cells of neighbouring first-half centroids make a bucket of about
``rows`` vectors, and a centroid with more has several. A query goes once to each bucket that its walk
enters, with the sum at which it ended; a task holds one bucket's vectors and streams the queries
through. The vectors are copied only where a bucket meets so many queries that ``PAIRS`` distances
would not do for one task, so the copies stay small beside the distances to compute.

Vectors that are null, empty, zero or hold a null or a number that isn't finite take no part, nor do
rows without an id or of another length than most vectors have (ties: the shorter). A query's own id
is no candidate of it, in none of the rows that repeat it. An id is one query: of several vectors under
it the smallest (number by number) is asked for. Ties in distance go to the smaller id; repeated rows
are candidates each; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, share_of_hash, written

#: Most vectors (and numbers in them) that codebooks are fitted on; most queries that ``reach`` is measured on.
FIT_ROWS, FIT_NUMBERS, MEASURED = 8192, 1 << 22, 128
#: Most centroids of a half; numbers in a bucket, vectors in a small one, and distances for a task, about.
CENTROIDS, BUCKET_NUMBERS, BUCKET_ROWS, PAIRS = 1024, 1 << 24, 1024, 10**10
#: Vectors of a cell, if they were spread evenly: a step of the heap costs about as much as this many distances.
CELL = 4
#: Queries that are compared with a bucket at once, and pieces of a bucket.
QUERIES, PIECE = 64, 8192


@dataclass
class Index:
    """Codebooks and occupied cells: from ``starts[i]`` on, the cells of first-half centroid ``i``, by second half.

    ``second_of`` has a cell's second-half centroid, ``held`` its number of vectors.
    """

    first: np.ndarray
    second: np.ndarray
    starts: np.ndarray | None = None
    second_of: np.ndarray | None = None
    held: np.ndarray | None = None
    reach: int = 0

    def occupy(self, i: np.ndarray, j: np.ndarray, held: np.ndarray) -> None:
        order = np.lexsort((j, i))
        self.starts = np.searchsorted(i[order], np.arange(len(self.first) + 1))
        self.second_of, self.held = j[order], held[order]

    def of_first(self) -> np.ndarray:
        """The vectors of each first-half centroid."""
        return np.diff(np.concatenate([[0], self.held.cumsum()])[self.starts])

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of one vector to the centroids of each half, the same wherever they are computed."""
        cut = self.first.shape[1]
        return ((self.first - q[:cut]) ** 2).sum(1), ((self.second - q[cut:]) ** 2).sum(1)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        nearest = lambda half, book: ((book**2).sum(1) - 2 * half @ book.T).argmin(1)
        return nearest(x[:, :cut], self.first), nearest(x[:, cut:], self.second)

    def walk(self, a: np.ndarray, b: np.ndarray):
        """Occupied cells in the order of ``a[i] + b[j]``: ``i, j, sum``, and the vectors in those before.

        The heap has the next cell of each first-half centroid that the walk has come to, along its occupied
        second halves. A centroid is opened only when the least sum that it could have is due, so the work is
        that of the centroids and cells passed, not of the index.
        """
        order = np.argsort(a, kind="stable")
        order = order[self.starts[order] < self.starts[order + 1]]
        least, order = (a[order] + b.min()).tolist(), order.tolist()
        heap: list[tuple] = []
        opened = passed = 0
        while heap or opened < len(order):
            while opened < len(order) and (not heap or least[opened] <= heap[0][0]):
                i = order[opened]
                own = slice(self.starts[i], self.starts[i + 1])
                near = np.argsort(b[self.second_of[own]], kind="stable")
                second = self.second_of[own][near]
                sums = (a[i] + b[second]).tolist()
                heapq.heappush(heap, (sums[0], i, 0, sums, second.tolist(), self.held[own][near].tolist()))
                opened += 1
            total, i, at, sums, second, held = heap[0]
            yield i, second[at], total, passed
            passed += held[at]
            if at + 1 < len(sums):
                heapq.heapreplace(heap, (sums[at + 1], i, at + 1, sums, second, held))
            else:
                heapq.heappop(heap)

    def entered(self, a: np.ndarray, b: np.ndarray, least: int) -> tuple[float, np.ndarray]:
        """The sum at which the walk ends, and the first-half centroids whose cells it enters.

        It passes ``reach`` vectors and ``least`` (or all that there are).
        """
        seen, end = np.zeros(len(a), bool), -np.inf
        for i, _, total, passed in self.walk(a, b):
            if passed >= max(self.reach, least) and total > end:
                break
            seen[i], end = True, total
        return end, np.flatnonzero(seen)


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (floats, if the table has floats, else doubles) of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    kind = "float" if table.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(good)
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (usual["n"] if usual else 0))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means; it begins at evenly spaced rows of the sample, and centroids without rows stay."""
    book = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = ((book**2).sum(1) - 2 * x @ book.T).argmin(1)
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        book[n > 0] = total[n > 0] / n[n > 0, None]
    return book


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, inside=None):
    """``n, at, score``: for each query ``n`` its ``k`` nearest rows ``at`` of ``x``, by exact distance, then id.

    A matrix product finds all rows that may be among them; their distances are then computed as the
    root of the summed squares of double-precision differences. ``inside(n, piece)`` tells the rows of
    a piece of ``x`` that the query may have.
    """
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    queries = queries.astype(np.float64)
    for low in range(0, len(x), PIECE):
        piece = slice(low, min(len(x), low + PIECE))
        own = x[piece].astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            size, asked = (own**2).sum(1), (queries**2).sum(1)
            near = size[:, None] + asked - 2 * own @ queries.T
            slack = 1e-10 * (size.max() + asked)  # far more than what rounding can do
        near[np.isnan(near)] = -np.inf
        for n, q in enumerate(queries):
            on = ids[piece] != query_ids[n]
            if inside is not None:
                on &= inside(n, piece)
            at = np.flatnonzero(on)
            d = near[at, n]
            with np.errstate(over="ignore", invalid="ignore"):
                if len(at) > k:
                    at = at[~(d > np.partition(d, k - 1)[k - 1] + 2 * slack[n])]
                score = np.sqrt(((own[at] - q) ** 2).sum(1))
            at, score = np.append(best[n][0], at + low), np.append(best[n][1], score)
            first = np.lexsort((ids[at], score))[:k]
            best[n] = at[first], score[first]
    which = np.repeat(np.arange(len(queries)), [len(b[0]) for b in best])
    return which, np.concatenate([b[0] for b in best] or [np.zeros(0, np.int64)]), np.concatenate([b[1] for b in best] or [np.zeros(0)])


def build(rows: DataFrame, k: int, recall: float) -> tuple[Index, DataFrame] | None:
    """The index and its table ``vec_id, embedding, i, j, at``; None without vectors."""
    spark, n = rows.sparkSession, rows.count()
    if not n:
        return None
    width = len(rows.first()["embedding"])
    fit = max(1, min(FIT_ROWS, FIT_NUMBERS // width))
    order = share_of_hash(F.col("vec_id"), "codebook")
    share = rows.where(order < min(1.0, 2 * fit / n))
    sample = _matrix(share.orderBy(order, "vec_id").limit(fit).select("embedding").toArrow().column("embedding"))
    if not len(sample):
        sample = np.array([rows.first()["embedding"]])
    sample = sample.astype(np.float64)
    cut, size = max(1, width // 2), int(np.clip(round((n / CELL) ** 0.5), 1, min(CENTROIDS, max(1, len(sample) // 4))))
    index = Index(codebook(sample[:, :cut], size), codebook(sample[:, cut:], size) if width > cut else np.zeros((1, 0)))
    held = spark.sparkContext.broadcast(index)

    def place(batches):
        for b in batches:
            if b.num_rows:
                i, j = held.value.cells(_matrix(b.column("embedding")).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["vec_id", "embedding", "i", "j"])

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"vec_id long, embedding {kind}, i int, j int")
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "index")
    cells = placed.groupBy("i", "j").count().toArrow()  # a row for each occupied cell, CENTROIDS squared at most
    index.occupy(*(cells.column(c).to_numpy() for c in ("i", "j", "count")))

    # what the walk must pass to meet the true neighbours of some queries
    order = share_of_hash(F.col("vec_id"), "measured")
    tried = placed.where(order < min(1.0, 4 * MEASURED / n)).orderBy(order, "vec_id", "at").limit(MEASURED).select("vec_id", "embedding").toArrow()
    asked = tried.column("vec_id").to_numpy(), _matrix(tried.column("embedding")) if tried.num_rows else np.zeros((0, width))
    ask = spark.sparkContext.broadcast(asked)

    def near(batches):
        """The nearest of a partition, kept from batch to batch."""
        query_ids, queries = ask.value
        kept: dict[int, list] = {q: [] for q in range(len(queries))}
        for b in batches:
            if b.num_rows and len(queries):
                ids = b.column("vec_id").to_numpy()
                n, at, score = nearest(ids, _matrix(b.column("embedding")), query_ids, queries, k)
                found = zip(n.tolist(), score.tolist(), ids[at].tolist(), b.column("i").to_numpy()[at].tolist(), b.column("j").to_numpy()[at].tolist())
                for q, *x in found:
                    kept[q].append(x)
                kept = {q: sorted(x)[:k] for q, x in kept.items()}
        flat = [(q, *x) for q, xs in kept.items() for x in xs]
        columns = [pa.array([f[c] for f in flat], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["q", "score", "vec_id", "i", "j"])

    best = Window.partitionBy("q").orderBy("score", "vec_id")
    true = placed.mapInArrow(near, "q long, score double, vec_id long, i int, j int").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).collect()
    wanted: dict[int, dict] = {}
    for r in true:
        cells = wanted.setdefault(r["q"], {})
        cells[r["i"], r["j"]] = cells.get((r["i"], r["j"]), 0) + 1
    need = []
    for q, left in wanted.items():
        for i, j, _, passed in index.walk(*index.halves(asked[1][q].astype(np.float64))):
            need += [passed + 1] * left.pop((i, j), 0)
            if not left:
                break
    index.reach = int(np.quantile(need, recall, method="higher")) if need else n
    return index, placed


def _buckets(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each first-half centroid its first bucket and its number of buckets."""
    first, parts, bucket, held = [], [], 0, 0
    for n in counts.tolist():
        own = max(1, -(-n // rows))
        if held and (own > 1 or held + n > rows):
            bucket, held = bucket + 1, 0
        first.append(bucket)
        parts.append(own)
        bucket, held = (bucket + own, 0) if own > 1 else (bucket, held + n)
    return np.array(first), np.array(parts)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of ``rows`` for each of ``queries``.

    Both have ``vec_id`` and ``embedding`` as ``usable`` returns them.
    """
    spark = rows.sparkSession
    built = build(rows, k, recall)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, placed = built
    n, width = int(index.held.sum()), index.first.shape[1] + index.second.shape[1]
    queries = written(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    ids = queries.select(F.col("vec_id").alias("_id"))
    shared = placed.join(broadcast_if_small(ids, asked := queries.count(), 16), F.col("vec_id") == F.col("_id"), "left_semi").groupBy("vec_id").count().agg(F.max("count")).first()[0]
    least = k + (shared or 1)  # so that k rows besides those of the query's own id are found
    rows_each = int(np.clip(n // (4 * spark.sparkContext.defaultParallelism), BUCKET_ROWS, max(BUCKET_ROWS, BUCKET_NUMBERS // width)))
    first, parts = _buckets(index.of_first(), rows_each)
    total = int(first[-1] + parts[-1])
    chunks = max(1, -(-asked * rows_each // PAIRS))
    held = spark.sparkContext.broadcast((index, first, parts))

    def visits(batches):
        """Each query once for each bucket that its walk enters."""
        m, first, parts = held.value
        for b in batches:
            if not b.num_rows:
                continue
            row, bucket, end = [], [], []
            for n, x in enumerate(_matrix(b.column("embedding")).astype(np.float64)):
                limit, entered = m.entered(*m.halves(x), least)
                own = sorted({int(first[i]) + s for i in entered for s in range(parts[i])})
                row += [n] * len(own)
                bucket += own
                end += [limit] * len(own)
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(taken), b.column("embedding").take(taken), pa.array(bucket, pa.int32()), pa.array(end, pa.float64())], ["vec_id", "embedding", "bucket", "end"])

    def placing(batches):
        _, first, parts = held.value
        for b in batches:
            i, at = b.column("i").to_numpy(), b.column("at").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((first[i] + at % parts[i]).astype(np.int32))], [*b.schema.names, "bucket"])

    kind = rows.schema["embedding"].dataType.simpleString()
    x = placed.mapInArrow(placing, f"vec_id long, embedding {kind}, i int, j int, at long, bucket int").drop("at")
    x = x.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("side"), "vec_id", "embedding", "i", "j", F.lit(None).cast("double").alias("end"))
    q = queries.repartition(spark.sparkContext.defaultParallelism, "vec_id").mapInArrow(visits, f"vec_id long, embedding {kind}, bucket int, end double")
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    q = q.select("bucket", chunk.alias("chunk"), F.lit(1).alias("side"), "vec_id", "embedding", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), "end")

    def rank(batches):
        """Of rows sorted by bucket and chunk, vectors first: the nearest in the bucket of each query."""
        m = held.value[0]
        key, held_rows, bucket = None, [], None
        for b in batches:
            keys = np.column_stack([b.column(c).to_numpy() for c in ("bucket", "chunk", "side")]) if b.num_rows else np.zeros((0, 3), int)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                own = tuple(keys[low][:2])
                if own != key:
                    key, held_rows, bucket = own, [], None
                part = b.slice(low, high - low)
                if keys[low][2] == 0:
                    held_rows.append((part.column("vec_id").to_numpy(), _matrix(part.column("embedding")), part.column("i").to_numpy(), part.column("j").to_numpy()))
                elif held_rows or bucket:
                    if bucket is None:
                        bucket, held_rows = [np.concatenate(c) for c in zip(*held_rows)], []
                    ids, x, i, j = bucket
                    for at in range(0, part.num_rows, QUERIES):
                        some = part.slice(at, QUERIES)
                        query_ids, vectors, ends = some.column("vec_id").to_numpy(), _matrix(some.column("embedding")).astype(np.float64), some.column("end").to_numpy()
                        sums = [m.halves(v) for v in vectors]
                        inside = lambda n, piece: sums[n][0][i[piece]] + sums[n][1][j[piece]] <= ends[n]  # noqa: B023, E731
                        n, found, score = nearest(ids, x, query_ids, vectors, k, inside)
                        yield pa.RecordBatch.from_arrays([pa.array(query_ids[n]), pa.array(ids[found]), pa.array(score)], ["query_id", "vec_id", "score"])

    both = x.unionByName(q).withColumn("part", F.pmod(F.col("bucket") * chunks + F.col("chunk"), F.lit(min(total * chunks, 1 << 14))).cast("int"))
    dealt = both.repartitionById(min(total * chunks, 1 << 14), "part").sortWithinPartitions("bucket", "chunk", "side").drop("part")
    found = dealt.mapInArrow(rank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
