"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors has a codebook; a cell of the index is a pair of centroids. A query takes the pairs in the order of the summed
distances of its halves, from a heap. It stops when the cells that it took are expected to hold enough of its k nearest entries, and ranks
these cells' entries by the exact inner product. What is expected comes from the cells' counts and how widely entries spread around
their centroids; how much is enough is found on the sample's own neighbours.
Cells are of lengthened vectors, whose distances have the order of the inner products: entries get a last component that gives
all of them the norm of the longest, queries a zero.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import discard, finite_vector, stage
from lumenflow.llm.vectors import matrix

#: Codebooks are fitted on at most SAMPLE rows (the first by a hash of vec_id), and TRIALS of them are asked to find how much is enough; every
#: row is indexed. Entries and queries of a block; cells of the histogram of a query's expectations.
SAMPLE, TRIALS, ENTRIES, QUERIES, BINS = 16_384, 256, 8_192, 1_024, 1_024


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's rounds from seeded rows; an empty cluster takes a row far from its centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        d = (centres**2).sum(1) - 2 * x @ centres.T
        own = d.argmin(1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        far = np.argsort(-(d[np.arange(len(x)), own] + (x**2).sum(1)))
        for n, c in enumerate(np.flatnonzero(counts == 0)):
            sums[c], counts[c] = x[far[n % len(far)]], 1
        centres = sums / counts[:, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def lengthened(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """x with one more column: what entries lack to the norm longest; queries have 0 there and get that norm."""
    if query:
        x = x / np.abs(x).max(1, initial=0)[:, None]
        return np.c_[x / np.sqrt((x**2).sum(1))[:, None] * longest, np.zeros(len(x))]
    return np.c_[x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))]


def above(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution that lies z deviations or more above its mean, to a few hundredths of it."""
    tail = 0.5 * np.exp(-0.717 * np.abs(z) - 0.416 * z * z)
    return np.where(z >= 0, tail, 1 - tail)


class Expectation:
    """How many of a query's k nearest entries each cell is expected to hold.

    An entry's inner product with a query is taken to be normal around the centroids' own, with the variance that the sample's residuals
    have in the query's direction.
    """

    def __init__(self, books: tuple[np.ndarray, np.ndarray], residuals: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int):
        self.books, self.spread, self.counts, self.k = books, [r.T @ r / max(1, len(r)) for r in residuals], counts, k

    def cells(self, q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
        """For the halves of one query, each cell's expected number divided by k; they add up to 1 (to less, if there are fewer than k entries)."""
        product = (self.books[0] @ q1)[:, None] + (self.books[1] @ q2)[None, :]
        sd = max(float(np.sqrt(max(0.0, q1 @ self.spread[0] @ q1 + q2 @ self.spread[1] @ q2))), 1e-12 * (1 + float(np.abs(product).max())))
        full = self.counts > 0
        low, high = float(product[full].min()), float(product[full].max())
        step = max((high - low) / BINS, 1e-300)
        bins = np.minimum(((product - low) / step).astype(np.int64), BINS - 1)
        held = np.bincount(bins[full], self.counts[full], BINS)
        middle, lo, hi = low + (np.arange(BINS) + 0.5) * step, low - 8 * sd, high + 8 * sd
        for _ in range(40):  # the inner product that k entries are expected to exceed
            cut = (lo + hi) / 2
            if (held * above((cut - middle) / sd)).sum() > self.k:
                lo = cut
            else:
                hi = cut
        return np.where(full, self.counts * above((cut - product) / sd), 0) / self.k


def traverse(d1: np.ndarray, d2: np.ndarray, expected: np.ndarray, enough: float, counts: np.ndarray, entries: int) -> tuple[np.ndarray, float]:
    """The cells that a query takes, pairs by rising d1 + d2 until what is expected in them adds up to enough and they hold some entries; and the last one's sum.

    Pairs of that same sum are taken too, so the cells are exactly those whose sum isn't greater.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    taken, held, size, last, heap, pushed = np.zeros(expected.shape, bool), 0.0, 0, -np.inf, [(s1[0] + s2[0], 0, 0)], {(0, 0)}
    while heap and (held < enough or size < entries or heap[0][0] <= last):
        last, i, j = heapq.heappop(heap)
        taken[o1[i], o2[j]] = True
        held += expected[o1[i], o2[j]]
        size += counts[o1[i], o2[j]]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(s1) and b < len(s2) and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(heap, (s1[a] + s2[b], a, b))
    return taken, last


def enough_for(expectation: Expectation, entries: np.ndarray, cell: np.ndarray, queries: np.ndarray, half: int, wanted: float) -> float:
    """What a query's cells must be expected to hold so that they hold the wanted share of its neighbours: tried on queries (the first rows of entries)."""
    need = []
    for i, q in enumerate(queries):
        near = entries @ q
        near[i] = -np.inf
        top = np.argpartition(-near, min(expectation.k, len(near) - 1) - 1)[: min(expectation.k, len(near) - 1)]
        d = (distances(q[None, :half], expectation.books[0])[0][:, None] + distances(q[None, half:], expectation.books[1])[0][None, :]).ravel()
        order = np.argsort(d, kind="stable")
        reach = np.empty(len(order))
        reach[order] = np.cumsum(expectation.cells(q[:half], q[half:]).ravel()[order])
        need.append(reach[cell[top]])
    return float(np.quantile(np.concatenate(need), wanted)) if need and len(entries) > 1 else np.inf


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each cell its first block and how many blocks share it: neighbouring small cells share one, a large cell has several."""
    first, parts, block, room = np.zeros(counts.size, np.int64), np.ones(counts.size, np.int64), 0, ENTRIES
    for cell, n in enumerate(counts.ravel()):
        if n > ENTRIES:
            block += room < ENTRIES
            parts[cell] = -(-n // ENTRIES)
            first[cell], block, room = block, block + parts[cell], ENTRIES
            continue
        if n > room:
            block, room = block + 1, ENTRIES
        first[cell], room = block, room - n
    return first, parts, int(block + 1)


def search(vectors: DataFrame, every: int = 20, k: int = 20, wanted: float = 0.97, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id divisible by every), by inner product.

    wanted: the share of the nearest that a query should find, as tried on the sample; 1 takes every cell, which is exact.
    There is no bound on a query's cells or candidates but the expectation, at every size of the table. Vectors that are null, zero or hold
    null or non-finite components and rows with a null vec_id take no part; shorter vectors are filled up with zeros. Of rows that share a
    query's vec_id the smallest vector asks, and none of them is its candidate. Repeated rows are found each. Ties go to the smaller vec_id. Too few
    rows give shorter lists, an empty table none. Other columns aren't read.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(finite_vector(F.col("embedding")) & F.col("vec_id").isNotNull())
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n, dims, longest = rows.agg(F.count("*"), F.max(F.size("embedding")), F.sqrt(F.max(square))).first()
    if not n:
        return spark.createDataFrame([], out)
    half = max(1, dims // 2)
    size = int(np.clip(4 * n**0.25, 2, 256))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    plain = matrix(sample, dims)
    x = lengthened(plain, longest)
    books = codebook(x[:, :half], size, seed), codebook(x[:, half:], size, seed + 1)

    def cells_of(long: np.ndarray) -> np.ndarray:
        return distances(long[:, :half], books[0]).argmin(1) * size + distances(long[:, half:], books[1]).argmin(1)

    own = cells_of(x)
    residuals = x[:, :half] - books[0][own // size], x[:, half:] - books[1][own % size]
    tried = Expectation(books, residuals, np.bincount(own, minlength=size * size).reshape(size, size), k)
    enough = enough_for(tried, x, own, lengthened(plain[:TRIALS], longest, query=True), half, wanted) if wanted < 1 else np.inf

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dims)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells_of(lengthened(x, longest)).astype(np.int64)), "vec_id": b.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    index = stage(rows.mapInArrow(assign, "cell long, vec_id long, x binary"), "index")
    counts = np.zeros(size * size, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most 256 * 256 cells
        counts[r.cell] = r["count"]
    first, parts, blocks = _layout(counts)
    expectation = Expectation(books, residuals, counts.reshape(size, size), k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            yield pa.RecordBatch.from_pydict({"block": pa.array(first[cell] + (spread % parts[cell].astype(np.uint64)).astype(np.int64)), "cell": b.column(0), "vec_id": b.column(1), "x": b.column(2)})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dims)
            long = lengthened(x, longest, query=True)
            d1, d2 = distances(long[:, :half], books[0]), distances(long[:, half:], books[1])
            got: dict[str, list] = {"block": [], "query_id": [], "x": [], "last": []}
            for i, q in enumerate(b.column(0).to_pylist()):
                taken, last = traverse(d1[i], d2[i], expectation.cells(long[i, :half], long[i, half:]), enough, expectation.counts, k + 1)
                hit = np.flatnonzero(taken.ravel() & (counts > 0))
                touched = np.zeros(blocks, bool)
                touched[first[hit]] = True
                for c in hit[parts[hit] > 1]:
                    touched[first[c] : first[c] + parts[c]] = True
                for block in np.flatnonzero(touched).tolist():
                    for name, value in zip(got, (block, q, x[i].tobytes(), last)):
                        got[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(got["block"], pa.int64()), pa.array(got["query_id"], pa.int64()), pa.array(got["x"], pa.binary()), pa.array(got["last"], pa.float64())], names=list(got))

    def pack(name: str, extra: str):
        def run(t: pa.Table) -> pa.Table:
            return pa.table({"block": t["block"].slice(0, 1), "ids": [t[name].to_numpy().tobytes()], "x": [b"".join(t["x"].to_pylist())], "more": [t[extra].to_numpy().tobytes()]}, pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("more", pa.binary())]))

        return run

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qs, qx, last, ids, ex, cells = (batch.column(c)[i].as_py() for c in range(6))
                qs, ids, cells, last = np.frombuffer(qs, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(cells, np.int64), np.frombuffer(last)
                qx, ex = np.frombuffer(qx).reshape(-1, dims), np.frombuffer(ex).reshape(-1, dims)
                query, vec, score = [], [], []
                for s in range(0, len(qs), 256):
                    long = lengthened(qx[s : s + 256], longest, query=True)
                    d1, d2 = distances(long[:, :half], books[0]), distances(long[:, half:], books[1])
                    taken = d1[:, cells // size] + d2[:, cells % size] <= last[s : s + 256, None] * (1 + 1e-12) + 1e-300
                    near = qx[s : s + 256] @ ex.T
                    near[~taken | (qs[s : s + 256][:, None] == ids)] = -np.inf
                    for r, row in enumerate(near):
                        cut = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        some = np.flatnonzero((row >= cut - 1e-9 * (1 + abs(cut))) & (row > -np.inf)) if cut > -np.inf else np.flatnonzero(row > -np.inf)
                        exact = (ex[some] * qx[s + r]).sum(1)  # summed alike for equal vectors, unlike the blocked product
                        some_best = best(ids[some], exact, k)
                        query += [qs[s + r]] * len(some_best)
                        vec += ids[some][some_best].tolist()
                        score += exact[some_best].tolist()
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    packed = "block long, ids binary, x binary, more binary"
    entries = index.mapInArrow(place, "block long, cell long, vec_id long, x binary").groupBy("block").applyInArrow(pack("vec_id", "cell"), packed)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    groups = max(1, -(-n // every // QUERIES))
    asked = asked.repartition(min(10_000, max(24, 4 * groups)))  # a query's way through the cells costs far more than its bytes tell
    asked = asked.mapInArrow(ask, "block long, query_id long, x binary, last double").withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    queries = asked.groupBy("block", "g").applyInArrow(pack("query_id", "last"), packed)
    both = queries.toDF("block", "qs", "qx", "last").join(entries, "block").repartition(max(24, min(blocks * groups, 10_000)))
    found = both.select("qs", "qx", "last", "ids", "x", "more").mapInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
