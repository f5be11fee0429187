"""What the corpus operators share: connected components, and caches of Python workers. Staged tables are the library's own."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.sources.staging import discard, new_path, remove, shared_root, stage

__all__ = ["components", "discard", "finite_vector", "forest", "hash_filter", "in_filter", "is_empty", "new_path", "remove", "shared_root", "stage", "worker_cache"]

def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def finite_vector(c: Column) -> Column:
    """True for an array without null, NaN or infinite components that isn't all zeros."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by repeated contraction.

    edges: columns u, v (long). Returns id, component (the smallest id reachable) for every id
    that an edge names. Each round points every vertex at its first neighbour (if that comes before itself) and contracts the graph
    along these pointers. In the first two rounds the order is that of the ids, which ends stars around their smallest id at once, then a
    hash that changes with the round, so that a path too shrinks by a constant factor a round. A round's tables are staged, so no lineage
    grows and nothing goes to the driver. Self loops and repeated edges are harmless; null ends are ignored; no edges give an empty table.
    """
    rest = stage(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels, turn = None, 0
    while labels is None or not is_empty(rest):
        rank = (lambda c: F.col(c)) if turn < 2 else (lambda c, t=turn: F.xxhash64(c, F.lit(t)))
        both = rest.select(F.col("u").alias("id"), F.col("v").alias("to")).union(rest.select("v", "u"))
        first = F.least(F.min(F.struct(rank("to").alias("r"), F.col("to").alias("p"))), F.struct(rank("id").alias("r"), F.col("id").alias("p")))
        parent = stage(both.groupBy("id").agg(first.alias("x")).select("id", F.col("x.p").alias("p")), "parents")
        if labels is None:
            grown = parent.select("id", F.col("p").alias("component"))
        else:
            up = parent.select(F.col("id").alias("component"), "p")
            grown = labels.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        grown = stage(grown, "labels")
        pu, pv = parent.select(F.col("id").alias("u"), F.col("p").alias("pu")), parent.select(F.col("id").alias("v"), F.col("p").alias("pv"))
        left = rest.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        left = stage(left, "edges")
        discard(labels, rest, parent)
        labels, rest, turn = grown, left, turn + 1
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    out = stage(labels.join(least, "component").select("id", F.col("least").alias("component")), "components")
    discard(rest, labels)
    return out


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For n places joined by links (p, q), the smallest place that each reaches."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[p], lab[q])
        new = lab.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def hash_filter(hashes: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes, two bits each, in 2 ** bits bits however many there are (8 MB): more hashes let more others through."""
    places = F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, 32)])
    words = hashes.select(F.explode(places).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("w"))
    found = words.select(F.col("word").cast("long").alias("word"), "w").toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def in_filter(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (signed 64-bit) may be among those that the filter was made of."""
    h, mask = hashes.view(np.uint64), np.uint64(len(table) * 64 - 1)
    out = np.ones(len(h), bool)
    for s in (0, 32):
        bit = ((h >> np.uint64(s)) & mask).astype(np.int64)
        out &= (table[bit >> 6] >> (bit & 63)) & 1 == 1
    return out


class Recent(dict):
    """A cache of two generations: the older one goes when the newer holds limit entries, so frequent keys stay. make gives a missing value."""

    def __init__(self, make: Callable, limit: int, longest: int = 60):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        return self.keep(key, self.make(key) if value is None else value)

    def keep(self, key, value):
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = self.copy()
                self.clear()
            self[key] = value
        return value


_caches: dict[str, dict] = {}


def worker_cache(name: str, make: Callable[[], dict]) -> dict:
    """The one cache that a Python worker holds; a task that asks for another drops it, so those of several operators never add up."""
    if name not in _caches:
        _caches.clear()
        _caches[name] = make()
    return _caches[name]
