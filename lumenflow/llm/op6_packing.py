"""Packing documents into sequences along a space-filling curve.

Each document's ids are hashed into a vector, projected to a few dimensions and placed on a Hilbert curve; documents that
are neighbours on the curve are packed next to each other, cut where a sequence is full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import discard, stage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection(buckets: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims)).astype("f4")


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (one a row, each coordinate of so many bits).

    The axes are turned into the curve's transposed index by undoing, from the highest bit down, the reflections and
    exchanges of each level, then Gray-decoding; the index's bits are then interleaved.
    """
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for level in reversed(range(1, bits)):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            set_, differ = (x[i] & q) != 0, (x[0] ^ x[i]) & low
            flipped = np.where(set_, x[0] ^ low, x[0] ^ differ)
            x[i] = np.where(set_, x[i] if i else flipped, x[i] ^ differ)
            x[0] = flipped
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in reversed(range(1, bits)):
        q = 1 << level
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
    key = np.zeros_like(x[0])
    for level in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | ((x[i] ^ turn) >> level & 1)
    return key


def encode_with_vectors(docs: DataFrame, tokenizer: str, end_id: int, buckets: int, dims: int, seed: int) -> DataFrame:
    """rid (unique), doc_id, ids (bytes), n, x (the hashed, projected vector); staged, so texts are encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from lumenflow.llm.tokens import cache_for

        cache, rid, p = cache_for(tokenizer), TaskContext.get().partitionId() << 33, projection(buckets, dims, seed)
        end = np.array([end_id], cache.dtype).tobytes()
        for batch in batches:
            ids = [cache.encode(t.as_py()) + end for t in batch.column(1)]
            x = np.empty((len(ids), dims), "f4")
            for i, raw in enumerate(ids):
                h = (np.frombuffer(raw, cache.dtype).astype("u4") * np.uint32(2654435761)) >> np.uint32(8)
                v = np.sqrt(np.bincount(h % buckets, minlength=buckets))
                x[i] = v @ p / np.sqrt(v @ v)
            yield pa.RecordBatch.from_pydict({"rid": pa.array(range(rid, rid + len(ids)), pa.int64()), "doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()), "n": pa.array([len(r) // cache.dtype.itemsize for r in ids], pa.int64()), "width": pa.array([cache.dtype.itemsize] * len(ids), pa.int32()), "x": pa.array(list(x), pa.list_(pa.float32()))})
            rid += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(encode, "rid long, doc_id long, ids binary, n long, width int, x array<float>"), "encoded")


def place_on_curve(encoded: DataFrame, dims: int, bits: int) -> DataFrame:
    """rid, position: each document's first id counted along the curve over the whole corpus."""
    stats = encoded.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(dims)])
    sd = np.array([stats[f"s{i}"] or 1.0 for i in range(dims)])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (np.array(batch.column(2).to_pylist(), float).reshape(-1, dims) - mean) / sd
            even = 1 / (1 + np.exp(-1.702 * x))  # about the normal distribution, so cells are about equally full
            cells = np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1)
            yield pa.RecordBatch.from_pydict({"rid": batch.column(0), "n": batch.column(1), "key": pa.array(hilbert_key(cells, bits))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_pydict({"rid": batch.column(0), "part": pa.array([part] * len(n), pa.int32()), "local": pa.array(ends - n), "n": batch.column(1)})
            at = int(ends[-1]) if len(ends) else at

    parts = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = encoded.select("rid", "n", "x").mapInArrow(key, "rid long, n long, key long")
    ordered = keyed.repartitionByRange(parts, "key", "rid").sortWithinPartitions("key", "rid")
    placed = stage(ordered.mapInArrow(run, "rid long, part int, local long, n long"), "placed")
    totals = placed.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return placed.join(F.broadcast(bases), "part").select("rid", (F.col("local") + F.col("base")).alias("position"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, dims: int = 3, bits: int = 16, buckets: int = 1024, seed: int = 20) -> DataFrame:
    """Pack whole documents into sequences of length ids; one row per piece (PIECES).

    Positions count ids along the whole curve and a sequence is length of them, so every sequence is full but the last,
    whose rest is cut into sequences of powers of two, which need no padding. A null text is empty: one piece, the
    end id. Null or repeated doc_ids are packed like others. An empty table gives none. The broadcast table has a row for
    each range of the curve, as many as spark.sql.shuffle.partitions.
    """
    encoded = encode_with_vectors(docs, tokenizer, end_id, buckets, dims, seed)
    placed = stage(place_on_curve(encoded, dims, bits), "positions")
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tail, cuts = total - total % length, []
    at = tail
    for bit in reversed(range(length.bit_length())):
        if total % length >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    cuts = np.array(cuts, np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids, n, width, position in zip(*(batch.column(i).to_pylist() for i in range(5))):
                raw, at, end = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()), position, position + n
                while at < end:
                    if at < tail:
                        sequence, first = at // length, at // length * length
                        stop = min(end, first + length)
                    else:
                        k = int(np.searchsorted(cuts, at, "right")) - 1
                        sequence, first = tail // length + k, int(cuts[k])
                        stop = min(end, int(cuts[k + 1]) if k + 1 < len(cuts) else total)
                    a, b = at - position, stop - position
                    out.append((doc_id, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n, sequence, at - first))
                    at = stop
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # Merged at every size: what is broadcast would grow with the documents.
    out = encoded.select("rid", "doc_id", "ids", "n", "width").join(placed.hint("merge"), "rid").select("doc_id", "ids", "n", "width", "position")
    return out.mapInArrow(cut, PIECES)
