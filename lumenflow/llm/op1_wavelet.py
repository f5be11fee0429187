"""Token ids on disk as wavelet matrices, one compressed file per shard.

A shard file (".wvm") holds consecutive documents' ids as bit-planes over the shard's own alphabet: plane k has bit
levels-1-k of every symbol, in the order that stable partitions by all higher bits leave. Layout, little-endian:

    b"WVM1" | u32 header length | JSON header | sections

The header lists each section's name, place, length and the places of its zlib blocks (BLOCK raw bytes each), so a reader
fetches only the blocks that it needs. Sections: alphabet (u32, ascending ids), doc_id (i64), doc_null (u8), doc_start (i64,
from the shard's beginning, with the end), and per plane bits (packed, most significant first) and ranks (u32: ones before
each RANK bits).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import new_path, stage

MAGIC, BLOCK, RANK = b"WVM1", 1 << 15, 1 << 12
MANIFEST = "shard string, part int, k int, docs long, tokens long"


def locate(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def pack_planes(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The alphabet of ids and their bit-planes as arrays of 0 and 1, the highest bit's first."""
    alphabet = np.flatnonzero(np.bincount(ids)).astype("<u4") if len(ids) else np.zeros(0, "<u4")
    small = np.zeros(int(alphabet[-1]) + 1 if len(ids) else 1, "u2" if len(alphabet) <= 1 << 16 else "u4")
    small[alphabet] = np.arange(len(alphabet))
    s, planes = small[ids], []
    for bit in reversed(range(max(0, len(alphabet) - 1).bit_length())):
        one = (s >> bit & 1).astype(bool)
        planes.append(one)
        s = np.concatenate((s[~one], s[one]))
    return alphabet, planes


def unpack_planes(alphabet: np.ndarray, planes: list[np.ndarray], n: int) -> np.ndarray:
    """All ids, from the last plane up: a plane's zeros and ones tell which symbol of the next order stands where."""
    if not n:
        return np.zeros(0, "<u4")
    s = np.zeros(n, "u2" if len(alphabet) <= 1 << 16 else "u4")
    for k, one in enumerate(reversed(planes)):
        up = np.empty_like(s)
        zeros = n - int(np.count_nonzero(one))
        up[~one] = s[:zeros]
        up[one] = s[zeros:] | s.dtype.type(1 << k)
        s = up
    return alphabet[s]


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    alphabet, planes = pack_planes(ids)
    parts = {
        "alphabet": alphabet.astype("<u4").tobytes(),
        "doc_id": np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        "doc_null": np.array([d is None for d in doc_ids], "u1").tobytes(),
        "doc_start": np.concatenate(([0], np.cumsum(lengths))).astype("<i8").tobytes(),
    }
    for k, one in enumerate(planes):
        parts[f"bits{k}"] = np.packbits(one).tobytes()
        steps = np.add.reduceat(one, np.arange(0, len(one), RANK), dtype="u4")
        parts[f"ranks{k}"] = np.concatenate(([0], np.cumsum(steps)[:-1])).astype("<u4").tobytes()
    sections, body = {}, bytearray()
    for name, raw in parts.items():
        places = [len(body)]
        for at in range(0, len(raw), BLOCK):
            body += zlib.compress(raw[at : at + BLOCK], 1)
            places.append(len(body))
        sections[name] = [len(raw), places]
    header = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "levels": len(planes), "sections": sections}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + bytes(body)


class Shard:
    """One shard file: token access, counting and occurrence lookup on single blocks; tokens() decodes it whole."""

    def __init__(self, uri: str):
        fs, path = locate(uri)
        self.f = fs.open_input_file(path)
        if self.f.read_at(4, 0) != MAGIC:
            raise ValueError(f"{uri} is not a shard of token ids")
        (n,) = struct.unpack("<I", self.f.read_at(4, 4))
        self.head = json.loads(self.f.read_at(n, 8))
        self.base, self.n, self.levels = 8 + n, self.head["tokens"], self.head["levels"]
        self.blocks: dict[tuple[str, int], bytes] = {}
        self.alphabet = np.frombuffer(self.section("alphabet"), "<u4")
        self.zeros = [self.n - self._rank1(k, self.n) for k in range(self.levels)]

    def section(self, name: str) -> bytes:
        _, places = self.head["sections"][name]
        raw = self.f.read_at(places[-1] - places[0], self.base + places[0])
        return b"".join(zlib.decompress(raw[a - places[0] : b - places[0]]) for a, b in zip(places, places[1:]))

    def _slice(self, name: str, lo: int, hi: int) -> bytes:
        """Bytes lo to hi of a section, from the one or two blocks that hold them."""
        _, places = self.head["sections"][name]
        out = b""
        for b in range(lo // BLOCK, -(-hi // BLOCK)):
            if (name, b) not in self.blocks:
                self.blocks[name, b] = zlib.decompress(self.f.read_at(places[b + 1] - places[b], self.base + places[b]))
            out += self.blocks[name, b]
        at = lo // BLOCK * BLOCK
        return out[lo - at : hi - at]

    def _bit(self, k: int, i: int) -> int:
        return self._slice(f"bits{k}", i >> 3, (i >> 3) + 1)[0] >> (7 - (i & 7)) & 1

    def _rank1(self, k: int, i: int) -> int:
        """Ones before place i of plane k."""
        if i == 0:
            return 0
        r = (i - 1) // RANK
        (before,) = struct.unpack("<I", self._slice(f"ranks{k}", 4 * r, 4 * r + 4))
        bits = np.unpackbits(np.frombuffer(self._slice(f"bits{k}", r * RANK >> 3, (i + 7) >> 3), "u1"))
        return before + int(np.count_nonzero(bits[: i - r * RANK]))

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        s = 0
        for k in range(self.levels):
            ones = self._rank1(k, i)
            if self._bit(k, i):
                s, i = s << 1 | 1, self.zeros[k] + ones
            else:
                s, i = s << 1, i - ones
        return int(self.alphabet[s])

    def _symbol(self, token: int) -> int | None:
        s = int(np.searchsorted(self.alphabet, token))
        return s if s < len(self.alphabet) and self.alphabet[s] == token else None

    def _down(self, s: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.levels):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if s >> (self.levels - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often token stands at places lo to hi (exclusive)."""
        s, hi = self._symbol(token), self.n if hi is None else min(hi, self.n)
        if s is None or hi <= lo:
            return 0
        a, b = self._down(s, lo, hi)
        return b - a

    def _select(self, k: int, bit: int, r: int) -> int:
        """The place of the r-th (from 0) such bit in plane k."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(k, mid + 1)
            lo, hi = (lo, mid) if (ones if bit else mid + 1 - ones) > r else (mid + 1, hi)
        return lo

    def select(self, token: int, r: int) -> int:
        """The place of token's r-th occurrence, from 0."""
        s = self._symbol(token)
        if s is None or not 0 <= r < self.count(token):
            raise IndexError(r)
        i = self._down(s, 0, self.n)[0] + r
        for k in reversed(range(self.levels)):
            bit = s >> (self.levels - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, r) for r in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        planes = [np.unpackbits(np.frombuffer(self.section(f"bits{k}"), "u1"), count=self.n).view(bool) for k in range(self.levels)]
        return unpack_planes(self.alphabet, planes, self.n)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids and where each document starts, with the end."""
        null = np.frombuffer(self.section("doc_null"), "u1")
        ids = np.frombuffer(self.section("doc_id"), "<i8").tolist()
        return [None if x else d for d, x in zip(ids, null)], np.frombuffer(self.section("doc_start"), "<i8")


def put(uri: str, data: bytes) -> None:
    """Write a file whole: under another name first, so that no reader or second attempt meets half of it."""
    fs, path = locate(uri)
    part = f"{path}.{np.random.default_rng().integers(1 << 62):x}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    if fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound and fs.type_name != "local":
        fs.delete_file(path)
    fs.move(part, path)


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, tokens_per_shard: int = 1 << 20) -> DataFrame:
    """Encode whole texts in ascending doc_id order into shard files below out (a path that executors share).

    Returns the staged manifest: shard (path), part and k (the shards' order), docs, tokens. A null text is empty and leaves
    only end_id; a null doc_id comes first; repeated rows stay, tied doc_ids stand in the order of their texts. A shard ends
    when it reaches tokens_per_shard, so memory doesn't follow the size of a partition. An empty table writes no file.
    """
    spark = docs.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(out)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from lumenflow.llm.tokens import cache_for

        cache, part, k = cache_for(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], cache.dtype).tobytes()
        ids, lengths, data, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal k, size
            shard = f"{out}/part-{part:06d}-{k:04d}.wvm"
            put(shard, shard_bytes(ids, lengths, np.frombuffer(b"".join(data), cache.dtype)))
            row = pa.RecordBatch.from_pydict({"shard": [shard], "part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "docs": [len(ids)], "tokens": [size]})
            k, size = k + 1, 0
            for x in (ids, lengths, data):
                x.clear()
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = cache.encode(text.as_py()) + end
                n = len(x) // cache.dtype.itemsize
                ids.append(doc_id), lengths.append(n), data.append(x)
                size += n
                if size >= tokens_per_shard:
                    yield flush()
        if ids:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stage(rows.mapInArrow(encode, MANIFEST), "shards")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and shard, its path."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                ids, (doc_ids, starts) = shard.tokens().astype("<u4"), shard.documents()
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts[:-1] + base), "n_tokens": pa.array(np.diff(starts)), "ids_crc32": pa.array(crc, pa.int64()), "shard": [uri] * len(crc)})

    before = F.sum("tokens").over(Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1))
    rows = manifest.select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    n = max(1, min(manifest.count(), 100_000))
    return rows.repartition(n).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    out = new_path(spark, "wavelet")
    return read_shards(write_shards(docs, out, tokenizer)).drop("shard")
