"""Line dedup by repeated runs of lines.

A passage is a run of lines of which two or more aren't blank, or a line of long_line words or more. Every line of a passage
that stands at an earlier place too, byte for byte, is removed (dedup_runs); the first one stays. The windows of two
neighbouring lines that aren't blank are the anchors: a run repeats if and only if its windows do, so those that
stand earlier cover the maximal runs, wherever they begin and end. Short single lines stay.

dedup_lines compares content-defined chunks instead: a rolling hash over the hashes of neighbouring lines decides where a
chunk ends. It misses passages that two documents don't cut at the same places; no query uses it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.llm.common import discard, hash_filter, in_filter, stage


def chunk_bounds(lines: list[bytes], divisor: int = 3, long_line: int = 50, most: int = 64) -> list[tuple[int, int]]:
    """Half-open line ranges of a text's chunks. A chunk ends where the hash of its last two lines is 0 modulo divisor."""
    bounds, start, before = [], 0, 0
    for i, line in enumerate(lines):
        if len(line) >= 2 * long_line and len(line.split()) >= long_line:
            if start < i:
                bounds.append((start, i))
            bounds.append((i, i + 1))
            start, before = i + 1, 0
            continue
        h = xxhash.xxh3_64_intdigest(line)
        rolled = (before * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
        rolled ^= rolled >> 31
        before = h
        if i > start and (rolled % divisor == 0 or i - start + 1 >= most):
            bounds.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        bounds.append((start, len(lines)))
    return bounds


def _passage(lines: list[bytes], lo: int, hi: int, long_line: int) -> bytes | None:
    """The bytes of a chunk that may be removed; null for a short single line or blank lines."""
    chunk = b"\n".join(lines[lo:hi])
    if not chunk.strip() or hi - lo < 2 and len(chunk.split()) < long_line:
        return None
    return chunk


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _chunks(docs: DataFrame, divisor: int, long_line: int, wanted=None) -> DataFrame:
    """doc_id, th, no, h1, h2 of each chunk that may be removed; with wanted (a broadcast filter of h1), those that it lets through and their bytes."""
    names = ["doc_id", "th", "no", "h1", "h2"] + ["chunk"] * (wanted is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                lines = (text.as_py() or "").encode().split(b"\n")
                for no, (lo, hi) in enumerate(chunk_bounds(lines, divisor, long_line)):
                    if (chunk := _passage(lines, lo, hi, long_line)) is not None:
                        d = xxhash.xxh3_128_digest(chunk)
                        out.append((doc_id, th, no, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), chunk))
            if wanted is not None and out:
                keep = in_filter(wanted.value, np.array([x[3] for x in out], np.int64))
                out = [x for x, k in zip(out, keep) if k]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "no" else pa.binary() if n == "chunk" else pa.int64()) for n, c in zip(names, cols)], names=names)

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, no int, h1 long, h2 long" + ", chunk binary" * (wanted is not None))


def dedup_lines(docs: DataFrame, divisor: int = 3, long_line: int = 50) -> DataFrame:
    """docs with text less its repeated chunks, and n_chunks, n_removed (chunks), n_removed_lines.

    Of equal chunks that of the smallest (doc_id, text hash, place) stays; a null doc_id comes first. Rows equal in doc_id and
    text are one document: what goes from one goes from the others. A null text stays null and has no chunks, an empty one
    has one that stays. A text may lose all its lines and is then empty; its row stays. All other columns are
    passed on, also those whose names clash with the three new ones, which win.
    """
    spark = docs.sparkSession
    hashes = stage(_chunks(docs, divisor, long_line), "chunks")
    place = F.struct("doc_id", "th", "no")
    repeated = stage(hashes.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1").select("h1", "h2", "first"), "repeated")
    wanted = spark.sparkContext.broadcast(hash_filter(repeated, "h1"))
    texts = stage(_chunks(docs, divisor, long_line, wanted).join(repeated, ["h1", "h2"]), "passages")
    discard(hashes)
    first = texts.withColumn("is_first", F.col("first").eqNullSafe(place))
    kept = first.where("is_first").select("h1", "h2", F.col("chunk").alias("kept")).dropDuplicates(["h1", "h2"])
    drop = first.where("not is_first").join(kept, ["h1", "h2"]).where(F.col("chunk") == F.col("kept"))
    drops = stage(drop.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("no")).alias("gone")), "drops")
    discard(texts, repeated)

    @F.pandas_udf("text string, n_chunks int, n_removed int, n_removed_lines int")
    def cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, g in zip(text, gone):
            if t is None:
                out.append((None, 0, 0, 0))
                continue
            lines, g = t.encode().split(b"\n"), set() if g is None else set(g)
            bounds = chunk_bounds(lines, divisor, long_line)
            left = b"\n".join(x for no, (lo, hi) in enumerate(bounds) if no not in g for x in lines[lo:hi]).decode() if g else t
            out.append((left, len(bounds), len(g), sum(hi - lo for no, (lo, hi) in enumerate(bounds) if no in g)))
        return pd.DataFrame(out, columns=["text", "n_chunks", "n_removed", "n_removed_lines"])

    new = ["n_chunks", "n_removed", "n_removed_lines"]
    text = F.col("text").cast("string")
    rows = docs.drop(*new).withColumn("__th", F.xxhash64(text))
    g = drops.select(F.col("doc_id").alias("__id"), F.col("th").alias("__t"), "gone").withColumnRenamed("gone", "__gone")
    # Merged at every size: what is broadcast would grow with the documents that lose lines.
    rows = rows.join(g.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__t")), "left")
    rows = rows.withColumn("__cut", cut(text, F.col("__gone")))
    others = [c for c in docs.columns if c not in new]
    return rows.select(*[F.col("__cut.text").alias("text") if c == "text" else F.col(c) for c in others], *[F.col(f"__cut.{c}") for c in new])


def windows(lines: list[bytes], long_line: int = 50) -> Iterator[tuple[int, int]]:
    """Half-open line ranges: two neighbouring lines that aren't blank with the blank ones between, and each long line."""
    before = -1
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        if before >= 0:
            yield before, i + 1
        if len(line) >= 2 * long_line - 1 and len(line.split()) >= long_line:
            yield i, i + 1
        before = i


def _windows(docs: DataFrame, long_line: int, wanted=None) -> DataFrame:
    """doc_id, th, lo, hi, h1, h2 of each window; with wanted (a broadcast filter of h1), those that it lets through and their bytes."""
    names = ["doc_id", "th", "lo", "hi", "h1", "h2"] + ["bytes"] * (wanted is not None)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part, out = batch.slice(at, 1_000), []
                for doc_id, th, text in zip(*(c.to_pylist() for c in part.columns)):
                    lines = (text or "").encode().split(b"\n")
                    for lo, hi in windows(lines, long_line):
                        data = b"\n".join(lines[lo:hi])
                        d = xxhash.xxh3_128_digest(data)
                        row = doc_id, th, lo, hi, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
                        out.append(row if wanted is None else (*row, data))
                if wanted is not None and out:
                    keep = in_filter(wanted.value, np.array([x[4] for x in out], np.int64))
                    out = [x for x, k in zip(out, keep) if k]
                cols = list(zip(*out)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, lo int, hi int, h1 long, h2 long" + ", bytes binary" * (wanted is not None))


def dedup_runs(docs: DataFrame, divisor: int = 3, long_line: int = 50, own_columns: bool = False) -> DataFrame:
    """docs with text less its repeated passages, and n_chunks (content-defined chunks of the text that came), n_removed
    (runs of lines), n_removed_lines.

    A line goes if a window that holds it stands at an earlier (doc_id, text hash, line) that it doesn't overlap; a null doc_id
    comes first. What is earlier is judged on the texts as they came; of equal lines one always stays. Rows equal in doc_id and
    text are one document: what goes from one goes from the others. A null text stays null and has no chunks, an empty one
    has one that stays. Blank lines beside a passage stay. A text may lose all its lines and is then empty; its row stays.
    All other columns are passed on, except those whose names clash with the three new ones, which win; with own_columns,
    docs' columns alone, whatever they are called. Texts of any length are read whole. An empty table
    gives none. Chunks (n_chunks) end after 64 lines where no hash ends them; this has no part in what goes.
    """
    spark = docs.sparkSession
    hashes = stage(_windows(docs, long_line), "windows")
    place = F.struct("doc_id", "th", "lo")
    repeated = stage(hashes.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1").select("h1", "h2", "first"), "repeated")
    discard(hashes)
    wanted = spark.sparkContext.broadcast(hash_filter(repeated, "h1"))
    texts = stage(_windows(docs, long_line, wanted), "passages")
    # Equal bytes become one row in each task first, so the copies of a passage that all documents hold don't meet as texts.
    forms = texts.groupBy("h1", "h2", "bytes").agg(F.count("*").alias("c")).groupBy("h1", "h2").agg(F.count("*").alias("forms"))
    known = stage(repeated.join(forms, ["h1", "h2"]), "forms")
    alike = texts.drop("bytes").join(known.where("forms = 1"), ["h1", "h2"])
    # Different bytes of one hash are compared one by one with those of the first place. Such hashes are staged, so that Spark sees how few they are.
    mixed = stage(known.where("forms > 1"), "mixed")
    unlike = texts.join(mixed, ["h1", "h2"])
    kept = unlike.where(F.col("first").eqNullSafe(place)).select("h1", "h2", F.col("bytes").alias("kept")).dropDuplicates(["h1", "h2"])
    unlike = unlike.join(kept, ["h1", "h2"]).where(F.col("bytes") == F.col("kept")).select(*alike.columns)
    overlaps = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")) & (F.col("lo") < F.col("first.lo") + F.col("hi") - F.col("lo"))
    drop = alike.unionByName(unlike).where(~overlaps)
    drops = stage(drop.groupBy("doc_id", "th").agg(F.collect_set(F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")).alias("gone")), "drops")
    discard(texts, repeated, known, mixed)

    @F.pandas_udf("text string, n_chunks int, n_removed int, n_removed_lines int")
    def cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for t, g in zip(text, gone):
            if t is None:
                out.append((None, 0, 0, 0))
                continue
            lines = t.encode().split(b"\n")
            n_chunks = len(chunk_bounds(lines, divisor, long_line))
            if g is None:
                out.append((t, n_chunks, 0, 0))
                continue
            go = np.zeros(len(lines) + 1, bool)
            for x in map(int, g):
                go[x >> 32 : x & 0xFFFFFFFF] = True
            runs = int((go[1:] < go[:-1]).sum())
            out.append((b"\n".join(x for x, out_ in zip(lines, go) if not out_).decode(), n_chunks, runs, int(go.sum())))
        return pd.DataFrame(out, columns=["text", "n_chunks", "n_removed", "n_removed_lines"])

    new = ["n_chunks", "n_removed", "n_removed_lines"]
    text = F.col("text").cast("string")
    rows = docs.withColumn("__th", F.xxhash64(text))
    g = drops.select(F.col("doc_id").alias("__id"), F.col("th").alias("__t"), F.col("gone").alias("__gone"))
    # Merged at every size: what is broadcast would grow with the documents that lose lines.
    rows = rows.join(g.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__t")), "left")
    rows = rows.withColumn("__cut", cut(text, F.col("__gone")))
    others = [c for c in docs.columns if own_columns or c not in new]
    return rows.select(*[F.col("__cut.text").alias("text") if c == "text" else F.col(c) for c in others], *([] if own_columns else [F.col(f"__cut.{c}") for c in new]))
