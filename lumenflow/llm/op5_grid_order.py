"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned onto their principal axes and sorted by the grid cells (as wide as the largest distance of a link) of
the leading ones. The sorted sequence is cut into blocks with bounding boxes. Intervals of blocks are joined recursively
from the whole sequence down: a pair of intervals whose boxes are farther apart than a link allows is skipped with all in it. Pairs
of blocks that remain are joined likewise, interval by interval, in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import components, discard, finite_vector, forest, is_empty, stage
from lumenflow.llm.vectors import matrix, unit

#: Vectors of a block; intervals joined in memory; blocks of an interval of the next level; axes in the order; axes in boxes.
BLOCK, LEAF, FAN, ORDER_AXES, BOX_AXES = 8192, 256, 8, 7, 24


def principal_axes(classes: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal axes (columns) by falling variance of all unit vectors, from sums of products that tasks add up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, ss, n = np.zeros(dims), np.zeros((dims, dims)), 0
        for b in batches:
            x = unit(matrix(b.column(0), dims))
            s, ss, n = s + x.sum(0), ss + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_pydict({"n": [float(n)], "s": [s.tobytes()], "ss": [ss.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, ss, n = np.zeros(dims), np.zeros((dims, dims)), 0.0
        for b in batches:
            for row in b.to_pylist():
                s, ss, n = s + np.frombuffer(row["s"]), ss + np.frombuffer(row["ss"]).reshape(dims, dims), n + row["n"]
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s.tobytes()], "ss": [ss.tobytes()]})

    schema = "n double, s binary, ss binary"
    rows = classes.select("embedding").mapInArrow(sums, schema).repartition(16).mapInArrow(add, schema).collect()
    n = max(1.0, sum(r.n for r in rows))
    mean = sum(np.frombuffer(r.s) for r in rows) / n
    cov = sum(np.frombuffer(r.ss).reshape(dims, dims) for r in rows) / n - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1].copy()


def _blocks(classes: DataFrame, dims: int, axes: np.ndarray, eps: float) -> DataFrame:
    """The sorted sequence in blocks: block (in order), lo and hi (its box), cids, counts, x (unit vectors)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(matrix(b.column(2), dims))
            cells = np.clip(np.floor(x @ axes[:, :ORDER_AXES] / eps) + 128, 0, 255).astype(np.int64)
            key = np.zeros(len(x), np.int64)
            for c in cells.T:
                key = key << 8 | c
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "cid": b.column(0), "c": b.column(1), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal k
            x = np.frombuffer(b"".join(t["x"].to_pylist())).reshape(-1, dims)
            y = x @ axes[:, :BOX_AXES]
            k += 1
            return pa.RecordBatch.from_pydict({"block": [part << 32 | k], "lo": [(y.min(0) - 1e-9).tolist()], "hi": [(y.max(0) + 1e-9).tolist()], "cids": [t["cid"].to_numpy().tobytes()], "counts": [t["c"].to_numpy().tobytes()], "x": [x.tobytes()]})

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= BLOCK:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, BLOCK))
                held, rows = t.slice(BLOCK).to_batches(), rows - BLOCK
        if rows:
            yield block(pa.Table.from_batches(held))

    n = classes.count()
    parts = max(1, min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (2 * BLOCK)))
    keyed = classes.select("cid", "c", "embedding").mapInArrow(keys, "key long, cid long, c long, x binary")
    ordered = keyed.repartitionByRange(parts, "key", "cid").sortWithinPartitions("key", "cid")
    return stage(ordered.mapInArrow(cut, "block long, lo array<double>, hi array<double>, cids binary, counts binary, x binary"), "blocks")


def _near_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs of blocks (a <= b) whose boxes may hold a link, by recursion over intervals of the sequence."""
    part = F.shiftright("block", 32)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    box = blocks.select("block", "lo", "hi", part.alias("part")).join(F.broadcast(bases), "part")
    nodes = [stage(box.select((F.col("base") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) - 1).alias("node"), "lo", "hi", "block"), "nodes")]
    size = nodes[0].count()
    while size > 1:
        up = nodes[-1].select(F.floor(F.col("node") / FAN).alias("node"), F.posexplode(F.arrays_zip("lo", "hi")))
        merged = up.groupBy("node", "pos").agg(F.min("col.lo").alias("l"), F.max("col.hi").alias("h")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "l", "h"))).alias("v"))
        nodes.append(stage(merged.select("node", F.col("v.l").alias("lo"), F.col("v.h").alias("hi")), "nodes"))
        size = -(-size // FAN)
    pairs = nodes[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    apart = "aggregate(zip_with(zip_with(alo, bhi, (l, h) -> l - h), zip_with(blo, ahi, (l, h) -> l - h), (p, q) -> pow(greatest(p, q, 0D), 2)), 0D, (s, v) -> s + v)"
    for level in reversed(nodes[:-1] if len(nodes) > 1 else []):
        a = level.select(F.floor(F.col("node") / FAN).alias("a"), F.col("node").alias("na"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        b = level.select(F.floor(F.col("node") / FAN).alias("b"), F.col("node").alias("nb"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        pairs = stage(pairs.join(a, "a").join(b, "b").where("na <= nb").where(F.expr(apart) <= eps * eps).select(F.col("na").alias("a"), F.col("nb").alias("b")), "pairs")
    names = nodes[0].select("node", "block")
    out = pairs.join(names.toDF("a", "block_a"), "a").join(names.toDF("b", "block_b"), "b").select("block_a", "block_b")
    return stage(out, "block_pairs")


def link_block_pair(xa: np.ndarray, xb: np.ndarray, same: bool, axes: np.ndarray, eps: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all links between two blocks of unit vectors; intervals whose boxes are too far apart are skipped."""

    def boxes(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        y = x @ axes[:, :BOX_AXES]
        return [(y[s : s + LEAF].min(0) - 1e-9, y[s : s + LEAF].max(0) + 1e-9) for s in range(0, len(x), LEAF)]

    ba = boxes(xa)
    bb = ba if same else boxes(xb)
    p, q = [], []

    def join(i0: int, i1: int, j0: int, j1: int) -> None:
        if same and i0 >= j1:
            return
        lo_a, hi_a = np.min([b[0] for b in ba[i0:i1]], 0), np.max([b[1] for b in ba[i0:i1]], 0)
        lo_b, hi_b = np.min([b[0] for b in bb[j0:j1]], 0), np.max([b[1] for b in bb[j0:j1]], 0)
        if (np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0) ** 2).sum() > eps * eps:
            return
        if i1 - i0 == 1 and j1 - j0 == 1:
            i, j = np.nonzero(xa[i0 * LEAF : i1 * LEAF] @ xb[j0 * LEAF : j1 * LEAF].T >= least)
            i, j = i + i0 * LEAF, j + j0 * LEAF
            if same:
                i, j = i[i < j], j[i < j]
            p.append(i), q.append(j)
            return
        im, jm = (i0 + i1 + 1) // 2, (j0 + j1 + 1) // 2
        for u in [(i0, im), (im, i1)] if i1 - i0 > 1 else [(i0, i1)]:
            for v in [(j0, jm), (jm, j1)] if j1 - j0 > 1 else [(j0, j1)]:
                join(*u, *v)

    join(0, len(ba), 0, len(bb))
    none = np.zeros(0, np.int64)
    return (np.concatenate(p), np.concatenate(q)) if p else (none, none)


def _links(blocks: DataFrame, pairs: DataFrame, dims: int, axes: np.ndarray, least: float, eps: float) -> DataFrame:
    """id, links (vectors linked with it in one pair of blocks), root (another id of its component there, or itself)."""

    def run(t: pa.Table) -> pa.Table:
        first, *second = t.sort_by("block").to_pylist()
        other = second[0] if second else first
        xa, xb = (np.frombuffer(r["x"]).reshape(-1, dims) for r in (first, other))
        p, q = link_block_pair(xa, xb, not second, axes, eps, least)
        ids = np.concatenate([np.frombuffer(r["cids"], np.int64) for r in (first, other)])
        counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in (first, other)])
        q = q + len(xa) if second else q
        links = np.bincount(p, counts[q], len(ids)) + np.bincount(q, counts[p], len(ids))
        root, hit = forest(len(ids), p, q), np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[hit]), "links": pa.array(links[hit].astype(np.int64)), "root": pa.array(ids[root[hit]])})

    named = pairs.withColumn("pair", F.struct("block_a", "block_b"))
    ends = named.select(F.col("block_a").alias("block"), "pair").unionByName(named.where("block_a <> block_b").select(F.col("block_b").alias("block"), "pair"))
    both = blocks.select("block", "cids", "counts", "x").join(ends, "block")  # a pair's two blocks meet in one shuffle
    return stage(both.groupBy("pair").applyInArrow(run, "id long, links long, root long"), "links")


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding); cosine >= least links.

    Equal vectors are one class and join once; n_links counts all rows of a linked class and the others of one's own. Vectors
    that are null, zero or hold null or non-finite components, and those with a null vec_id, link with nothing and are their
    own component. Shorter vectors are filled up with zeros. Rows that share a vec_id count each and share a component. An empty
    table gives none. Other columns aren't read.
    """
    spark: SparkSession = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = rows.where(finite_vector(F.col("embedding")) & F.col("vec_id").isNotNull())
    classes = stage(valid.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("c")), "classes")
    dims = classes.agg(F.max(F.size("embedding"))).first()[0]
    if dims:
        eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
        axes = principal_axes(classes, dims)
        blocks = _blocks(classes, dims, axes, eps)
        pairs = _near_pairs(blocks, eps)
        links = _links(blocks, pairs, dims, axes, least, eps)
        discard(blocks, pairs)
        sums = links.groupBy(F.col("id").alias("cid")).agg(F.sum("links").alias("links"))
        edges = links.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))
        linked = spark.createDataFrame([], "cid long, component long") if is_empty(edges) else components(edges).withColumnRenamed("id", "cid")
        known = stage(classes.select("embedding", "cid", "c").join(sums, "cid", "left").join(linked, "cid", "left"), "known")
    else:
        known = spark.createDataFrame([], "cid long, embedding array<double>, c long, links long, component long")
    member = valid.join(known, "embedding").select("vec_id", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    lone = rows.where(~(finite_vector(F.col("embedding")) & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The contract's query in DuckDB.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN component USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
