"""N-gram Jaccard join by adaptive multi-match prefixes.

Tokens (hashed word n-grams) are ordered globally from rare to common by their exact number of documents. Two sets whose similarity
reaches the threshold share at least m tokens of their prefixes when each keeps its
size - ceil(threshold * size) + m first tokens. Each document picks its own m from the lengths of its tokens' lists: a longer prefix costs more
postings but lets candidates through only with m shared tokens. A pair needs the smaller of its two m, and
enough shared tokens that with all tokens behind the prefixes it could still reach the threshold.

Texts are read once. A task cuts its documents into chunks and sends each range of hashes the chunk's tokens there, which are counted over
all chunks. A token that only one document has is the rarest, shares nothing and goes; what comes back to a chunk are the tokens that documents
share, with their counts. These are enough for the prefixes (those of one document stand before them), the candidates and the intersections.

No pair becomes a row. Documents that shared tokens of their prefixes connect are a family; families are put one after another, and the sequence is
cut into blocks of bounded size. Within a block, and between blocks of one family that share a token, products of incidence
matrices count the shared prefix tokens, then all shared tokens of those that pass; what a block or pair of blocks returns
is a spanning forest of its links.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.llm.common import Recent, components, discard, forest, stage, worker_cache

#: Tokens of a chunk (a longer document is a chunk of its own) and, about, of a range; from so many documents of a chunk on, a token's list stays with the chunk.
CHUNK, RANGE, COMMON = 1 << 21, 1 << 20, 64
#: Documents of a block, shared tokens of a block (a longer document is a block of its own), columns of a matrix.
BLOCK, BLOCK_TOKENS, COLUMNS = 256, 400_000, 4_096
#: Bits of a token's hash.
BITS = 48


def _words() -> Recent:
    """Word -> hash, about 30 MB."""
    return Recent(xxhash.xxh3_64_intdigest, 75_000)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles: ASCII-lower-cased words between ASCII white space.

    A text of fewer words has its whole sequence as one shingle; a null text or one without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(worker_cache("op8-words", _words).__getitem__, words), np.uint64, len(words))
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h >> np.uint64(64 - BITS))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key() -> Column:
    """A hash that tells apart the texts of rows which share a doc_id."""
    return F.xxhash64(F.col("text").cast("string"), F.lit(8))


def _class_of(s: np.ndarray) -> int:
    """Equal sets are one class; it is named by a 64-bit digest."""
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True)


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, those of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view("u1").reshape(len(a), a.itemsize).T).tobytes())


def unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _rising(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def _risen(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, "<u8"), dtype=np.uint64)


#: A chunk's share of a range: distinct tokens, how many documents' numbers follow for each, these numbers. Or what the chunk keeps: its common tokens, and its documents.
_SHARE = [("chunk", pa.int64()), ("part", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())]
_OWN = [("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64()))]
_SENT = pa.schema([("to", pa.int64()), *_SHARE, *_OWN])
_BACK = pa.schema([*_SHARE, ("totals", pa.binary()), *_OWN])
_SENT_SQL = "to long, chunk long, part long, tokens binary, counts binary, places binary, ids array<long>, keys array<long>, sizes array<long>, classes array<long>"
_BACK_SQL = "chunk long, part long, tokens binary, counts binary, places binary, totals binary, ids array<long>, keys array<long>, sizes array<long>, classes array<long>"


def _chunk_rows(chunk: int, docs: dict[str, list], sets: list[np.ndarray], places: list[int], ranges: int) -> pa.RecordBatch:
    """The rows that a chunk sends: one for each range, to be counted, and one that only passes through, for itself."""
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    place = np.repeat(np.array(places, np.uint32), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, place = values[order], place[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)
    counts = np.diff(np.r_[starts, len(values)]).astype(np.uint32)
    tokens = values[starts]
    common = np.repeat(counts >= COMMON, counts)
    cut = np.searchsorted(tokens, (np.arange(ranges + 1, dtype=object) * (1 << BITS) // ranges).astype(np.uint64))
    rows: dict[str, list] = {f.name: [] for f in _SENT}

    def row(**cells) -> None:
        for name in rows:
            rows[name].append(cells.get(name))

    for r in range(ranges):
        lo, hi = cut[r], cut[r + 1]
        if lo < hi:
            a, b = starts[lo], starts[hi] if hi < len(starts) else len(values)
            few = np.where(counts[lo:hi] >= COMMON, 0, counts[lo:hi]).astype("<u4")
            row(to=r, chunk=chunk, part=r, tokens=_rising(tokens[lo:hi]), counts=squeeze(few), places=squeeze(place[a:b][~common[a:b]].astype("<u4")))
    kept = counts >= COMMON
    row(to=ranges + chunk % ranges, chunk=chunk, part=-1, tokens=_rising(tokens[kept]), counts=squeeze(counts[kept].astype("<u4")), places=squeeze(place[common].astype("<u4")), **docs)
    return pa.RecordBatch.from_pydict(rows, schema=_SENT)


def _send(docs: DataFrame, k: int, ranges: int) -> DataFrame:
    """Every text's set, in shares of chunks. A task sends equal sets (a class) once; their other documents aren't listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, seen = TaskContext.get().partitionId() << 24, set()
        fresh = lambda: ({f: [] for f in ("ids", "keys", "sizes", "classes")}, [], [])
        (about, sets, places), held = fresh(), 0
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), k)
                name = _class_of(s) if len(s) else None
                new = name is not None and name not in seen
                if new:
                    seen.add(name)
                    if sets and held + len(s) > CHUNK:
                        yield _chunk_rows(number, about, sets, places, ranges)
                        (about, sets, places), held, number = fresh(), 0, number + 1
                    sets.append(s), places.append(len(about["ids"]))
                    held += len(s)
                for f, v in zip(about, (doc_id, key, len(s), name)):
                    about[f].append(v)
                if len(about["ids"]) >= CHUNK // 8:
                    yield _chunk_rows(number, about, sets, places, ranges)
                    (about, sets, places), held, number = fresh(), 0, number + 1
        if about["ids"]:
            yield _chunk_rows(number, about, sets, places, ranges)

    return _texts(docs).withColumn("key", text_key()).mapInArrow(run, _SENT_SQL)


def _count(t: pa.Table) -> pa.Table:
    """For a range, each chunk's tokens that more than one listed document has, with how many have them (totals); a chunk's own rows as they are."""
    rows, shares = {f.name: [] for f in _BACK}, []
    for r in t.drop_columns(["to"]).to_pylist():
        if r["part"] < 0:
            for name in rows:
                rows[name].append(r.get(name))
        else:
            shares.append((r, _risen(r["tokens"]), unsqueeze(r["counts"], "<u4"), unsqueeze(r["places"], "<u4")))
    if shares:
        tokens, at = np.unique(np.concatenate([x[1] for x in shares]), return_inverse=True)
        totals = np.bincount(at, np.concatenate([np.where(x[2] == 0, COMMON, x[2]) for x in shares]), len(tokens)).astype(np.uint32)
        end = 0
        for r, mine, counts, places in shares:
            total = totals[at[end : end + len(mine)]]
            end += len(mine)
            keep = total > 1
            if not keep.any():
                continue
            cells = {"chunk": r["chunk"], "part": r["part"], "tokens": _rising(mine[keep]), "counts": squeeze(counts[keep]), "places": squeeze(places[np.repeat(keep, counts)]), "totals": squeeze(total[keep])}
            for name in rows:
                rows[name].append(cells.get(name))
    return pa.Table.from_pydict(rows, schema=_BACK)


def _prefix_length(n: np.ndarray, percent: int, longest: int) -> np.ndarray:
    """Tokens of the longest prefix that any m up to longest asks for."""
    return np.minimum(n - -(-percent * n // 100) + longest, n)


def _regroup(percent: int, longest: int):
    def run(t: pa.Table) -> pa.Table:
        """A chunk's documents; those that list shared tokens in their longest prefix with all their shared tokens, in the global order (total, then hash)."""
        own, tokens, totals, places = None, [], [], []
        for r in t.sort_by("part").to_pylist():
            if r["part"] < 0:
                own = r
                continue
            counts = unsqueeze(r["counts"], "<u4")
            mine, total = _risen(r["tokens"]), unsqueeze(r["totals"], "<u4")
            tokens.append(np.repeat(mine, counts)), totals.append(np.repeat(total, counts)), places.append(unsqueeze(r["places"], "<u4"))
            if (counts == 0).any():
                tokens.append(mine[counts == 0]), totals.append(total[counts == 0]), places.append(None)
        common, times, where = _risen(own["tokens"]), unsqueeze(own["counts"], "<u4"), unsqueeze(own["places"], "<u4")
        starts = np.cumsum(np.r_[0, times])
        for i, p in enumerate(places):
            if p is None:  # a common token's list is the chunk's own
                at = np.searchsorted(common, tokens[i])
                totals[i], tokens[i] = np.repeat(totals[i], times[at]), np.repeat(tokens[i], times[at])
                places[i] = np.concatenate([where[starts[j] : starts[j + 1]] for j in at])
        n = np.array(own["sizes"], np.int64)
        out: list = [None] * len(n)
        if tokens:
            token, total, place = np.concatenate(tokens), np.concatenate(totals), np.concatenate(places)
            order = np.lexsort((token, total, place))
            token, place = token[order], place[order]
            docs, first = np.unique(place, return_index=True)
            ends = np.r_[first[1:], len(place)]
            hopeful = n[docs] - (ends - first) < _prefix_length(n[docs], percent, longest)
            for d, a, b in zip(docs[hopeful], first[hopeful], ends[hopeful]):
                out[d] = token[a:b].view(np.int64)
        return pa.table({"doc_id": pa.array(own["ids"], pa.int64()), "key": pa.array(own["keys"], pa.int64()), "n": pa.array(own["sizes"], pa.int64()), "class": pa.array(own["classes"], pa.int64()), "tokens": pa.array(out, pa.list_(pa.int64()))})

    return run


def _digests(docs: DataFrame, k: int, percent: int, longest: int) -> DataFrame:
    """doc_id, key of its text, n, class (null without words) of each row of docs; tokens: the shared ones, where the longest prefix has some."""
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // (6 * RANGE)))
    counted = _send(docs, k, ranges).groupBy("to").applyInArrow(_count, _BACK_SQL)
    return stage(counted.groupBy("chunk").applyInArrow(_regroup(percent, longest), "doc_id long, key long, n long, class long, tokens array<long>"), "digests")


def reaches(longest: int) -> list[Column]:
    """reach_m for each m: the postings that a prefix of base + m tokens meets besides its own, from rows (pos, base, c: the length of the token's list)."""
    return [F.sum(F.when(F.col("pos") < F.col("base") + m, F.col("c") - 1).otherwise(0)).alias(f"reach_{m}") for m in range(1, longest + 1)]


def choose_m(longest: int) -> Column:
    """The number of shared tokens to ask for, from n, base and the reaches.

    For each m the cost is that of reading the prefix's postings and of verifying the candidates that may share m of its
    tokens: the postings' total divided by m, each as long as this set. Ties go to the smaller m.
    """
    cost = lambda m: F.col(f"reach_{m}") * (1 + (4 + F.col("n") / 64) / m) + 8 * m
    return F.array_min(F.array(*[F.when(F.col("n") - F.col("base") >= m, F.struct(cost(m).alias("cost"), F.lit(m).alias("m"))) for m in range(1, longest + 1)]))["m"]


def _classes(digests: DataFrame) -> DataFrame:
    """id, n, tokens of each class whose longest prefix has shared tokens."""
    each = digests.where("tokens is not null").groupBy(F.col("class").alias("id")).agg(F.any_value("n").alias("n"), F.any_value("tokens").alias("tokens"))
    return stage(each, "shared")


def _candidates(classes: DataFrame, percent: int, longest: int) -> DataFrame:
    """id (class), n, size (of its tokens), m, p (length of the prefix), prefix (its tokens that other classes list too) of classes with such tokens."""
    base = F.col("n") - F.ceil(percent * F.col("n") / 100).cast("long")
    rows = classes.select("id", "n", F.size("tokens").alias("size"), base.alias("base"), "tokens").withColumn("unique", F.col("n") - F.col("size"))
    part = F.slice("tokens", F.lit(1), (F.least(F.col("base") + longest, "n") - F.col("unique")).cast("int"))
    posts = rows.select("id", "n", "size", "base", "unique", F.posexplode(part).alias("at", "tok")).withColumn("pos", F.col("unique") + F.col("at")).drop("unique", "at")
    lists = posts.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    shared = posts.join(lists, "tok").groupBy("id", "n", "size", "base").agg(F.collect_list(F.struct("pos", "tok")).alias("shared"), *reaches(longest))
    chosen = stage(shared.select("id", "n", "size", "base", choose_m(longest).alias("m"), "shared").withColumn("p", F.col("base") + F.col("m")), "chosen")
    prefix = F.transform(F.filter("shared", lambda x: x.pos < F.col("p")), lambda x: x.tok)
    out = stage(chosen.select("id", "n", "size", "m", "p", prefix.alias("prefix")).where("size(prefix) > 0"), "candidates")
    discard(chosen)
    return out


def _families(candidates: DataFrame) -> DataFrame:
    """id, label: candidates that tokens of their prefixes connect have one label; those that nothing connects are left out."""
    posts = candidates.select("id", F.explode("prefix").alias("tok"))
    first = posts.groupBy("tok").agg(F.min("id").alias("first"))
    return components(posts.join(first, "tok").select(F.col("id").alias("u"), F.col("first").alias("v"))).withColumnRenamed("component", "label")


def _members(candidates: DataFrame) -> DataFrame:
    """Candidates with label and block: families one after another, a family's documents by their smallest token, in blocks of bounded size."""
    families = _families(candidates)
    rows = candidates.join(families, "id").withColumn("lead", F.array_min("prefix")).repartitionByRange("label", "lead", "id")
    dealt = stage(rows.withColumn("part", F.spark_partition_id()), "dealt")  # written once, so that counts and places are of the same parts
    weight = F.greatest(F.lit(1 / BLOCK), F.col("size") / BLOCK_TOKENS)
    totals = dealt.groupBy("part").agg(F.sum(weight).alias("w"))
    before = totals.select("part", (F.sum("w").over(Window.orderBy("part")) - F.col("w")).alias("before"))  # a row for each part
    place = F.sum(weight).over(Window.partitionBy("part").orderBy("label", "lead", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - weight
    out = dealt.withColumn("place", place).join(F.broadcast(before), "part").withColumn("block", F.floor(F.col("place") + F.col("before") + 1e-9).cast("long"))
    out = stage(out.drop("part", "place", "before", "lead"), "members")
    discard(dealt, families)
    return out


_COLUMNS = ("ids", "labels", "n", "m", "p", "prefix_ends", "prefixes", "set_ends", "sets")
_PACKED = "block long, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _pack(t: pa.Table) -> pa.Table:
    """The members of a block as one row of arrays."""
    t = t.sort_by([("label", "ascending"), ("id", "ascending")])
    got = [t[c].to_numpy().astype("i8") for c in ("id", "label", "n", "m", "p")]
    for c in ("prefix", "tokens"):
        lists = t[c].combine_chunks()
        got += [np.cumsum(lists.value_lengths().to_numpy()).astype("i8"), lists.flatten().to_numpy().astype("i8")]
    return pa.table({"block": t["block"].slice(0, 1)} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(_COLUMNS, got)})


def overlaps(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """How many elements each of the sets x shares with each of y (None: with each of x), by products of 0/1 matrices."""

    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    vx, rx = flat(x)
    if y is None:
        values, column, times = np.unique(vx, return_inverse=True, return_counts=True)
        common = values[times > 1]
    else:
        vy, ry = flat(y)
        common = np.intersect1d(vx, vy)
    out = np.zeros((len(x), len(x if y is None else y)), np.float64)
    if not len(common):
        return out

    def columns(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, v), len(common) - 1)
        hit = np.flatnonzero(common[at] == v)
        hit = hit[np.argsort(at[hit], kind="stable")]
        return at[hit], r[hit]

    cx, rx = columns(vx, rx)
    cy, ry = (cx, rx) if y is None else columns(vy, ry)

    def part(c: np.ndarray, r: np.ndarray, lo: int, rows: int) -> np.ndarray:
        i, j = np.searchsorted(c, [lo, lo + COLUMNS])
        dense = np.zeros((rows, min(COLUMNS, len(common) - lo)), np.float32)
        dense[r[i:j], c[i:j] - lo] = 1
        return dense

    for lo in range(0, len(common), COLUMNS):
        left = part(cx, rx, lo, len(x))
        out += left @ (left if y is None else part(cy, ry, lo, out.shape[1])).T
    return out


def _links(a: dict, b: dict | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as (id, root), of the links in a block (b None) or between two; only documents of one family are compared."""
    found, other = [], a if b is None else b
    for label in np.unique(a["labels"] if b is None else np.intersect1d(a["labels"], b["labels"])):
        i, j = np.flatnonzero(a["labels"] == label), np.flatnonzero(other["labels"] == label)
        if b is None and len(i) < 2:
            continue
        rows = lambda d, at, ends, values: [d[values][(d[ends][x - 1] if x else 0) : d[ends][x]] for x in at]
        shared = overlaps(rows(a, i, "prefix_ends", "prefixes"), None if b is None else rows(other, j, "prefix_ends", "prefixes"))
        na, nb = a["n"][i][:, None], other["n"][j][None, :]
        pa_, pb = a["p"][i][:, None], other["p"][j][None, :]
        # the prefix that ends earlier in the global order leaves out its set's other tokens and no more, so at most these are shared besides
        may = (shared >= np.minimum(a["m"][i][:, None], other["m"][j][None, :])) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
        may &= (100 + percent) * (shared + np.maximum(na - pa_, nb - pb)) >= percent * (na + nb)
        if b is None:
            may &= i[:, None] < j[None, :]
        x, y = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(x):
            continue
        if b is None:
            x = y = np.union1d(x, y)
        whole = overlaps(rows(a, i[x], "set_ends", "sets"), None if b is None else rows(other, j[y], "set_ends", "sets"))
        u, v = np.nonzero(may[np.ix_(x, y)] & (100 * whole >= percent * (na[x] + nb[:, y] - whole)))
        if not len(u):
            continue
        ids = np.concatenate([a["ids"][i[x]], other["ids"][j[y]]])
        root = forest(len(ids), u, v + (len(x) if b is not None else 0))
        if b is None:
            ids, root = ids[: len(x)], root[: len(x)]
        found += [(int(ids[t]), int(ids[r])) for t, r in enumerate(root) if t != r]
    return found


def _linked(packed: DataFrame, percent: int, two: bool) -> DataFrame:
    """u, v of forests over rows of one packed block, or of two."""

    def block(batch: pa.RecordBatch, row: int, at: int) -> dict:
        return {c: np.frombuffer(batch.column(at + n)[row].as_py(), np.int64) for n, c in enumerate(_COLUMNS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                links = _links(block(batch, row, 0), block(batch, row, len(_COLUMNS)) if two else None, percent)
                yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return packed.mapInArrow(run, "u long, v long")


def _block_pairs(members: DataFrame) -> DataFrame:
    """a < b: blocks that hold documents of one family with a token of their prefixes in common."""
    wide = members.groupBy("label").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select("label")
    posts = members.join(wide, "label").select("block", F.explode("prefix").alias("tok")).distinct()
    return posts.select("tok", F.col("block").alias("a")).join(posts.select("tok", F.col("block").alias("b")), "tok").where("a < b").select("a", "b").distinct()


def join_classes(digests: DataFrame, percent: int, longest: int = 6) -> DataFrame:
    """id, component (both classes) of all classes that link with another."""
    classes = _classes(digests)
    candidates = _candidates(classes, percent, longest)
    members = _members(candidates)
    blocks = stage(members.join(classes.select("id", "tokens"), "id").groupBy("block").applyInArrow(_pack, _PACKED), "blocks")
    pairs = stage(_block_pairs(members), "block_pairs")
    side = lambda x: blocks.select(F.col("block").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in _COLUMNS])
    both = pairs.join(side("a"), "a").join(side("b"), "b").drop("a", "b")
    edges = stage(_linked(blocks.drop("block"), percent, False).unionByName(_linked(both, percent, True)), "links")
    discard(classes, candidates, members, blocks, pairs)
    out = components(edges)
    discard(edges)
    return out


def groups(docs: DataFrame, k: int, percent: int, longest: int = 6) -> DataFrame:
    """A row for each row of docs: doc_id, key (text_key), n, group (a class; null without words), component_id (smallest doc_id of the group)."""
    digests = _digests(docs, k, percent, longest)
    each = digests.select("doc_id", "key", "n", "class")
    linked = join_classes(digests, percent, longest)
    least = each.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    classes = least.join(linked.withColumnsRenamed({"id": "class", "component": "root"}), "class", "left")
    roots = classes.where("root is not null").groupBy("root").agg(F.min("least").alias("of_root"))
    classes = classes.join(roots, "root", "left").select("class", F.coalesce("root", "class").alias("group"), F.coalesce("of_root", "least").alias("component_id"))
    out = stage(each.join(classes, "class", "left").select("doc_id", "key", "n", "group", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "groups")
    discard(digests, linked)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, longest: int = 6) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Documents link when their sets of k-word shingles have 100 * intersection >= percent * union. Documents with
    equal sets are one class and join once, whatever their number. Texts without words or null link with nothing. A row whose doc_id
    is null links as any other, but its own component_id is null. Rows that share a doc_id are texts of their own,
    each in the component of its own text. An empty table gives none; other columns aren't read. Texts of any length count whole:
    a long document is a block of its own. Ties of tokens are ordered by hash. Shingles are told apart by 48-bit hashes,
    classes of equal sets by 64 bits. A task that is repeated must meet the rows of docs in the same order, as from files.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return groups(docs, k, percent, longest).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (any columns) without near duplicates: exactly one row of each group stays, that of the smallest doc_id.

    Ties, where rows share that doc_id, go to the smallest text_key; of rows that repeat both, any one stays. A null doc_id comes after all others.
    Rows without words link with nothing and all stay. The order of docs' rows and columns called like this operator's own don't matter.
    """
    found = groups(docs, k, percent).where("group is not null")
    same = found.groupBy("group", "doc_id", "key").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    kept = found.groupBy("group").agg(least.alias("x")).select(F.col("x.doc_id").alias("kept_id"), F.col("x.key").alias("kept_key"))
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    judged = stage(same.join(kept, is_kept, "left").select("doc_id", "key", F.col("kept_key").isNotNull().alias("stays"), "rows").where("not stays or rows > 1"), "judged")
    names = {"doc_id": f"id_{uuid.uuid4().hex[:8]}", "key": f"key_{uuid.uuid4().hex[:8]}"}
    listed = judged.withColumnsRenamed(names)
    at = F.col("doc_id").cast("long").eqNullSafe(listed[names["doc_id"]]) & (text_key() == listed[names["key"]])
    alone = docs.join(listed, at, "left_anti")
    repeated = docs.join(listed.where("stays"), at, "left_semi")
    one = repeated.withColumn(names["key"], text_key()).dropDuplicates(["doc_id", names["key"]]).drop(names["key"])
    return alone.unionByName(one)


#: The contract's query in DuckDB (three words, 90 %): links through common shingles, components by reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS s FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS sizes, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 90 * (sizes - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN component USING (doc_id)
"""
