import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import common, op4_line_chunks, op5_grid_order, op7_multi_index, op8_shingle_join, queries


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute_components(ids, linked):
    parent = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in ids}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200), (None, 3), (300, None)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + k: 100 for k in range(40)} | {200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "u long, v long")).collect() == []


def word_sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 20, 60, 200]))) for _ in range(12)]
    rows = []
    for _ in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2)])
def test_shingle_join_equals_brute_force(spark, docs_of, k, percent, seed):
    texts = [*near_texts(seed), "", None, "one", "ONE", "two words", "TWO  words", " \t\n", "tiny text here", "x " * 3000]
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    sets = {i: word_sets(t, k) for i, t in rows}
    want = brute_components(sorted(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and bool(sets[b]))
    got = op8_shingle_join.near_duplicates(docs_of(rows).withColumnRenamed("lang", "component_id"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_large_family_is_merged_whole(spark, docs_of):
    """A family of near copies larger than any pair list, with chains that only neighbours link."""
    rng, words = random.Random(5), [f"v{i}" for i in range(500)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(240):
        w = list(base)
        for _ in range(rng.choice([1, 2])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    sets = {i: word_sets(t, 3) for i, t in rows}
    want = brute_components(sorted(sets), lambda a, b: 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in op8_shingle_join.near_duplicates(docs_of(rows), 3, 90).collect()}
    assert got == want


def test_prefix_lengthens_with_common_tokens(spark):
    rows = [(0, 298, 29, i, 2) for i in range(35)] + [(1, 298, 29, i, 50_000) for i in range(35)] + [(2, 1, 0, 0, 9)] + [(3, 298, 29, i, 50_000 if i > 30 else 2) for i in range(35)]
    reach = spark.createDataFrame(rows, "id int, n long, base long, pos long, c long").groupBy("id", "n", "base").agg(*op8_shingle_join.reaches(6))
    got = {r.id: r.m for r in reach.withColumn("m", op8_shingle_join.choose_m(6)).collect()}
    assert got[0] < got[1] <= 6 and got[2] == 1 and got[3] == 2


@pytest.mark.parametrize("chunk, common", [(1 << 21, 64), (300, 2), (40, 3)])
def test_shared_tokens_come_back_in_order(spark, docs_of, monkeypatch, chunk, common):
    """Chunks of any size return each class's shared tokens, rarest first."""
    monkeypatch.setattr(op8_shingle_join, "CHUNK", chunk)
    monkeypatch.setattr(op8_shingle_join, "COMMON", common)
    rows = list(enumerate([*near_texts(3)[:70], "", None]))
    got = op8_shingle_join._digests(docs_of(rows).coalesce(1), 3, 90, 6).collect()
    sets = {i: op8_shingle_join.shingles(t, 3) for i, t in rows}
    df = Counter(t for s in {s.tobytes(): s for s in sets.values()}.values() for t in s.tolist())
    seen = set()
    assert sorted(r.doc_id for r in got) == list(range(72))
    for r in sorted(got, key=lambda r: r.doc_id):
        s = sets[r.doc_id].tolist()
        want = sorted((t for t in s if df[t] > 1), key=lambda t: (df[t], t))
        hopeful = want and len(s) - len(want) < len(s) - -(-90 * len(s) // 100) + 6 and r["class"] not in seen
        seen.add(r["class"])
        assert r.n == len(s) and (r.tokens or []) == (want if hopeful else [])


def test_overlaps_of_sets():
    rng = np.random.default_rng(4)
    x, y = ([np.unique(rng.integers(-50, 50, n)) for n in sizes] for sizes in ((3, 0, 60, 9), (70, 5)))
    want = lambda p, q: [[len(np.intersect1d(a, b)) for b in q] for a in p]
    assert op8_shingle_join.overlaps(x, y).tolist() == want(x, y)
    both = op8_shingle_join.overlaps(x, None)
    assert (both - np.diag(np.diag(both))).tolist() == (np.array(want(x, x)) - np.diag([len(a) for a in x])).tolist()


def test_rows_without_id_or_table(spark, docs_of):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in op8_shingle_join.near_duplicates(docs_of([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "A b c d")]), 3, 90).collect()}
    assert got == {(None, 2, None), (4, 2, 4), (9, 2, 4)}
    assert op8_shingle_join.near_duplicates(docs_of([]), 3, 90).collect() == []


def brute_lines(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc_id] = None
            continue
        lines, keep = text.encode().split(b"\n"), []
        for lo, hi in op4_line_chunks.chunk_bounds(lines):
            chunk = op4_line_chunks._passage(lines, lo, hi, 50)
            if chunk is not None and chunk in seen:
                continue
            seen.add(chunk)
            keep += lines[lo:hi]
        out[doc_id] = b"\n".join(keep).decode()
    return out


def test_repeated_chunks_go(spark, docs_of):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choices("alpha beta gamma delta eps zeta".split(), k=6)) + str(rng.random())
    shared = [line() for _ in range(12)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, "\n".join([line(), *(shared if i % 3 else []), line(), *([passage] if i % 4 == 0 else [])])) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n\n\n"), (53, "\n\n\n\n"), (54, "short"), (55, "short"), (56, rows[1][1]), (57, "z " * 60_000)]
    docs = docs_of(rows).withColumn("n_removed", F.lit("clash")).withColumn("extra", F.lit(7))
    out = op4_line_chunks.dedup_lines(docs)
    got = {r.doc_id: r for r in out.collect()}
    want = brute_lines(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert got[56].text.count("\n") < rows[1][1].count("\n") and got[4].text.count("p59") == 0 and "p59" in got[0].text
    assert got[57].n_removed == 0 and got[54].text == got[55].text == "short" and got[3].extra == 7


def test_chunks_resist_shifts():
    lines = [f"line {i * 7919 % 1000}".encode() for i in range(200)]
    cut = lambda x: {tuple(x[lo:hi]) for lo, hi in op4_line_chunks.chunk_bounds(x)}
    before, after = cut(lines), cut([*lines[:5], b"new", *lines[5:]])
    assert len(before & after) >= 0.85 * len(before)


def test_line_dedup_of_repeated_rows_and_nothing(spark, docs_of):
    text = "\n".join(f"line {i}" for i in range(9))
    got = op4_line_chunks.dedup_lines(docs_of([(None, text), (5, text), (5, text)])).collect()
    assert sorted(r.text or "" for r in got if r.doc_id == 5) == sorted([got_text for got_text in [r.text for r in got if r.doc_id == 5]])
    assert [r.text for r in got if r.doc_id is None] == [text] and len({r.text for r in got if r.doc_id == 5}) == 1
    assert op4_line_chunks.dedup_lines(docs_of([])).collect() == []


def brute_runs(rows):
    """Texts less every line run that stands earlier: all starts, ends and earlier places are tried."""
    texts = {i: t.split("\n") for i, t in rows}
    passage = lambda run: sum(bool(x.strip()) for x in run) > 1 or any(len(x.split()) >= 50 for x in run)
    order, out = sorted(texts), {}
    for at, i in enumerate(order):
        mine, go = texts[i], set()
        for j in order[: at + 1]:
            theirs = texts[j]
            for lo in range(len(mine)):
                for p in range(len(theirs) if j < i else lo):
                    n = 0
                    while lo + n < len(mine) and p + n < (len(theirs) if j < i else lo) and mine[lo + n] == theirs[p + n]:
                        n += 1
                    run = mine[lo : lo + n]
                    if passage(run):
                        solid = [lo + k for k, x in enumerate(run) if x.strip()]
                        go |= set(range(solid[0], solid[-1] + 1))
        out[i] = "\n".join(x for k, x in enumerate(mine) if k not in go)
    return out


def test_repeated_runs_go_wherever_they_are_cut(spark, docs_of):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choices("alpha beta gamma delta eps".split(), k=rng.choice([1, 12, 30]))) + str(rng.random())
    shared = [[line() for _ in range(n)] for n in (2, 2, 3, 4, 5, 9)] + [[line(), "", line()], [" ".join(f"w{i}" for i in range(50))]]
    rows = []
    for i in range(40):
        parts = [[line() for _ in range(rng.randrange(3))], rng.choice(shared), [line()] * rng.randrange(4), rng.choice(shared), ["Title", ""][: rng.randrange(3)]]
        rows.append((i, "\n".join(x for p in parts for x in p)))
    rows += [(50, "a\na\na\na\nb"), (51, "single"), (52, "single\n\n"), (53, "\n\n")]
    got = {r.doc_id: r for r in op4_line_chunks.dedup_runs(docs_of(rows)).collect()}
    assert {i: r.text for i, r in got.items()} == brute_runs(rows)
    assert all(r.n_removed_lines == t.count("\n") + 1 - (r.text.count("\n") + 1 if r.text or not r.n_removed else 0) for i, t in rows for r in [got[i]] if r.text or not r.n_removed)
    again = op4_line_chunks.dedup_runs(docs_of([(None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1]), (6, None), (7, "")])).collect()
    assert sum(r.n_removed_lines for r in again if r.doc_id is None) == 0 and all(r.n_removed and not r.text.strip() for r in again if r.doc_id == 5)
    assert {r.doc_id: r.text for r in again if r.doc_id in (6, 7)} == {6: None, 7: ""}
    assert op4_line_chunks.dedup_runs(docs_of([])).collect() == []


def vectors(seed, n=500, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dims))
    x = centres[rng.integers(0, 25, n)] + rng.normal(size=(n, dims)) * rng.choice([0.01, 0.2, 0.5], n)[:, None]
    x[: n // 5] = x[0]
    return x.astype("f4")


ODD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [float("inf")] + [1.0] * 15), (9005, [None] + [1.0] * 15), (None, [1.0] * 16), (9006, [])]
VECTORS = "vec_id long, embedding array<float>, label int"


def test_grid_order_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op5_grid_order, "BLOCK", 64)
    monkeypatch.setattr(op5_grid_order, "LEAF", 16)
    x = vectors(4)
    rows = [(i * 3, v.tolist(), None) for i, v in enumerate(x)] + [(i, v, 1) for i, v in ODD]
    df = spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "kept").repartition(5)
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = brute_components([i * 3 for i in range(len(x))], lambda a, b: bool(near[a // 3, b // 3]))
    got = {r.vec_id: r for r in op5_grid_order.near_vectors(df).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        r = got[i * 3]
        assert (r.n_links, r.component_id, r.kept) == (near[i].sum() - 1, want[i * 3], want[i * 3] == i * 3)
    for i, _ in ODD:
        assert (got[i].n_links, got[i].component_id) == (0, i)


def test_grid_order_skips_distant_blocks(spark, monkeypatch):
    monkeypatch.setattr(op5_grid_order, "BLOCK", 32)
    rng = np.random.default_rng(0)
    x = np.repeat(np.eye(8), 64, axis=0) + rng.normal(size=(512, 8)) * 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cid long, embedding array<double>").withColumn("c", F.lit(1).cast("long"))
    eps = float(np.sqrt(0.2))
    blocks = op5_grid_order._blocks(df, 8, op5_grid_order.principal_axes(df, 8), eps)
    n = blocks.count()
    assert op5_grid_order._near_pairs(blocks, eps).count() < n * (n + 1) / 4


def test_vectors_of_an_empty_table(spark):
    none = spark.createDataFrame([], VECTORS)
    assert op5_grid_order.near_vectors(none).collect() == [] and op7_multi_index.search(none).collect() == []
    odd = spark.createDataFrame([(i, v, 1) for i, v in ODD], VECTORS)
    assert len(op5_grid_order.near_vectors(odd).collect()) == len(ODD) and op7_multi_index.search(odd).count() == 0


def brute_nearest(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_search_of_all_cells_is_exact(spark):
    x = vectors(6, 300).astype("f8")
    ids = np.arange(len(x)) * 5
    rows = [(int(i), v.tolist(), 0) for i, v in zip(ids, x)] + [(i, v, 1) for i, v in ODD]
    got = op7_multi_index.search(spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "rank"), wanted=1.0).collect()
    want = brute_nearest(ids, x.astype("f4").astype("f8"), 20)
    for q, near in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [v for v, _ in near] and [r.rank for r in mine] == list(range(1, 21))
        assert np.allclose([r.score for r in mine], [s for _, s in near], rtol=1e-12)
    assert {r.query_id for r in got} == set(want)


def test_search_recall_when_cells_are_skipped(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x.astype("f4"))], VECTORS)
    got = op7_multi_index.search(df).collect()
    want = brute_nearest(np.arange(4000), x.astype("f4").astype("f8"), 20)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {v for v, _ in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_recall_of_mixed_norms(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(3000, 32)) * rng.lognormal(0, 0.7, 3000)[:, None] / 32**0.5).astype("f4")
    got = op7_multi_index.search(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)).collect()
    want = brute_nearest(np.arange(3000), x.astype("f8"), 20)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {v for v, _ in near}) for q, near in want.items())
    print("recall", hits / sum(map(len, want.values())))
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_traversal_takes_pairs_in_order():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random(9), rng.random(9)
    ones = np.ones((9, 9), int)
    taken, last = op7_multi_index.traverse(d1, d2, ones / 81, 30 / 81 - 1e-9, ones, 5)
    sums = d1[:, None] + d2
    assert taken.sum() == 30 and sums[taken].max() == last < sums[~taken].min()
    assert op7_multi_index.traverse(d1, d2, ones / 81, 0.0, ones, 7)[0].sum() == 7 and op7_multi_index.traverse(d1, d2, ones / 81, np.inf, ones, 0)[0].all()


def test_expected_cells_hold_the_neighbours():
    """Over isotropic vectors, the cells that hold so much of what is expected hold about as much of the nearest."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    books = op7_multi_index.codebook(x[:, :8], 12, 1), op7_multi_index.codebook(x[:, 8:], 12, 2)
    cell = op7_multi_index.distances(x[:, :8], books[0]).argmin(1) * 12 + op7_multi_index.distances(x[:, 8:], books[1]).argmin(1)
    counts = np.bincount(cell, minlength=144).reshape(12, 12)
    model = op7_multi_index.Expectation(books, (x[:, :8] - books[0][cell // 12], x[:, 8:] - books[1][cell % 12]), counts, 20)
    held = 0.0
    for q in rng.normal(size=(60, 16)):
        expected = model.cells(q[:8], q[8:]).ravel()
        assert abs(expected.sum() - 1) < 0.1
        order = np.argsort(-expected)
        best = order[: np.searchsorted(np.cumsum(expected[order]), 0.8) + 1]
        held += np.isin(cell[np.argsort(-(x @ q))[:20]], best).mean() / 60
    assert 0.7 < held < 0.95


def test_tail_of_the_normal_distribution():
    z = np.array([-2.0, -1.0, 0.0, 1.0, 2.0, 3.0])
    assert np.allclose(op7_multi_index.above(z), [0.97725, 0.84134, 0.5, 0.15866, 0.02275, 0.00135], rtol=0.05)


@pytest.mark.parametrize("block, columns", [(5, 16), (256, 4096)])
def test_families_over_several_blocks(spark, docs_of, monkeypatch, block, columns):
    """Families larger than a block, repeated ids and texts, null ids: groups and the rows that stay are those of brute force."""
    monkeypatch.setattr(op8_shingle_join, "BLOCK", block)
    monkeypatch.setattr(op8_shingle_join, "COLUMNS", columns)
    texts = [t for t in near_texts(11) if len(t) > 40][:90]
    rows = [(None if i % 17 == 3 else i % 60, t) for i, t in enumerate(texts)]
    rows += [(5, texts[5]), (5, "alone here with that id"), (8, texts[8]), (8, texts[8]), (70, ""), (71, None), (None, "")]
    sets = [word_sets(t, 3) for _, t in rows]
    group = brute_components(list(range(len(rows))), lambda a, b: bool(sets[a]) and bool(sets[b]) and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[group[i]] = min(least.get(group[i], doc_id), doc_id)
    docs = docs_of(rows).withColumn("key", F.lit("own")).withColumn("group", F.col("doc_id")).withColumn("stays", F.lit(1))
    key = lambda x: (x[0] is None, x)
    want = sorted(((d, len(s), None if d is None else least.get(group[i], d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)
    assert sorted(map(tuple, op8_shingle_join.near_duplicates(docs, 3, 90).collect()), key=str) == want
    kept = op8_shingle_join.one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    each = {g: {(d, t) for i, (d, t) in enumerate(rows) if group[i] == g} for g in set(group.values())}
    for g, members in each.items():
        if sets[g]:
            ids = [d for d, _ in members if d is not None]
            mine = [x for x in got if x in members]
            assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)
    assert sorted(map(key, (x for x in got if not (x[1] or "").split()))) == sorted(map(key, (x for x in rows if not (x[1] or "").split())))


@pytest.mark.parametrize("name, key", [("op5_grid_order_join", "vec_id"), ("op8_shingle_join_classes", "doc_id")])
def test_queries_equal_their_sql(spark, name, key):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df().sort_values(key)
    got = queries.queries()[name](spark, sf).toPandas().sort_values(key)
    assert got[sorted(got)].values.tolist() == want[sorted(want)].values.tolist() and len(got)
