import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import op2_mixing, op3_toxicity, op9_private_data, op10_url_filter

# The base patterns as the contract has them.
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def counts(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": all(int(p) <= 255 for p in match.split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if counts(k, m[0])]
    return [x[2] for x in sorted(found)]


PRIVATE = [
    "mail a.b@c.d-e.f, then 🙂 x@y.z_q@r.s and @no and a@b", "ips 1.2.3.4.5.6.7.8 300.1.1.1 0255.000.1.9 1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 79927398713",
    "call +1 (212) 555-0199 or +44 20 7946 0958. +1(((((2 +123456789", "", None, "a" * 60_000, "1" * 60_000, "a.b@" + "c." * 20_000 + "d", "9 " * 30_000, "x@y.z" * 3000, "+1" * 20_000, "1.1.1.1" * 2000, "é 5500 0000 0000 0004\n5500000000000004 4111111111111111,4111111111111111",
]


def test_base_spans_equal_plain_expressions(spark, docs_of):
    rng = random.Random(8)
    rows = [*PRIVATE, *["".join(rng.choices("ab1234567890 .-+@()_é🙂", k=300)) for _ in range(300)]]
    docs = docs_of(list(enumerate(rows))).withColumnRenamed("lang", "spans")
    got = {r.doc_id: r for r in op9_private_data.find_private_data(docs).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(rows):
        want = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("id:")] == want
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k + ":") for s in want) for k in BASE]


def test_contexts_find_unseen_identifiers(spark, docs_of):
    rows = [f"client number 4111111111111111 thanks number {i}" for i in range(6)] + [f"word {i} account ref user{i}@mail.org today" for i in range(8)]
    rows += ["please account ref ZX-99812 today", "the year 1999 was good", "some 42 things"]
    got = {r.doc_id: r for r in op9_private_data.find_private_data(docs_of(list(enumerate(rows)))).collect()}
    unseen = rows[14].index("ZX")
    assert got[14].spans == f"id:{unseen}:{unseen + 8}" and got[14].n_id == 1
    assert got[15].n_id == got[16].n_id == 0


def test_private_data_of_repeated_rows_and_nothing(spark, docs_of):
    got = op9_private_data.find_private_data(docs_of([(None, "a@b.c"), (2, "a@b.c"), (2, "a@b.c")])).collect()
    assert [r.spans for r in got] == ["email:0:5"] * 3
    assert op9_private_data.find_private_data(docs_of([])).collect() == []


def test_known_strings_are_found_outside_base_spans(spark, docs_of):
    rows = [f"please call +{i} (0{i}7) 555-77{i} thanks" for i in range(10, 18)] + [f"reach desk user{i}@mail.org today" for i in range(8)]
    rows += ["reach desk 555-7713 today", "we vote +13 here", "some (0137) things", "a 555-7713 b"]
    got = [r.spans for r in sorted(op9_private_data.find_private_data(docs_of(list(enumerate(rows)))).collect(), key=lambda r: r.doc_id)]
    assert got[16:] == ["id:11:19", "", "", ""]


def test_seeds_without_a_digit_induce_patterns(spark, docs_of):
    rows = [f"word reach desk {n}.smith@mail.org today" for n in ("john", "ann", "bob", "eve", "kim", "lee")] + ["word reach desk ZX-99812 today", "in 1999 it was"]
    got = [r.spans for r in sorted(op9_private_data.find_private_data(docs_of(list(enumerate(rows)))).collect(), key=lambda r: r.doc_id)]
    assert got[6:] == ["id:16:24", ""]


URLS = ["https://WWW.Example.com/en/1?x=/es/", "http://example.com", "http://example.com/en/", "http://sub.www.example.com/en/q#f", "ftp://a.net/es/", "http://net/fr/x", "http://xnet/fr/x", "no scheme.com/", None, "", "://com/", "http://a.com:80/", "http://m.a.org/p.html?utm_source=z", "http://www.a.org/p/", "http://a.org/p", "http://a.org/q", "http://b.org/?a://b.com/", "x://y://com/"]


def test_urls_by_rule_and_list_equal_sql(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("h")).withColumn("rule", F.lit("clash"))
    got = op10_url_filter.judge(pages, op10_url_filter.tracked(pages)).toPandas()
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    want = con.execute(op10_url_filter.ORACLE).df()
    key = lambda df: sorted(map(str, df[["page_id", "host", "path", "rule", "verdict", "listed"]].astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))
    assert [k.replace(".0,", ",") for k in key(got)] == [k.replace(".0,", ",") for k in key(want)]
    by = {r.page_id: r for r in got.itertuples()}
    assert by[0].verdict == "allow" and by[0].rule == "www.example.com/en/" and by[2].rule == "example.com/en/" and by[5].rule == "net/fr/" and by[6].verdict == "allow"
    assert [by[i].verdict for i in (12, 13, 14, 15)] == ["block", "block", "block", "allow"]


def test_bloom_has_no_false_negative_and_few_hits(spark):
    urls = spark.range(2_000).select(F.concat(F.lit("host"), "id", F.lit(".org/p")).alias("canon"))
    blocks = 1 << 7
    table = op10_url_filter.bloom_blocks(urls, blocks)
    probe = spark.range(4_000).select(F.concat(F.lit("host"), "id", F.lit(".org/p")).alias("canon"), "id")
    block, masks = op10_url_filter._block_and_masks(F.col("canon"), blocks)
    hit = F.lit(True)
    for w, m in enumerate(masks):
        hit = hit & (F.col(f"m{w}").bitwiseAND(m) == m)
    rows = probe.withColumn("block", block).join(table, "block", "left").select("id", F.coalesce(hit, F.lit(False)).alias("hit")).collect()
    assert all(r.hit for r in rows if r.id < 2_000)
    assert sum(r.hit for r in rows if r.id >= 2_000) < 100


def test_no_pages_and_no_list(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert op10_url_filter.judge(none, none.select("url")).collect() == []
    one = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert op10_url_filter.judge(one, none.select("url")).first().verdict == "allow"


def fill(budget, nodes):
    """Water-filling with integers: {name: (capacity, weight)} -> {name: budget}."""
    open_, out = dict(nodes), {}
    while open_:
        weight, left = sum(w for _, w in open_.values()), budget - sum(out.values())
        full = [n for n, (c, w) in open_.items() if c * weight <= left * w]
        if not full:
            return out | {n: left * w // weight for n, (c, w) in open_.items()}
        n = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        out[n] = open_.pop(n)[0]
    return out


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "src0", 100), ("web", "en", "src1", 5), ("web", "de", "src2", 50), ("books", "en", "src10", 10), ("forum", "fr", "src19", 400), ("forum", "es", "src15", 0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.b for r in op2_mixing.budgets(df, 300, 2, op2_mixing.WEIGHTS).collect()}
    w = lambda level, n: op2_mixing.WEIGHTS[level].get(n, 1)
    want, cap = {}, lambda *p: sum(2 * t for *q, t in leaves if tuple(q[: len(p)]) == p)
    for dom, b in fill(300, {d: (cap(d), w("domain", d)) for d, *_ in leaves}).items():
        for lang, c in fill(b, {x[1]: (cap(dom, x[1]), w("lang", x[1])) for x in leaves if x[0] == dom}).items():
            for src, e in fill(c, {x[2]: (cap(dom, lang, x[2]), w("source", x[2])) for x in leaves if x[:2] == (dom, lang)}).items():
                want[dom, lang, src] = e
    assert got == want and got["books", "en", "src10"] == 20


def mixed_rows(seed=1, n=300):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 7, 40])), rng.choice(["en", "de", "fr", None]), rng.choice(["src0", "src0", "src0", "src3", "src11", "src17", None]), 0) for i in range(n)]


def test_mix_equals_sql(spark):
    rows = [r for r in mixed_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("tokens", F.lit("clash"))
    got = op2_mixing.mix(df, op2_mixing.source_domain(F.coalesce("source", F.lit("")))).toPandas()
    con = duckdb.connect()
    con.register("documents", df.drop("tokens").toPandas())
    want = con.execute(op2_mixing.ORACLE).df()
    key = lambda x: sorted(x[["doc_id", "domain", "lang", "source", "tokens", "full_epochs", "prefix_tokens"]].itertuples(index=False, name=None))
    assert key(got) == key(want)
    taken, total = (got.tokens * got.full_epochs + got.prefix_tokens).sum(), sum(len(r[1].split()) for r in rows)
    assert 0.6 * total - 12 <= taken <= 0.6 * total


def test_mixed_documents_keep_their_words(spark):
    rows = [(i, f" \tfirst{i}  second\nthird fourth ", "en", "src1", 0) for i in range(50)] + [(99, None, "en", "src1", 0), (98, "", None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = op2_mixing.mixed_documents(df, op2_mixing.source_domain(F.coalesce("source", F.lit(""))), 0.51).collect()
    words = [len(r.text.split()) for r in got]
    assert sum(words) == int(200 * 0.51) and sorted(set(words)) == [2, 4] and words.count(2) == 1
    for r in got:
        assert f" \tfirst{r.doc_id}  second\nthird fourth ".startswith(r.text) and r.doc_id < 50
    assert op2_mixing.mix(df.limit(0), F.lit("web")).collect() == [] and op2_mixing.mixed_documents(df.limit(0), F.lit("web"), 0.5).collect() == []


def toxic_table(spark, n=600):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w, toxic = rng.choices(words, k=rng.choice([5, 40, 200])), rng.random() < 0.2
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "scum", "filth"]) + rng.choice(["", ".", ","]))
        docs.append((i, " ".join(w), rng.choice(["en", "de"]), "src1", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(n, None, "en", None, 0), (n + 1, "", None, None, 0), (n + 2, "vile " * 30_000, "xx", None, 0), (n + 2, "vile " * 30_000, "xx", None, 0)]
    labels += [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    out = op3_toxicity.score_table(spark, docs.withColumn("score", F.lit("clash")), labels).toPandas()
    assert len(out) == 604 and out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = out[out.held_out & out.doc_id.isin(truth)]
    y = held.doc_id.map(truth)
    assert (held.predicted == y).mean() > 0.95
    assert out[out.doc_id == 602].predicted.tolist() == [1, 1] and out[out.doc_id == 600].predicted.tolist() == [0]


def test_no_labels_and_no_documents(spark):
    docs, labels = toxic_table(spark, 30)
    assert op3_toxicity.score_table(spark, docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert op3_toxicity.score_table(spark, docs.limit(0), labels).collect() == []


def test_scores_do_not_depend_on_neighbours():
    model = op3_toxicity.TextCnn()
    texts = [op3_toxicity.word_rows(t) for t in ("a b c", "", "scum", "x " * 500)]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts])


def small_cnn(seed=3):
    model = op3_toxicity.TextCnn(dims=3, filters=4, seed=seed)
    rng = np.random.default_rng(seed)
    model.bias, model.shift = rng.normal(0, 0.2, len(model.bias)).astype("f4"), np.float32(0.1)
    return model, [rng.integers(1, 40, n).astype(np.int32) for n in (0, 1, 2, 9, 30)]


def plain_scores(model, texts):
    """Every filter at every place of every text, word by word; a text is followed by empty places."""
    out = []
    for t in texts:
        rows = [model.table[r].astype("f8") for r in t] + [np.zeros(model.dims)] * max(model.widths)
        z = float(model.shift)
        for w, kernel in enumerate(model.kernel):
            for f in range(model.filters):
                best = max(sum(float(rows[i + j] @ kernel[j][:, f]) for j in range(len(kernel))) for i in range(max(1, len(t))))
                z += max(best + float(model.bias[w * model.filters + f]), 0.0) * float(model.out[w * model.filters + f])
        out.append(1 / (1 + np.exp(-z)))
    return np.array(out)


def test_pooled_scores_equal_a_plain_convolution():
    model, texts = small_cnn()
    assert np.allclose(model.scores(texts), plain_scores(model, texts), atol=1e-5)


def test_gradients_equal_differences():
    model, texts = small_cnn()
    y = np.array([0, 1, 1, 0, 1], "f4")
    grad = model.gradients(texts, y)

    def loss():
        p = plain_scores(model, texts)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    rng = np.random.default_rng(0)
    for name, value in {"table": model.table, "bias": model.bias, "out": model.out, **{f"k{w}": k for w, k in enumerate(model.kernel)}}.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            at = (int(rng.choice(texts[3])), *at[1:]) if name == "table" else at
            before, sides = value[at], []
            for step in (1e-3, -1e-3):
                value[at] = before + step
                sides.append(loss())
            value[at] = before
            assert abs((sides[0] - sides[1]) / 2e-3 - grad[name][at]) < 2e-3, (name, at)


def test_clashing_columns_pass_the_filter(spark):
    model, _ = small_cnn()
    docs = spark.createDataFrame([(1, "a b", "en", "mine", 3), (2, None, None, None, None)], "doc_id long, text string, lang string, score string, threshold int")
    model.threshold = 2.0
    assert op3_toxicity.accepted(docs, model).collect() == docs.collect()


def plain_discovery(candidates, rounds=3, sure=0.6, support=3):
    edges, seeds, score = {}, set(), {}
    for c in candidates:
        for p in ("L:" + c.l, "R:" + c.r):
            edges.setdefault(p, set()).add(c.v)
        if c.seed:
            seeds.add(c.v)
    words = {c.v for c in candidates}
    score = {v: float(v in seeds) for v in words}
    total = lambda vs: sum(score[v] for v in vs)
    for _ in range(rounds):
        good = {p: total(vs) / (len(vs) + 2.0) for p, vs in edges.items() if len(vs) >= support}
        good = {p: x for p, x in good.items() if x > 0.05}
        new = {v: 1 - np.prod([1 - min(good[p], 0.999) for p, vs in edges.items() if v in vs and p in good]) for v in words}
        score = {v: 1.0 if v in seeds else new[v] if new[v] >= sure / 2 else 0.0 for v in words}
    found = {(v, None, None) for v in words if v not in seeds and score[v] >= sure}
    for c in candidates:
        if not c.seed and c.v in seeds:
            ps = [(total(edges[p]) - 1) / (len(edges[p]) - 1 + 2.0) for p in ("L:" + c.l, "R:" + c.r) if len(edges[p]) > support]
            if 1 - np.prod([1 - min(x, 0.999) for x in ps if x > 0.05]) >= sure:
                found.add((c.v, c.l, c.r))
    return found


def test_discovery_equals_plain_rounds(spark, docs_of):
    rng = random.Random(4)
    cues = ["mail", "id", "ref", "year", "call", "x" * 45 + "1", "x" * 45 + "2"]
    value = lambda: rng.choice([f"u{rng.randrange(30)}@m.org", f"Z-{rng.randrange(30)}", f"+1 (212) 555-01{rng.randrange(10, 99)}", str(1990 + rng.randrange(20)), "4111111111111111"])
    docs = docs_of([(i, " ".join(f"{rng.choice(cues)} {value()} {rng.choice(['now', 'end.', 'z'])}" for _ in range(rng.randrange(1, 6)))) for i in range(150)])
    candidates = op9_private_data._candidates(op9_private_data.base_spans(docs)).cache()
    got = {(r.v, r.l, r.r) for r in op9_private_data.discover(candidates).collect()}
    assert got == plain_discovery(candidates.collect()) and any(x[1] is None for x in got) and any(x[1] is not None for x in got)


def test_many_numbers_in_one_text(spark, docs_of):
    text = " ".join(f"n {i}.5" for i in range(5_000))
    words = op9_private_data._candidates(op9_private_data.base_spans(docs_of([(1, text)]))).orderBy("s").collect()
    assert len(words) == 5_000 and all(text[w.s : w.e] == f"{i}.5" for i, w in enumerate(words))
