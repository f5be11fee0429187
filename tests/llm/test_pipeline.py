import corpus_pipeline
from tests_llm_helpers import SF, write_platform

from lumenflow.llm import op8_shingle_join
from lumenflow.llm.tokens import PieceCache


def test_stages_in_turn(spark, tmp_path):
    write_platform(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = step(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in kept.items()}
    toxic = set(range(200, 220))
    assert not ids["toxicity"] & toxic and len(ids["toxicity"]) >= 210
    texts = {r.doc_id: r.text for r in kept["line_dedup"].collect()}
    assert sum("shared passage line 3" in t for t in texts.values()) == 1
    assert len(ids["near_duplicates"] & set(range(100, 110))) == 1
    found = {r.doc_id: r.component_id for r in op8_shingle_join.near_duplicates(kept["line_dedup"], 5, 80).collect()}
    assert ids["near_duplicates"] == {i for i, c in found.items() if i == c}
    words = lambda d: sum(len((r.text or "").split()) for r in d.collect())
    before, after = words(kept["near_duplicates"]), words(kept["mixing"])
    assert corpus_pipeline.SHARE * before - 40 <= after <= corpus_pipeline.SHARE * before
    cache = PieceCache(corpus_pipeline.tokenizer("byte_bpe_50k.json"))
    tokens = sum(len(cache.encode(r.text)) // 2 + 1 for r in kept["mixing"].collect())
    assert sum(r.length for r in kept["packing"].collect()) == tokens
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == rows(kept["packing"])


EXTRA = ("score", "threshold", "rejected", "n_removed", "key", "group", "stays", "tokens", "position", "n")
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(None, "no id here at all but words"), (5, None), (5, ""), (5, " \n\t"), (7, "twice the same text of a few words"), (7, "twice the same text of a few words"), (7, "another text under that id"), (8, LONG), (9, LONG + " end"), (10, "line one\n\nline two\nline one\n"), (11, "é 🙂 ÜBER <|endoftext|>"), (None, None)]


def odd_docs(spark):
    rows = [(i, t, [None, "en", "xx"][k % 3], [None, "src1"][k % 2], None, *[k * 100 + j for j in range(len(EXTRA))]) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA))


def test_stages_take_odd_rows_and_pass_their_columns(spark):
    docs = odd_docs(spark)
    given = {r.score: r for r in docs.collect()}
    kept = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept[name] = out.collect()
        for r in kept[name]:
            assert all(r[c] == given[r.score][c] for c in docs.columns if c not in ("text", "n_chars")), name
    assert len(kept["line_dedup"]) == len(ODD)
    texts = {r.score: r.text for r in kept["line_dedup"]}
    assert texts[100] is None and texts[200] == "" and texts[700] == LONG
    alone = sorted((r.doc_id or 0, r.text or "") for r in kept["near_duplicates"])
    want = [x for x in ODD if x != (7, ODD[4][1]) and x != (9, LONG + " end")] + [ODD[4]]
    assert alone == sorted((i or 0, t or "") for i, t in want)
    assert all((r.text or "").split() for r in kept["mixing"])
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    cache = PieceCache(corpus_pipeline.tokenizer("byte_bpe_50k.json"))
    assert sum(r.length for r in pieces) == sum(len(cache.encode(t)) // 2 + 1 for _, t in ODD)


def test_stages_take_an_empty_table(spark):
    docs = odd_docs(spark).limit(0)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns), name
