import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lumenflow.llm import op1_wavelet, op6_packing
from lumenflow.llm.tokens import PieceCache, cache_for

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a  b\n\n c\t d ", "it's DON'T <|endoftext|> x y z\x1cq", "Ünï ½ ² é 日本語 🙂🙂   a", " \n ", "  x", "x  ", "a\r\nb", "ΑΣ Σ İstanbul", "word " * 3000, "x" * 20_000, "one two\nthree four", "é café"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_pieces_encode_like_the_library(path):
    cache, tok = PieceCache(path, words=40), Tokenizer.from_file(path)
    for text in TEXTS * 2:
        assert np.frombuffer(cache.encode(text), cache.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids
    assert cache.encode(None) == b""


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_many_texts_encode_like_the_library(path):
    """Odd words, and the tables' own texts, by caches that hold few or all of them."""
    rng, tok = random.Random(2), Tokenizer.from_file(path)
    letters = "aZé'sdtllm.,;-_0123 ÿÀß\n$%(x)\"" + "e" * 9
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(1500)]
    texts += [r.text for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas().itertuples()] + TEXTS + [None, "a <|endoftext|> b", "x" * 70 + " y"]
    for words in (40, 100_000):
        cache = PieceCache(path, words=words)
        got = [np.frombuffer(x, cache.dtype).tolist() for x in map(cache.encode, texts)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_operators_encode_added_tokens_like_the_library(path):
    cache, tok = cache_for(path), Tokenizer.from_file(path)
    for text in [*TEXTS, "a <|endoftext|> b", "<|startoftext|>", "x<|ENDOFTEXT|>  y", "日<|endoftext|><|endoftext|>\n", "<|endoftext|"]:
        assert np.frombuffer(cache.encode(text), cache.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n, alphabet", [(0, 1), (1, 1), (7, 1), (5000, 3), (70_000, 900)])
def test_shard_answers_like_an_array(tmp_path, n, alphabet):
    ids = np.random.default_rng(1).integers(0, alphabet, n).astype("<u4") * 7
    lengths = [n // 2, n - n // 2]
    uri = f"file://{tmp_path}/s.wvm"
    op1_wavelet.put(uri, op1_wavelet.shard_bytes([3, None], lengths, ids))
    shard = op1_wavelet.Shard(uri)
    assert (shard.tokens() == ids).all()
    assert shard.documents()[0] == [3, None] and shard.documents()[1].tolist() == [0, n // 2, n]
    for i in range(0, n, max(1, n // 40)):
        assert shard.access(i) == ids[i]
    for token in {*ids[:5].tolist(), 7, 12345}:
        at = np.flatnonzero(ids == token)
        assert shard.count(token) == len(at) and shard.count(token, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        for r in range(0, len(at), max(1, len(at) // 5)):
            assert shard.select(token, r) == at[r]
        if len(at) < 50:
            assert shard.occurrences(token) == at.tolist()
        with pytest.raises(IndexError):
            shard.select(token, len(at))


def expected_ids(path, text):
    tok = Tokenizer.from_file(path)
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_round_trip_of_odd_rows(spark, docs_of):
    rows = [(9, "b c"), (2, None), (5, ""), (5, "tie"), (7, "same"), (7, "same"), (-3, "x" * 5000), (11, "w " * 4000), (12, "a <|startoftext|> b"), (13, "x<|EndOfText|>")]
    got = op1_wavelet.round_trip(spark, docs_of(rows).withColumnRenamed("lang", "start"), WORD).collect()
    assert len(got) == len(rows)
    at = 0
    expected = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    for row, (doc_id, text) in zip(sorted(got, key=lambda r: r.start), expected):
        ids = expected_ids(WORD, text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_null_id_and_empty_table(spark, docs_of):
    got = op1_wavelet.round_trip(spark, docs_of([(None, "a"), (1, "b")]), WORD).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1]
    assert op1_wavelet.round_trip(spark, docs_of([]), WORD).collect() == []


def test_small_shards_are_many_files(spark, docs_of, tmp_path):
    manifest = op1_wavelet.write_shards(docs_of([(i, f"text number {i}") for i in range(50)]), f"file://{tmp_path}/w", WORD, tokens_per_shard=20)
    assert manifest.count() > 5
    got = op1_wavelet.read_shards(manifest).orderBy("doc_id").collect()
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = op6_packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check_packing(got, rows):
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    sizes = []
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
        assert at == 2048 or at & (at - 1) == 0
    assert sum(sizes) == sum(len(expected_ids(BYTE, t)) for _, t in rows)
    for doc_id, text in rows:
        ids, at = expected_ids(BYTE, text), 0
        for r in sorted(pieces[doc_id, len(ids)], key=lambda r: r.start):
            if [x[0] for x in rows].count(doc_id) == 1:
                assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
                at += r.length


def test_packing_of_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "long " * 6000), (4, "copy of it"), (5, "copy of it"), (None, "no id"), (6, "rep"), (6, "rep"), (7, "日本語 text")]
    rows += [(100 + i, f"document {i} has words " * (i % 7 + 1)) for i in range(60)]
    check_packing(op6_packing.pack(docs_of(rows).withColumnRenamed("source", "offset"), BYTE).collect(), rows)


def test_packing_nothing(spark, docs_of):
    assert op6_packing.pack(docs_of([]), BYTE).collect() == []
