"""Toxicity by a convolutional text classifier over hashed words, trained here in numpy.

Words are hashed to rows of an embedding table; filters of several widths slide over the text, each keeps its largest
response, and a logistic layer reads these. Since a filter is linear, each (offset, filter) pair's response to each
table row is computed once, so scoring a whole text is a few lookups and sums per word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm.common import Recent, worker_cache

BUCKET_BITS = 15
PAD = 0  # row 0 of the table is all zeros and stands after each text's end
BATCH_WORDS = 30_000
STRIP = b".,;:!?\"'()[]{}<>"


def _bucket(word: bytes) -> int:
    return 1 + xxhash.xxh3_64_intdigest(word.strip(STRIP)) % ((1 << BUCKET_BITS) - 1)


def word_rows(text: str | None) -> np.ndarray:
    """A table row for each word of a whole text; a null text or one without words has none."""
    words = (text or "").lower().encode().split()
    return np.fromiter(map(worker_cache("op3-words", lambda: Recent(_bucket, 75_000)).__getitem__, words), np.int32, len(words))


@dataclass
class TextCnn:
    """dims: width of the embeddings; widths: filter widths, filters of each. thresholds: language -> smallest rejected score."""

    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    seed: int = 11
    thresholds: dict[str | None, float] = field(default_factory=dict)
    threshold: float = 0.5

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.table = rng.normal(0, 0.1, (1 << BUCKET_BITS, self.dims)).astype("f4")
        self.table[PAD] = 0
        self.kernel = [rng.normal(0, 0.3, (w, self.dims, self.filters)).astype("f4") for w in self.widths]
        self.bias = np.zeros(len(self.widths) * self.filters, "f4")
        self.out = rng.normal(0, 0.3, len(self.widths) * self.filters).astype("f4")
        self.shift = np.float32(0)

    def responses(self) -> list[list[np.ndarray]]:
        """By width and offset: each table row's part of each filter's response."""
        return [[self.table @ k[j] for j in range(len(k))] for k in self.kernel]

    def pooled(self, texts: list[np.ndarray], parts: list[list[np.ndarray]], places: bool = False):
        """Largest response of each filter in each text (before bias); with places, also where, and the padded rows of all texts."""
        gap = max(self.widths)
        rows = np.full(sum(len(t) for t in texts) + gap * len(texts) + gap, PAD, np.int32)
        starts = np.zeros(len(texts), np.int64)
        at = 0
        for i, t in enumerate(texts):
            starts[i], rows[at : at + len(t)] = at, t
            at += len(t) + gap
        best = np.empty((len(texts), len(self.bias)), "f4")
        where = np.empty(best.shape, np.int64) if places else None
        for w, of in enumerate(parts):
            r = of[0][rows[: at + 1]]
            for j in range(1, len(of)):
                r = r + of[j][rows[j : at + 1 + j]]
            cols = slice(w * self.filters, (w + 1) * self.filters)
            for i, t in enumerate(texts):
                seg = r[starts[i] : starts[i] + max(1, len(t))]
                if places:
                    k = seg.argmax(0)
                    where[i, cols] = starts[i] + k
                    best[i, cols] = seg[k, np.arange(self.filters)]
                else:
                    best[i, cols] = seg.max(0)
        return (best, where, rows) if places else best

    def scores(self, texts: list[np.ndarray], parts: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """Scores of texts (table rows), about BATCH_WORDS words at a time."""
        parts, out, at = parts or self.responses(), [], 0
        ends = np.cumsum([len(t) for t in texts])
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_WORDS)))
            z = np.maximum(self.pooled(texts[at:stop], parts) + self.bias, 0) @ self.out + self.shift
            out.append(1 / (1 + np.exp(-z.astype("f8"))))
            at = stop
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, texts: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss, by parameter: table, k0 and on (kernels), bias, out, shift."""
        best, where, rows = self.pooled(texts, self.responses(), True)
        act = np.maximum(best + self.bias, 0)
        z = act @ self.out + self.shift
        gz = ((1 / (1 + np.exp(-z)) - y) / len(texts)).astype("f4")
        gact = gz[:, None] * self.out * (best + self.bias > 0)
        grad = {"out": act.T @ gz, "bias": gact.sum(0), "table": np.zeros_like(self.table), "shift": gz.sum()}
        for w, k in enumerate(self.kernel):
            cols, gk = slice(w * self.filters, (w + 1) * self.filters), np.zeros_like(k)
            g, pos = gact[:, cols], where[:, cols]
            for j in range(len(k)):
                hit = rows[pos + j]
                gk[j] = np.einsum("bf,bfd->df", g, self.table[hit])
                np.add.at(grad["table"], hit.ravel(), (g[:, :, None] * k[j].T[None]).reshape(-1, self.dims))
            grad[f"k{w}"] = gk
        grad["table"][PAD] = 0
        return grad

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.02) -> None:
        """Adam on the logistic loss; the first embedding dimension starts as the log odds of the row's documents."""
        y, rng = np.asarray(labels, "f4"), np.random.default_rng(self.seed)
        if not len(texts) or y.min() == y.max():  # nothing to tell apart: every score is the labels' mean
            self.out[:] = 0
            self.shift = np.float32(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -4)
            return
        seen = np.zeros((2, 1 << BUCKET_BITS), "f4")
        for t, label in zip(texts, y):
            seen[int(label), np.unique(t)] += 1
        odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))
        odds *= seen.sum(0) / (seen.sum(0) + 4)
        odds[PAD] = 0
        self.table[:, 0] = np.clip(odds, -3, 4)
        for k in self.kernel:
            k[:, 0, : self.filters // 2] = np.abs(k[:, 0, : self.filters // 2]) + 0.3
        self.out[:] = np.abs(self.out)
        self.shift = np.float32(-2)
        params = {"table": self.table, "bias": self.bias, "out": self.out} | {f"k{w}": k for w, k in enumerate(self.kernel)}
        first, second, steps = {n: np.zeros_like(p) for n, p in params.items()}, {n: np.zeros_like(p) for n, p in params.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for b in range(0, len(order), batch):
                some = order[b : b + batch]
                grad = self.gradients([texts[i] for i in some], y[some])
                steps += 1
                for n, p in params.items():
                    first[n] = 0.9 * first[n] + 0.1 * grad[n]
                    second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
                    p -= rate * (first[n] / (1 - 0.9**steps)) / (np.sqrt(second[n] / (1 - 0.999**steps)) + 1e-6) * (0.5 if n == "table" else 1)
                self.shift = np.float32(self.shift - rate * 5 * grad["shift"])

    def calibrate(self, texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], least: int = 40) -> None:
        """Shift scores so that 0.5 is the best cut overall, then find each language's own best threshold."""
        y = np.asarray(labels)
        if not len(texts) or y.min() == y.max():
            return
        s = self.scores(texts)
        cut = _best_cut(s, y)
        self.shift = np.float32(self.shift - np.log(cut / (1 - cut)))
        s = self.scores(texts)
        for lang in set(langs):
            mine = np.array([x == lang for x in langs])
            if mine.sum() >= least and 3 <= y[mine].sum() < mine.sum():
                self.thresholds[lang] = _best_cut(s[mine], y[mine])


def _best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest cut with the best F1."""
    order = np.argsort(-scores)
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(s[1:] < s[:-1], True)  # tied scores fall together
    k = int(np.argmax(np.where(ends, f1, -1)))
    low = s[k + 1] if k + 1 < len(s) else 0.0
    z = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    return float(1 / (1 + np.exp(-(z(s[k]) + z(low)) / 2)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, most: int = 12_000, **shape) -> TextCnn:
    """A classifier from at most so many labelled documents, the first by a hash of doc_id; held-out rows are never read.

    A fifth of the rest (crc32 of doc_id modulo 5 is 1) calibrates the cut and the languages' thresholds and isn't trained on.
    """
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").join(F.broadcast(some), "doc_id")

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_rows(t.as_py()).tobytes() for t in b.column(1)], pa.binary()), b.column(2), b.column(3)], names=["doc_id", "rows", "lang", "toxic"])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", F.col("toxic").cast("int").alias("toxic")).mapInArrow(to_rows, "doc_id long, rows binary, lang string, toxic int").toPandas()
    got = got.sort_values(["doc_id", "rows"]).reset_index(drop=True)
    part = np.array([zlib.crc32(str(d).encode()) % 5 == 1 for d in got.doc_id], bool)
    texts, y, langs = [np.frombuffer(r, np.int32) for r in got.rows], got.toxic.to_numpy(int), got.lang.tolist()
    model = TextCnn(**shape)
    model.fit([t for t, p in zip(texts, part) if not p], y[~part])
    model.calibrate([t for t, p in zip(texts, part) if p], y[part], [x for x, p in zip(langs, part) if p])
    return model


def _judgement(spark: SparkSession, model: TextCnn) -> tuple[Column, Column]:
    """The score of a row's text and the threshold of its lang."""
    sent = spark.sparkContext.broadcast((model, model.responses()))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cnn, parts = sent.value
        for batch in texts:
            yield pd.Series(cnn.scores([word_rows(t) for t in batch], parts))

    limit = F.lit(model.threshold)
    for lang, value in model.thresholds.items():
        limit = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(value)).otherwise(limit)
    return scored(F.col("text").cast("string")), limit


def score(docs: DataFrame, model: TextCnn) -> DataFrame:
    """docs with score, predicted (score >= 0.5), threshold (of the row's language) and rejected (score >= threshold).

    A null or empty text gets the score of a text without words; a text of any length is scored whole. A language without a calibrated
    threshold, and a null one, have 0.5. Repeated rows stay; a null doc_id is scored; a score on the threshold is rejected. Other columns are
    passed on, but for those with the new names. An empty table gives none.
    """
    scored, limit = _judgement(docs.sparkSession, model)
    rows = docs.drop("score", "predicted", "threshold", "rejected").withColumn("score", scored)
    return rows.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "threshold": limit}).withColumn("rejected", F.col("score") >= F.col("threshold"))


def accepted(docs: DataFrame, model: TextCnn) -> DataFrame:
    """The rows of docs that score() doesn't reject, with all their own columns whatever these are called."""
    scored, limit = _judgement(docs.sparkSession, model)
    return docs.where(scored < limit)


def score_table(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "threshold", "rejected")
