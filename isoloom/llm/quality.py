"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed terms: 4-grams of character classes (each punctuation mark is a class of its own), byte
trigrams, and how its words repeat. Term weights, an LSA projection and the vectors of the labelled texts
are fitted on a bounded sample of labelled rows and broadcast; their size depends on the parameters
alone. Every document is projected, its cosines with all labelled vectors are computed in blocks as
matrix products, and the labels of the nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000
LATENT = 32
NEIGHBOURS = 15
CUT = 0.7
_SHAPES, _TRIGRAMS, _REPEATS = 1024, 512, 16
TERMS = _SHAPES + _TRIGRAMS + _REPEATS
_STEP = 1 << 20


def _classes() -> np.ndarray:
    """Byte -> a random 32-bit number per character class."""
    names = ["letter" if b >= 0x80 or 0x61 <= b <= 0x7A else "capital" if 0x41 <= b <= 0x5A else "digit" if 0x30 <= b <= 0x39 else "space" if b in (9, 11, 12, 13, 32) else b for b in range(256)]
    values = dict(zip(dict.fromkeys(names), np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint64), strict=False))
    return np.array([values[n] for n in names], np.uint64)


_CLASS = _classes()
_BYTE = np.random.default_rng(8).integers(0, 1 << 32, 256, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(values: np.ndarray, n: int, terms: int) -> np.ndarray:
    count = np.zeros(terms)
    for at in range(0, max(0, len(values) - n + 1), _STEP):
        part = values[at : at + _STEP + n - 1]
        with np.errstate(over="ignore"):
            h = part[: len(part) - n + 1].copy()
            for k in range(1, n):
                h = h * _ODD + part[k : len(part) - n + 1 + k]
            h *= _ODD
        count += np.bincount((h >> np.uint64(40)).astype(np.int64) % terms, minlength=terms)
    return count


def terms(text: str | None) -> np.ndarray:
    """Term counts of a whole text, damped and of length one in each of the three groups."""
    data = (text or "").encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    words = data.split()
    repeats = np.zeros(_REPEATS)
    if len(words) > 1:
        n = len(words)
        # the share of words that repeat the one before, and of different words expected for the length
        same = sum(map(operator.eq, words, words[1:])) / (n - 1)
        fresh = np.log1p(len(set(words))) / np.log1p(n)
        repeats[min(7, int(same * 16))] = 1
        repeats[8 + min(7, int(fresh * 8))] = 1
    groups = [np.sqrt(_grams(_CLASS[raw], 4, _SHAPES)), np.sqrt(_grams(_BYTE[raw], 3, _TRIGRAMS)), repeats]
    return np.concatenate([g / (np.sqrt((g * g).sum()) or 1.0) for g in groups]).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = (x * self.idf) @ self.project
        return (y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)

    def scores(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        out, y = np.zeros(len(x)), self.latent(x)
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(x), block):
            cosine = y[at : at + block] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            near.sort(axis=1)  # one order of summation for equal similarities
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** 8
            out[at : at + block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        out[~x.any(axis=1)] = self.prior
        return np.clip(out, 0.0, 1.0)


def fit(x: np.ndarray, labels: np.ndarray, latent: int = LATENT, neighbours: int = NEIGHBOURS) -> Model:
    if not len(x):
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), labels, 0.5, neighbours)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    weighted = x * idf
    _, vectors = np.linalg.eigh(weighted.T.astype(np.float64) @ weighted)
    project = vectors[:, ::-1][:, : min(latent, len(x))]
    model = Model(idf.astype(np.float32), project.astype(np.float32), np.zeros(0), labels.astype(np.float64), float(labels.mean()), neighbours)
    model.vectors = model.latent(x)
    return model


def held_out(doc_id) -> F.Column:
    """Rows never learnt from: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, latent: int = LATENT, neighbours: int = NEIGHBOURS) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out, chosen by the hash of their id.

    ``labels(doc_id, quality)``; labels other than 0 and 1 are left out, an id labelled twice counts with its
    larger label, and of the rows of ``docs`` that share an id the one with the least text is learnt from, so no more than
    ``sample`` rows come to the driver. Null and empty texts are learnt from as empty. Without any labelled document
    every score is 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], names=["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))
    rows = one.mapInArrow(run, "doc_id long, quality int, x binary")
    got = sorted((r.doc_id, r.quality, bytes(r.x)) for r in rows.collect())
    x = np.array([np.frombuffer(v, np.float32) for _, _, v in got], np.float32).reshape(len(got), TERMS)
    return fit(x, np.array([q for _, q, _ in got], np.float64), latent, neighbours)


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, repeated ones and those without a doc_id (never held out) too.

    Null and empty texts get the share of label 1 in the sample; long ones are read whole. Other columns aren't read; an
    empty table gives no rows, equal texts equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = _scores(sent.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def _scores(model: Model, texts: pa.Array, rows: int = 1024) -> np.ndarray:
    parts = []
    for at in range(0, len(texts), rows):
        x = np.array([terms(t.as_py()) for t in texts[at : at + rows]], np.float32).reshape(-1, TERMS)
        parts.append(model.scores(x))
    return np.concatenate([*parts, np.zeros(0)])


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` predicted to be good, with all their columns.

    Each row is judged by its whole text alone, repeated rows and those without a doc_id too; null and empty texts stay only if
    the share of label 1 in the sample reaches ``cut``. An empty table stays empty.
    """
    sent, k = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(sent.value, b.column(k)) >= cut, pa.bool_()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
