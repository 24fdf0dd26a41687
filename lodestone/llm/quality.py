"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A document's terms are trigrams of character classes, hashed words and marks
of repetition. A bounded sample of labelled documents (SAMPLE of each label)
gives the term weights and, by a truncated SVD, the latent space; their
vectors and labels are broadcast. Every document is projected, its cosines
with all labelled vectors are computed exactly in blocks, and its NEIGHBOURS
nearest vote with weights that grow with similarity.

Defined cases: a null text counts as empty; an empty text has no direction,
so its score is the share of good labels among all that may be learnt from;
without any usable label every score is 0.5; a document that repeats, or whose
label does, is learnt once a label; labels that are neither 0 nor 1, or null,
teach nothing; of neighbours that tie at the last place any may vote; a text
of any length is one term row, so its length costs its own bytes alone;
repeated documents are scored each on their own; an empty table gives no rows;
other columns are ignored by score_quality() and kept by classify(), whose own
column gets underscores where names clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, cut, map_batches, tune, utf8, with_columns

#: Labelled documents of each label that are learnt from, latent dimensions, voters, power of the cosine in a vote.
SAMPLE, RANK, NEIGHBOURS, POWER = 1024, 48, 25, 8
THRESHOLD = 0.3
CLASSES, WORDS, MARKS = 16, 2048, 16
FEATURES = CLASSES**3 + WORDS + MARKS
#: Documents whose cosines are computed at once.
BLOCK = 128


def _classes() -> bytes:
    kinds = {**dict.fromkeys(range(97, 123), 1), **dict.fromkeys(range(65, 91), 2), **dict.fromkeys(range(48, 58), 3), 32: 4, 10: 5, 9: 5, 13: 5, 46: 6, 44: 7, 33: 8, 63: 8, 124: 9}
    kinds |= dict.fromkeys(map(ord, "#$%&*@^~+=<>"), 10) | dict.fromkeys(map(ord, "'\"`"), 11) | dict.fromkeys(map(ord, "()[]{}"), 12) | dict.fromkeys(map(ord, "-_/\\:;"), 13)
    return bytes(kinds.get(c, 14 if c >= 128 else 0) for c in range(256))


_CLASS = _classes()


def _repetition(text: bytes, words: list[bytes]) -> list[int]:
    """Marks (0 to MARKS) that say how much of a text repeats: lines, words, word pairs; and how long it is."""
    marks = []
    lines = [x for x in text.split(b"\n") if x]
    pairs = list(zip(words, words[1:], strict=False))
    for k, items in enumerate((lines, words, pairs)):
        if len(items) >= 4:
            marks.append(4 * k + min(3, int(4 * (1 - len(set(items)) / len(items)))))
    marks.append(12 + min(3, len(words) // 20))
    return marks


def terms(texts: list[bytes]) -> np.ndarray:
    """Weighted term rows (documents x FEATURES), float32, not yet scaled by the terms' rarity."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for k, text in enumerate(texts):
        kind = np.frombuffer(text.translate(_CLASS), np.uint8).astype(np.int32)
        tri = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        words = text.lower().split()
        out[k, : CLASSES**3] = np.bincount(tri, minlength=CLASSES**3)
        if words:
            # a polynomial hash of each word, alike in every process
            raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
            ends = np.flatnonzero(raw == 32)
            starts = np.append(0, ends[:-1] + 1)
            place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
            sums = np.add.reduceat((raw + np.uint64(1)) * _POWERS[place % len(_POWERS)], starts)
            out[k, CLASSES**3 : CLASSES**3 + WORDS] = np.bincount(((sums * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64), minlength=WORDS)
        out[k, [CLASSES**3 + WORDS + m for m in _repetition(text, words)]] = max(1.0, len(text) / 64)
    total = out.sum(1, keepdims=True)
    return np.log1p(out * (1000 / np.maximum(total, 1)))


_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


@dataclass
class Model:
    weight: np.ndarray  # of each term
    basis: np.ndarray  # terms x RANK
    vectors: np.ndarray  # labelled rows x RANK, unit length
    labels: np.ndarray
    prior: float = 0.5  # share of good labels

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.weight) @ self.basis
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.where(size > 1e-6, latent / np.maximum(size, 1e-6), 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        live = [k for k, t in enumerate(texts) if t.strip()] if len(self.labels) else []
        voters = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(live), BLOCK):
            at = live[a : a + BLOCK]
            cosine = self.project(terms([texts[k] for k in at])) @ self.vectors.T
            near = np.argpartition(-cosine, voters - 1, axis=1)[:, :voters]
            vote = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** POWER
            out[at] = (vote * self.labels[near]).sum(1) / vote.sum(1)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Model:
    """Learn from at most `sample` documents of each label, chosen by a hash of doc_id among those that are there."""
    tune(docs.sparkSession)
    clean = labels.select("doc_id", F.col("quality").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    clean = cut(clean.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    n, good = clean.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = clean.where("label = 0").orderBy(*order).limit(sample).unionByName(clean.where("label = 1").orderBy(*order).limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one of a document's rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = terms(utf8(batch.column(2)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "label": batch.column(1).cast(pa.int32()), "at": pa.array([np.flatnonzero(r).astype(np.int32) for r in rows], pa.list_(pa.int32())), "value": pa.array([r[r > 0] for r in rows], pa.list_(pa.float32()))})

    got = map_batches(texts, count, "doc_id long, label int, at array<int>, value array<float>").orderBy("doc_id", "label").toArrow()
    rows = np.zeros((got.num_rows, FEATURES), np.float32)
    for k, (at, value) in enumerate(zip(got.column("at").to_pylist(), got.column("value").to_pylist(), strict=True)):
        rows[k, at] = value
    y = got.column("label").to_numpy().astype(np.float32)
    weight = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype(np.float32) + 0.1
    rows *= weight
    rng = np.random.default_rng(7)
    basis = np.zeros((FEATURES, 1), np.float32)
    if len(rows) > 1:
        size = min(rank + 8, len(rows))
        probe = rows @ rng.standard_normal((FEATURES, size), np.float32)
        for _ in range(3):  # subspace iteration towards the leading singular vectors
            probe = np.linalg.qr(rows @ (rows.T @ probe))[0]
        _, _, right = np.linalg.svd(probe.T @ rows, full_matrices=False)
        basis = np.ascontiguousarray(right[: min(rank, len(right))].T)
    model = Model(weight, basis, np.zeros((len(rows), basis.shape[1]), np.float32), y, good / n if n else 0.5)
    model.vectors = model.project(rows / weight)
    return model


def classify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs with quality_score. The model's size is bounded by SAMPLE, RANK and FEATURES."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)
    return with_columns(docs, lambda batch: [shared.value.score(utf8(batch.column(at)))], "quality_score double", [pa.float64()])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs, labels.where(crc_mod("doc_id", 5) != 0))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels that are not held out, score all documents."""
    own = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    out = classify(own, learn(docs, labels)).withColumnRenamed("quality_score", "score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
