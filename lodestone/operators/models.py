"""Pluggable models: each is a function from texts to values, run over Arrow batches.

The engine ships deterministic stand-ins; a deployment registers its own under
the same names. A model is loaded once a Python worker and gets whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DIMS = 64


def hashing_encoder(texts: list[str]) -> list[np.ndarray]:
    """Unit vectors of hashed words."""
    out = []
    for text in texts:
        v = np.zeros(DIMS, np.float32)
        for word in text.lower().split():
            h = crc32(word.encode())
            v[h % DIMS] += 1 if h >> 16 & 1 else -1
        size = np.linalg.norm(v)
        out.append(v / size if size else v)
    return out


def overlap_scorer(questions: list[str], texts: list[str]) -> list[float]:
    """Share of the question's distinct words that a text holds."""
    out = []
    for question, text in zip(questions, texts, strict=True):
        wanted, there = set(question.lower().split()), set(text.lower().split())
        out.append(len(wanted & there) / len(wanted) if wanted else 0.0)
    return out


def template_passage(texts: list[str]) -> list[str]:
    """A passage that a question might be answered by: nothing but its own words."""
    return [f"This document describes {' '.join(t.split()[:20])}." if t.strip() else "" for t in texts]


MODELS: dict[str, Callable] = {"encoder": hashing_encoder, "scorer": overlap_scorer, "passage": template_passage}


def register(name: str, function: Callable) -> None:
    MODELS[name] = function


def apply_text_model(rows: DataFrame, key: str, text: str, out: str, model: Callable, kind: str = "string") -> DataFrame:
    """(key, out) of a model over a text column; only the columns it needs are handed over."""
    key_type = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], out: model(batch[text].fillna("").tolist())})

    return rows.select(key, text).mapInPandas(run, f"{key} {key_type}, {out} {kind}")


def score_pairs(pairs: DataFrame, question: str, text: str, out: str = "model_score", model: Callable | None = None) -> DataFrame:
    """pairs with a relevance score of (question, text); both columns are dropped."""
    function = model or MODELS["scorer"]
    kept = [c for c in pairs.columns if c not in (question, text)]
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[kept].assign(**{out: function(batch[question].fillna("").tolist(), batch[text].fillna("").tolist())})

    return pairs.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + f", {out} double")
