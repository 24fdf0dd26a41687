"""Language ID by multilingual mixture inference.

Learning counts hashed letter trigrams per language over every training
document. A document is then a mixture: each window of its text has a
likelihood under every language, expectation-maximisation estimates the
languages' proportions, and of the nested sets of its strongest languages the
one with the best penalised likelihood is selected; larger sets are tried as
long as any could still be better. The prediction is the language with the
largest proportion in the selected set, the score that proportion.

Defined cases: a null text, or one without any letter (a character of a
Unicode letter category), is "und" with score 0 and an empty set; a text of
any length is taken in slices of bounded size; languages that are null teach
nothing; without any training text, and for an empty table, every document is
"und"; ties go to the language that sorts first; repeated rows are predicted
each on their own; other columns are ignored by predict_languages() and kept
by identify(), whose own columns get underscores where names clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, map_batches, tune, with_columns

#: Hashed trigram ids, positions in a window, documents handled at once.
FEATURES, WINDOW, TOGETHER = 1 << 15, 48, 256
EM_STEPS = 12
#: Penalty for each further language: half the log of the windows, and so much more.
EXTRA_PENALTY = 6.0
_PLAIN_LETTER = re.compile(r"[A-Za-z]")
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: Windows whose trigrams are made at once.
_SLICE = 1 << 16


def has_letter(text: str | None) -> bool:
    """Whether any character is of a Unicode letter category."""
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _trigrams(raw: np.ndarray) -> np.ndarray:
    """Trigram id at each byte but the last two; FEATURES where two of three are blank."""
    raw = raw.astype(np.uint32)
    code = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA6B)) ^ (raw[2:] * np.uint32(0xC2B2AE35))
    code ^= code >> np.uint32(15)
    code = (code * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    blank = (raw[:-2] == 32).astype(np.uint8) + (raw[1:-1] == 32) + (raw[2:] == 32) >= 2
    return np.where(blank, np.uint32(FEATURES), code)


def _windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[slice, np.ndarray, np.ndarray]]]:
    """Number of windows of each text, then slices of all windows: which, their trigram ids, where each begins among these."""
    parts = [b"  " + (t or "").lower().encode("utf-8", "replace").translate(_TABLE) + b" " for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    per = -(-sizes // WINDOW)
    lead = np.cumsum(per) - per
    first = np.repeat(np.cumsum(sizes) - sizes, per) + WINDOW * (np.arange(int(per.sum())) - np.repeat(lead, per))
    raw = np.frombuffer(b"".join(parts) + b"  ", np.uint8)

    def slices() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        for a in range(0, len(first), _SLICE):
            own = first[a : a + _SLICE]
            end = int(first[a + _SLICE]) if a + _SLICE < len(first) else len(raw) - 2
            yield slice(a, a + len(own)), _trigrams(raw[own[0] : end + 2]), own - own[0]

    return per, lead, slices()


Model = tuple[list[str], np.ndarray, np.ndarray]


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Languages, log probabilities of the trigrams (one row more, of zeros, for blanks), the languages' shares."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for k in range(0, len(own), TOGETHER):
                    for _, codes, _ in _windows(own[k : k + TOGETHER])[2]:
                        found = np.bincount(codes, minlength=FEATURES + 1)
                        seen[lang] = seen[lang] + found if lang in seen else found
        for lang, found in seen.items():
            at = np.flatnonzero(found[:FEATURES])
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "feature": pa.array(at, pa.int32()), "n": pa.array(found[at], pa.int64())})

    tune(docs.sparkSession)
    texts = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(text_column, lang_column)
    rows = map_batches(texts, count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # at most FEATURES rows a language
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((FEATURES, len(langs)))
    if langs:
        where = np.searchsorted(np.array(langs, dtype=object), np.array(got.column("lang").to_pylist(), dtype=object))
        counts[got.column("feature").to_numpy(), where] = got.column("n").to_numpy()
    smooth = counts + 0.5
    table = np.log(smooth / smooth.sum(0, keepdims=True)) if langs else counts
    prior = smooth.sum(0) / smooth.sum() if langs else np.zeros(0)
    return langs, np.vstack([table, np.zeros((1, len(langs)))]).astype(np.float32), prior


def _mix(weight: np.ndarray, windows: np.ndarray, doc: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for the proportions of the allowed languages, from those given: proportions, log-likelihood (to a constant per window)."""
    share = allowed / allowed.sum(1, keepdims=True)
    allowed = allowed > 0
    size = np.add.reduceat(weight, first)[:, None]
    for _ in range(EM_STEPS):
        post = windows * share[doc]
        post *= (weight / post.sum(1))[:, None]
        share = np.add.reduceat(post, first, axis=0) / size
        share = np.maximum(share, 1e-12) * allowed
        share /= share.sum(1, keepdims=True)
    return share, np.add.reduceat(np.log((windows * share[doc]).sum(1)) * (weight > 0), first)


def infer(texts: list[str | None], langs: list[str], table: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Prediction, score and the selected language set of each text."""
    pred, score, sets = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    live = [k for k, t in enumerate(texts) if has_letter(t)] if langs else []
    todo, room = [], 0
    for n, k in enumerate(live):
        todo.append(k)
        room += len(texts[k])
        if len(todo) < TOGETHER and room < _SLICE * WINDOW and n + 1 < len(live):
            continue
        per, lead, slices = _windows([texts[j] for j in todo])
        doc = np.repeat(np.arange(len(todo)), per)
        like, weight = np.empty((len(doc), len(langs))), np.empty(len(doc))
        for at, codes, first in slices:
            like[at] = np.add.reduceat(table[codes], first, axis=0)
            weight[at] = np.add.reduceat((codes < FEATURES).astype(np.float64), first)
        weight[lead] += 1e-9
        like = np.exp(np.maximum(like - like.max(1, keepdims=True), -300))
        full, _ = _mix(weight, like, doc, lead, np.tile(prior, (len(todo), 1)))
        share, chosen, order = select(weight, like, doc, lead, per, full)
        winner = share.argmax(1)
        for j, at in enumerate(todo):
            pred[at], score[at] = langs[winner[j]], min(1.0, float(share[j, winner[j]]))
            sets[at] = sorted(langs[x] for x in order[j, : chosen[j]])
        todo, room = [], 0
    return pred, score, sets


def select(weight: np.ndarray, like: np.ndarray, doc: np.ndarray, lead: np.ndarray, per: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document's nested sets of its strongest languages the best by penalised likelihood: shares in it, its size, the order of the languages.

    The likeliest language of each window has likelihood 1, so no set's
    likelihood is over 1 and the search ends where the penalty alone is worse
    than the best set so far of every document.
    """
    order = np.argsort(-full, axis=1, kind="stable")
    penalty = 0.5 * np.log(np.maximum(per, 2)) + EXTRA_PENALTY
    best, chosen, top = np.full(len(full), -np.inf), np.zeros(len(full), int), full
    for m in range(1, full.shape[1] + 1):
        if (-(m - 1) * penalty <= best).all():
            break
        allowed = np.zeros_like(full)
        np.put_along_axis(allowed, order[:, :m], 1.0, axis=1)
        share, fit = _mix(weight, np.maximum(like, 1e-130), doc, lead, allowed)
        fit -= (m - 1) * penalty
        better = fit > best
        best, chosen = np.where(better, fit, best), np.where(better, m, chosen)
        top = np.where(better[:, None], share, top)
    return top, chosen, order


def identify(docs: DataFrame, learned: Model, text_column: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_set. The model is at most FEATURES floats a language."""
    model = docs.sparkSession.sparkContext.broadcast(learned)
    at = docs.columns.index(text_column)
    return with_columns(docs, lambda batch: infer(batch.column(at).to_pylist(), *model.value), "lang_pred string, lang_score double, lang_set array<string>", [pa.string(), pa.float64(), pa.list_(pa.string())])


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    own = docs.select("doc_id", "text", F.col("lang").alias("lang"), (crc_mod("doc_id", 5) == 0).alias("held_out"))
    out = identify(own.select("doc_id", "held_out", "text"), learn(own.where(~F.col("held_out"))))
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_set")
