"""Sentences and hierarchical chunks of a text, as character ranges.

Everything works on one text and is applied to Arrow batches: a document's
ranges depend on nothing but the document. Ranges of sentences cover the text
without gaps; ranges of children nest in their parent's and cover it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import ceil
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import tree

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset(
    """
    Mr Mrs Ms Dr Prof Sr Jr St Ave Blvd No Vol Fig Eq Sec Art Ch pp p Inc Ltd Co Corp LLC e.g i.e etc vs cf viz approx
    Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec U.S U.K E.U
    """.split()
)
SHORT, LONG, AHEAD = 20, 2000, 200
LEAF_TOKENS, SPLIT_TOKENS, SMALL_TOKENS = 256, 2048, 128
WINDOW, STRIDE, VALLEY = 64, 32, 0.10
DEEPEST = 8
_CODE = re.compile(r"```.*?(?:```|\Z)|<!--.*?-->|`[^`\n]+`", re.S)
_URL = re.compile(r"https?://\S+|www\.\S+")
_BULLET = re.compile(r"(?m)^[ \t]*(?:[-*•+]|\d{1,3}[.)])[ \t]+")
_BREAK = re.compile(r"\n[ \t]*\n+")
_BEFORE = re.compile(r"(?:[^\W_]|\.)*\Z")
_NUMBER = re.compile(r"\d[\d.]*")
_STOP = re.compile(r"[.!?]+[\"')\]]*(?=\s|\Z)")


def _masked(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with code, comments and URLs blanked out at equal length, and the places of code."""
    blocks = [m.span() for m in _CODE.finditer(text)]
    out = _CODE.sub(lambda m: "x" * len(m[0]), text)
    return _URL.sub(lambda m: "x" * len(m[0]), out), blocks


def _ends_sentence(text: str, at: int) -> bool:
    """Whether the terminator at a place ends a sentence: a full stop doesn't after an abbreviation, a list number or within a decimal."""
    if text[at] != ".":
        return True
    word = _BEFORE.search(text, max(0, at - 32), at)[0].rstrip(".")
    following = text[at + 1 : at + 2]
    if _NUMBER.fullmatch(word):
        listed = len(word.partition(".")[0]) <= 3 and not following.strip()
        return not (listed or following.isdigit())
    return word not in ABBREVIATIONS


def _outside(end: int, a: int, blocks: list[tuple[int, int]]) -> int:
    """A cut of the piece from a, moved out of the block that it falls in: to the block's end if the piece stays short enough, else to its start."""
    k = bisect_left(blocks, (end,)) - 1  # the last block that starts before the cut
    if k < 0 or blocks[k][1] <= end:
        return end
    x, y = blocks[k]
    if y - a <= (LONG if x > a else LONG + AHEAD):
        return y
    return x if x > a else end  # no sentence can hold the block


def sentences(text: str) -> list[tuple[int, int]]:
    """Character ranges of the sentences; they cover the text. Code is cut only if it is over LONG + AHEAD."""
    if not text:
        return []
    flat, blocks = _masked(text)
    bullets = {m.start() for m in _BULLET.finditer(flat)}
    cuts = set(bullets) | {m.end() for m in _BREAK.finditer(flat)}
    for m in _STOP.finditer(flat):
        if _ends_sentence(flat, m.start()):
            end = m.end()
            while end < len(flat) and flat[end] in " \t":
                end += 1
            cuts.add(end + 1 if flat[end : end + 1] == "\n" else end)
    for a, b in blocks:
        cuts = {c for c in cuts if not a < c < b}
    edges = sorted({0, len(text), *(c for c in cuts if 0 < c < len(text))})
    parts: list[list] = []
    for a, b in zip(edges, edges[1:], strict=False):
        alone = a in bullets or any(a <= x and y <= b for x, y in blocks)
        if parts and not alone and not parts[-1][2] and parts[-1][1] - parts[-1][0] < SHORT:
            parts[-1][1] = b  # a short sentence takes the next one in
        else:
            parts.append([a, b, alone])
    out: list[tuple[int, int]] = []
    for a, b, _ in parts:
        while b - a > LONG:
            end = text.find("\n", a + 1, min(a + LONG + AHEAD, b)) + 1
            if not end:
                blank = max(text.rfind(" ", a + 1, a + LONG), text.rfind("\t", a + 1, a + LONG))
                end = blank + 1 if blank > a else a + LONG
            end = _outside(end, a, blocks)
            out.append((a, end))
            a = end
        if a < b:
            out.append((a, b))
    return out


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def hashed_vector(words: list[str], dims: int = 32) -> np.ndarray:
    """A unit vector of hashed words: the stand-in for a token or sentence encoder."""
    v = np.zeros(dims)
    for word in words:
        h = crc32(word.lower().encode())
        v[h % dims] += 1 if h >> 16 & 1 else -1
    size = np.linalg.norm(v)
    return v / size if size else v


def window_similarities(vectors: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """MaxSim of neighbouring windows a stride apart: the sum, over the first one's tokens, of the best match in the second."""
    n = max(0, ceil(len(vectors) / stride) - 1)
    out = np.zeros(n)
    for k in range(n):
        a, b = vectors[k * stride : k * stride + window], vectors[(k + 1) * stride : (k + 1) * stride + window]
        out[k] = (a @ b.T).max(1).sum() if len(a) and len(b) else 0.0
    return out


def token_vectors(text: str) -> np.ndarray:
    spans = token_spans(text)
    return np.array([hashed_vector([text[a:b]]) for a, b in spans]) if spans else np.zeros((0, 32))


def local_minima(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Candidates for valleys as a window plan: strict local minima that lie clearly below their group's maximum."""
    w = Window.partitionBy(group).orderBy(order)
    placed = rows.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).withColumn("_top", F.max(value).over(Window.partitionBy(group)))
    return placed.where((F.col(value) < F.col("_a")) & (F.col(value) < F.col("_b")) & (F.col(value) < F.col("_top") - VALLEY)).drop("_a", "_b", "_top")


def valleys(sims: np.ndarray, k: int, gap: int) -> list[int]:
    """The k deepest strict local minima that lie clearly below the maximum, at least `gap` apart, in order."""
    if len(sims) < 3 or k <= 0:
        return []
    inner = np.arange(1, len(sims) - 1)
    low = inner[(sims[1:-1] < sims[:-2]) & (sims[1:-1] < sims[2:]) & (sims[1:-1] < sims.max() - VALLEY)]
    chosen: list[int] = []
    for at in low[np.lexsort((low, sims[low]))]:
        if len(chosen) < k and all(abs(int(at) - c) >= gap for c in chosen):
            chosen.append(int(at))
    return sorted(chosen)


def _even(a: int, b: int, k: int) -> list[int]:
    return [a + (b - a) * i // k for i in range(1, k)]


def token_chunks(text: str) -> list[tuple[int, int, int, float | None]]:
    """(level, start, end, boundary score) of a hierarchy by token windows: a node of more than LEAF_TOKENS splits at its deepest valleys, else evenly."""
    spans = token_spans(text)
    if not spans:
        return [(0, 0, len(text), None)] if text else []
    vectors = token_vectors(text)
    out: list[tuple[int, int, int, float | None]] = []

    def edge(i: int, first: int, last: int, start: int, end: int) -> int:
        return start if i == first else end if i == last else spans[i][0]

    def split(level: int, first: int, last: int, start: int, end: int, score: float | None) -> None:
        out.append((level, start, end, score))
        n = last - first
        if n <= LEAF_TOKENS or level >= DEEPEST:
            return
        k = max(2, ceil(n / SPLIT_TOKENS))
        sims = window_similarities(vectors[first:last])
        found = valleys(sims, k - 1, max(1, len(sims) // (2 * k)))
        cuts = [first + (v + 1) * STRIDE for v in found] or _even(first, last, k)
        scores = [float(1 - sims[v]) for v in found] or [None] * len(cuts)
        cuts = [c for c in cuts if first < c < last]
        edges = [first, *cuts, last]
        for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            split(level + 1, a, b, edge(a, first, last, start, end), edge(b, first, last, start, end), scores[j - 1] if j else None)

    split(0, 0, len(spans), 0, len(text), None)
    return out


def _tokens(text: str, a: int, b: int) -> int:
    return max(1, (b - a) // 4)


def semantic_cuts(text: str, parts: list[tuple[int, int]], share: float = 0.9) -> list[int]:
    """Places among sentences where neighbouring three-sentence windows are least alike (at or above the given quantile of distances)."""
    if len(parts) < 4:
        return []
    vectors = np.array([hashed_vector(text[a:b].split()) for a, b in parts])
    sums = np.array([vectors[max(0, k - 1) : k + 2].mean(0) for k in range(len(parts))])
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    sums = sums / np.where(size == 0, 1, size)
    distance = 1 - (sums[:-1] * sums[1:]).sum(1)
    return (np.flatnonzero(distance >= np.quantile(distance, share)) + 1).tolist()


def semantic_chunks(text: str, target: int = LEAF_TOKENS) -> list[tuple[int, int, int, float | None]]:
    """(level, start, end, boundary score) of a hierarchy by sentence meaning; offsets are those of the whole text at every level."""
    if not text:
        return []
    parts = sentences(text)
    out: list[tuple[int, int, int, float | None]] = []

    def split(level: int, lo: int, hi: int, score: float | None) -> None:
        start, end = parts[lo][0], parts[hi - 1][1]
        out.append((level, start, end, score))
        if _tokens(text, start, end) <= 1.5 * target or level >= DEEPEST or hi - lo < 2:
            return
        own = parts[lo:hi]
        cuts = [lo + c for c in semantic_cuts(text, own)]
        kept, last = [], lo
        for c in cuts:  # chunks that are too small join the next
            if _tokens(text, parts[last][0], parts[c - 1][1]) >= SMALL_TOKENS and _tokens(text, parts[c][0], end) >= SMALL_TOKENS:
                kept.append(c)
                last = c
        if not kept:  # the sentence bound nearest to the middle
            half = (start + end) // 2
            kept = [min(range(lo + 1, hi), key=lambda c: (abs(parts[c][0] - half), c))]
        edges = [lo, *kept, hi]
        for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            made = None
            if j:
                x, y = hashed_vector(text[parts[a - 1][0] : parts[a - 1][1]].split()), hashed_vector(text[parts[a][0] : parts[a][1]].split())
                made = float(1 - x @ y)
            split(level + 1, a, b, made)

    split(0, 0, len(parts), None)
    return out


def apply(docs: DataFrame, function: Callable[[str], list], columns: str, names: list[str], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, ...) one row for each tuple that a function of the text gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*i, *r) for *i, t in zip(*(batch[k] for k in keys), batch["text"].fillna(""), strict=True) for r in function(t)]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return docs.select(*keys, "text").mapInPandas(run, "".join(f"{k} long, " for k in keys) + columns)


def sentence_table(docs: DataFrame) -> DataFrame:
    return apply(docs, lambda t: [(k, a, b) for k, (a, b) in enumerate(sentences(t))], "n long, start long, end long", ["n", "start", "end"])


def chunk_table(docs: DataFrame, kind: str = "semantic") -> DataFrame:
    function = semantic_chunks if kind == "semantic" else token_chunks
    return apply(docs, function, "level int, start long, end long, boundary_score double", ["level", "start", "end", "boundary_score"])


def chunk_graph(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes with ids, parents, sibling links, sizes and previews."""
    ident = lambda level, a, b: tx.node_id(F.col("doc_id"), level, a, b)
    owned = tree.interval_parents(chunks.select("doc_id", "level", "start", "end")).withColumn("node_id", ident(F.col("level"), F.col("start"), F.col("end")))
    parent = F.when(F.col("parent_start").isNotNull(), ident(F.col("level") - 1, F.col("parent_start"), F.col("parent_end")))
    owned = owned.withColumn("parent_id", parent)
    linked = tree.sibling_links(owned, "parent_id", "node_id", "start")
    linked = linked.withColumn("next_sibling", F.when(F.col("parent_id").isNotNull(), F.col("next_sibling")))
    first = tree.first_children(owned.where("parent_id is not null"), "parent_id", "node_id", "start").select(F.col("parent_id").alias("node_id"), "first_child")
    scores = chunks.select("doc_id", "level", "start", "end", "boundary_score")
    rows = linked.join(first, "node_id", "left").join(scores, ["doc_id", "level", "start", "end"]).join(docs.select("doc_id", "text"), "doc_id")
    part = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return rows.select(
        "node_id", "doc_id", "level", "parent_id", "first_child", "next_sibling", "n_siblings", "sibling_idx", "start", "end", (F.col("end") - F.col("start")).alias("n_chars"),
        tx.token_estimate(F.col("end") - F.col("start")).alias("n_tokens"), F.col("first_child").isNull().alias("is_leaf"), "boundary_score", tx.collapsed_preview(part).alias("preview"),
    )


def quality(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: nodes, leaves, smallest, mean and largest leaf in tokens, depth, per cent of leaves that end with a terminator."""
    graph = chunk_graph(chunks, docs)
    part = F.rtrim(F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    leaves = graph.where("is_leaf").join(docs.select("doc_id", "text"), "doc_id").select("n_tokens", F.rlike(part, F.lit(r"[.!?]\s*$")).alias("ended"))
    every = graph.agg(F.count("*").alias("nodes"), F.max("level").alias("depth"))
    return leaves.agg(F.count("*").alias("leaves"), F.min("n_tokens").alias("least"), F.round(F.avg("n_tokens"), 6).alias("mean"), F.max("n_tokens").alias("most"), F.round(100 * F.count_if("ended") / F.count("*"), 3).alias("ended_pct")).crossJoin(every)
