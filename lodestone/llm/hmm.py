"""Hidden Markov language model, trained by Baum-Welch over all training documents.

Tokens are words and one end per document. The most frequent words are symbols
of their own; any other word is the symbol of its class (by its last bytes)
times its add-one share of the class. Each Baum-Welch round sums expected
counts per task, then over tasks by symbol; nothing but those sums (one row a
symbol) reaches the driver. Documents are cut into segments whose transfer
matrices are computed side by side, a bounded number at once, and then chained,
so the scaled forward recursion is exact for texts of any length without a step
per token of the longest text; besides its tokens a long text takes one small
matrix a segment.

Counts of rare words are joined by word, never broadcast.

Defined cases: a null text counts as empty and is one end token; without
training documents every symbol is equally likely and counts are zero; null
doc_ids count as the empty text when held out documents are chosen; words that
tie for the last places among the symbols go by their letters; repeated rows
are scored each on their own; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, cut, map_batches, tune, utf8

#: Words that are symbols of their own and the longest of them in bytes, classes of other words, bytes that make a class.
FREQUENT, LONGEST, CLASSES, SUFFIX = 1 << 15, 48, 512, 3
STATES, ROUNDS, SMOOTH = 5, 3, 0.02
#: Tokens of a segment and of a batch of segments; steps between rescalings of a transfer matrix; distinct words counted before they are passed on.
SEGMENT, TOGETHER, RESCALE, COUNTED = 128, 1 << 18, 8, 400_000
END = FREQUENT + CLASSES
SYMBOLS = END + 1


def class_of(word: bytes) -> int:
    return crc32(word[-SUFFIX:]) % CLASSES


def _sql_class():
    return F.crc32(F.expr(f"substring(cast(word as binary), -{SUFFIX}, {SUFFIX})")) % CLASSES


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states

    def extended(self) -> tuple[np.ndarray, np.ndarray]:
        """With one state more, in which every document begins and which emits nothing."""
        k = len(self.start)
        move = np.zeros((k + 1, k + 1))
        move[:k, :k], move[k, :k] = self.move, self.start
        return move, np.hstack([self.emit, np.zeros((len(self.emit), 1))])


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of documents of the given sizes, longest first: document, number within it, first token, length."""
    per = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(np.cumsum(sizes) - sizes, per) + number * SEGMENT
    length = np.minimum(SEGMENT, np.repeat(sizes, per) - number * SEGMENT)
    order = np.argsort(-length, kind="stable")
    return doc[order], number[order], first[order], length[order]


def _transfer(move: np.ndarray, emit: np.ndarray, tokens: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's product of moves and emissions, scaled, and the log of the scale."""
    k = len(move)
    out, scale = np.tile(np.eye(k), (len(first), 1, 1)), np.zeros(len(first))
    for a, b in _blocks(length):
        part, log, start, size = out[a:b], scale[a:b], first[a:b], length[a:b]
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, "left"))
            part[:n] = (part[:n].reshape(-1, k) @ move).reshape(n, k, k) * emit[tokens[start[:n] + t]][:, None, :]
            if t % RESCALE == RESCALE - 1:
                top = part[:n].max((1, 2))
                part[:n] /= top[:, None, None]
                log[:n] += np.log(top)
    return out, scale


def _blocks(length: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of segments of at most twice TOGETHER tokens, so that only long documents are taken in parts."""
    ends, a = np.cumsum(length), 0
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(ends, 2 * TOGETHER + (ends[a - 1] if a else 0), "right")))
        yield a, b
        a = b


def _chain(transfer: np.ndarray, scale: np.ndarray, doc: np.ndarray, number: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward vectors at the start of every segment; natural log-likelihood of every document."""
    k = transfer.shape[1]
    now, like = np.zeros((docs, k)), np.zeros(docs)
    now[:, -1] = 1
    before = np.zeros((len(doc), k))
    order = np.argsort(number, kind="stable")
    edges = np.searchsorted(number[order], np.arange(number.max() + 2 if len(number) else 1))
    for a, b in zip(edges, edges[1:], strict=False):
        seg = order[a:b]
        who = doc[seg]
        before[seg] = now[who]
        step = np.einsum("ni,nij->nj", now[who], transfer[seg])
        total = step.sum(1)
        now[who] = step / total[:, None]
        like[who] += np.log(total) + scale[seg]
    return before, like


def likelihood(model: Model, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each sequence of symbols, exact."""
    move, emit = model.extended()
    out = np.zeros(len(documents))
    for at in _batches(documents):
        tokens, sizes = np.concatenate([documents[k] for k in at]), np.array([len(documents[k]) for k in at])
        doc, number, first, length = _layout(sizes)
        _, out[at] = _chain(*_transfer(move, emit, tokens, first, length), doc, number, len(at))
    return out


def _batches(documents: list[np.ndarray]) -> Iterator[list[int]]:
    at, room = [], 0
    for k, d in enumerate(documents):
        at.append(k)
        room += len(d)
        if room >= TOGETHER:
            yield at
            at, room = [], 0
    if at:
        yield at


def expected(model: Model, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected moves (with the begin state's), emissions by symbol, log-likelihood."""
    move, emit = model.extended()
    k = len(move)
    moves, emissions, total = np.zeros((k, k)), np.zeros((len(emit), k - 1)), 0.0
    for at in _batches(documents):
        tokens, sizes = np.concatenate([documents[x] for x in at]).astype(np.int64), np.array([len(documents[x]) for x in at])
        doc, number, first, length = _layout(sizes)
        transfer, scale = _transfer(move, emit, tokens, first, length)
        before, like = _chain(transfer, scale, doc, number, len(at))
        total += float(like.sum())
        # backward vectors at the end of every segment, from the documents' ends
        after, now = np.ones((len(doc), k)), np.ones((len(at), k))
        order = np.argsort(-number, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(number[order]) != 0)), len(order))
        for a, b in zip(edges, edges[1:], strict=False):
            seg = order[a:b]
            after[seg] = now[doc[seg]]
            step = np.einsum("nij,nj->ni", transfer[seg], after[seg])
            now[doc[seg]] = step / step.sum(1, keepdims=True)
        for a, b in _blocks(length):
            m, e = _counts(move, emit, tokens, first[a:b], length[a:b], before[a:b], after[a:b])
            moves += m
            emissions += e
    return moves * move, emissions, total


def _counts(move: np.ndarray, emit: np.ndarray, tokens: np.ndarray, first: np.ndarray, length: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected moves (not yet times the moves' chances) and emissions of segments, longest first, between their forward and backward vectors."""
    k, steps = len(move), int(length[0])
    moves, emissions, after = np.zeros((k, k)), np.zeros((len(emit), k - 1)), after.copy()
    forward = np.zeros((steps + 1, len(first), k))
    forward[0] = before
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]
    symbol = [tokens[first[:n] + t] for t, n in enumerate(live)]
    for t, n in enumerate(live):
        step = (forward[t, :n] @ move) * emit[symbol[t]]
        forward[t + 1, :n] = step / step.sum(1, keepdims=True)
    weights, where = [], []
    for t in range(steps - 1, -1, -1):
        n = live[t]
        gamma = forward[t + 1, :n] * after[:n]
        gamma /= gamma.sum(1, keepdims=True)
        weights.append(gamma[:, :-1])
        where.append(symbol[t])
        out = emit[symbol[t]] * after[:n]
        back = out @ move.T
        moves += (forward[t, :n] / (forward[t, :n] * back).sum(1, keepdims=True)).T @ out
        after[:n] = back / back.sum(1, keepdims=True)
    weight, symbols = np.concatenate(weights), np.concatenate(where)
    for s in range(k - 1):
        emissions[:, s] = np.bincount(symbols, weight[:, s], minlength=len(emit))
    return moves, emissions


def _start(counts: np.ndarray) -> Model:
    """Sticky states whose emissions are the tokens' shares, unlike by a fixed draw."""
    draw = np.random.default_rng(11)
    emit = (counts[:, None] + SMOOTH) * np.exp(draw.standard_normal((len(counts), STATES)))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _improved(moves: np.ndarray, emissions: np.ndarray) -> Model:
    k = emissions.shape[1]
    start, move, emit = moves[k, :k] + SMOOTH, moves[:k, :k] + SMOOTH, emissions + SMOOTH
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts; tasks pass on partial counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen.keys()), pa.binary()).cast(pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for text in utf8(batch.column(0)):
                seen.update(text.lower().split())
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        yield out()

    return map_batches(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _baum_welch(symbols: DataFrame, model: Model) -> Model:
    spark = symbols.sparkSession
    shared = spark.sparkContext.broadcast(model)  # SYMBOLS x STATES numbers
    names = [f"s{k}" for k in range(STATES)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, emissions = np.zeros((STATES + 1, STATES + 1)), np.zeros((SYMBOLS, STATES))
        for batch in batches:
            m, e, _ = expected(shared.value, [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(0).to_pylist()])
            moves += m
            emissions += e
        at = np.append(np.flatnonzero(emissions.any(1)), -1 - np.arange(STATES + 1))
        rows = np.vstack([emissions[at[at >= 0]], moves[:, :STATES]])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(rows[:, k]) for k in range(STATES))], ["at", *names])

    sums = map_batches(symbols.select("symbols"), expect, "at long, " + ", ".join(f"{n} double" for n in names))
    got = sums.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # one row a symbol
    at, rows = got.column("at").to_numpy(), np.stack([got.column(n).to_numpy() for n in names], axis=1)
    moves, emissions = np.zeros((STATES + 1, STATES + 1)), np.zeros((SYMBOLS, STATES))
    emissions[at[at >= 0]] = rows[at >= 0]
    moves[-1 - at[at < 0], :STATES] = rows[at < 0]
    shared.destroy()
    return _improved(moves, emissions)


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = tune(docs.sparkSession)
    own = docs.select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    training = own.where(~F.col("held_out"))
    counts = cut(count_words(training), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    n, v = totals[0] + ends, totals[1] + (ends > 0)
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    words, often = [w.encode() for w in top.column("word").to_pylist()], top.column("n").to_numpy()
    known = dict(zip(words, range(len(words)), strict=True))
    frequent = spark.createDataFrame(top.to_pandas()[["word"]], "word string")  # FREQUENT rows
    rare = counts.join(F.broadcast(frequent), "word", "left_anti")
    by_class = {r[0]: (r[1], r[2]) for r in rare.groupBy(_sql_class()).agg(F.sum("n"), F.count("*")).collect()}  # CLASSES rows
    first = np.zeros(SYMBOLS)
    first[: len(often)] = often
    for k, (tokens, _) in by_class.items():
        first[FREQUENT + k] = tokens
    first[END] = ends
    share = np.zeros(SYMBOLS)  # log10 of the tokens that a rare word shares its class with
    for k in range(CLASSES):
        share[FREQUENT + k] = log10(sum(by_class.get(k, (0, 0))) + 1)
    base = np.log10(np.append(np.append(often, np.zeros(SYMBOLS - 1 - len(often))), ends) + 1.0) - log10(n + v + 1)
    tables = spark.sparkContext.broadcast((known, base, share, n))  # FREQUENT words

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, share, n = tables.value
        for batch in batches:
            symbols, others, sums, shares, seen = [], [], [], [], []
            for text in utf8(batch.column(2)):
                own = text.lower().split()
                ids = np.fromiter((known.get(w, -1) for w in own), np.int64, len(own))
                at = np.flatnonzero(ids < 0).tolist()
                odd = [own[k] for k in at]
                ids[at] = [FREQUENT + class_of(w) for w in odd]
                ids = np.append(ids, END)
                symbols.append(ids.astype("<u2").tobytes())
                others.append(odd)
                sums.append(float(base[ids].sum()))
                shares.append(float(share[ids].sum()))
                seen.append(len(own) - len(odd) + (n > 0))
            sizes = [len(s) // 2 for s in symbols]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()), pa.array(seen, pa.int64()), pa.array(sums, pa.float64()), pa.array(shares, pa.float64()), pa.array(symbols, pa.binary()), pa.array(others, pa.list_(pa.binary())).cast(pa.list_(pa.string()))],
                ["row", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "shares", "symbols", "others"],
            )

    kept = cut(map_batches(own.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out"), encode, "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, shares double, symbols binary, others array<string>"), "symbols")
    sequences = kept.where(~F.col("held_out"))
    model = _start(first)
    for _ in range(rounds if ends else 0):
        model = _baum_welch(sequences, model)
    shared = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = likelihood(shared.value, [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(7).to_pylist()])
            like = like / np.log(10) - batch.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(like)], ["row", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "like"])

    scored = map_batches(kept.drop("others"), forward, "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, like double")
    found = kept.select("row", F.explode("others").alias("word")).join(rare, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("logs"), F.count("*").alias("n_rare"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("like") + logs).alias("score"),
    )

