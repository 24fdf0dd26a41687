"""Benchmark decontamination by seeds that miss no leak.

A mask is a fixed window of token positions, some of which may be ignored. An
overlap of e equal tokens at 80 % has e / 4 others at most, so e / 4 + 1 runs
of equal tokens; for e of 13 or more these have over 3 on average, so one has
4, and windows of 4 equal tokens meet every leak. The masked windows of all
benchmark items are hashed; every window of every document is looked up, first
in a bit table and then exactly. At each hit the document is laid along the
item, token by token without gaps, and diagonals of fewer than MATCHED equal
tokens are left. Any stretch there of at least MATCHED equal tokens, IDENTITY
of those it spans, is a leak, whatever lies beside it; GIVE_UP tokens in a row
that differ end a stretch. So is any exact copy of a whole item of fewer than
MATCHED tokens (SHORTEST at least).

The look-up table of one pass is bounded: items beyond BLOCK_TOKENS tokens are
dealt over several passes, each over all documents and each on its own: what a
pass finds is written by row before the next one's table is made, and the
findings are joined to the rows at the end.

Defined cases: null or blank texts and items match nothing; items of fewer
than SHORTEST tokens are no evidence and match nothing; item rows that repeat
are found under their item_id once; null item_ids are left out; of overlaps
with one item the one with the most equal tokens is told, of ties the first
found; hits in a text of any length are held in parts of bounded size;
repeated documents give a row each; an empty table of documents gives no rows,
one of items no leak; other columns are ignored by find_leaks() and kept by
drop_leaks() and with_leaks(), whose own column gets underscores where names
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fresh, tune, with_columns

#: Fixed masks: 1 is compared, 0 ignored.
MASKS = ("1111",)
#: Least equal tokens of an overlap, least share of equal tokens in it, tokens that differ in a row and end it.
MATCHED, IDENTITY, GIVE_UP = 13, 0.8, 4
SHORTEST = 5
#: Benchmark tokens of one pass.
BLOCK_TOKENS = 2_000_000
#: Hits, and tokens along their diagonals, that are held at once.
HELD = 1 << 20
_BITS = 22


def tokens_of(text: str) -> list[str]:
    """Lower-cased words, in any alphabet, without the punctuation at their ends."""
    return [w for w in (x.strip(punctuation) for x in text.lower().split()) if w]


def _offsets(mask: str) -> np.ndarray:
    return np.flatnonzero(np.array(list(mask)) == "1")


def _hashes(ids: np.ndarray, offsets: np.ndarray, span: int) -> np.ndarray:
    """A hash of each window's compared positions; windows that hold an unknown token (0) there give 0."""
    n = len(ids) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, ok = np.full(n, 0x243F6A8885A308D3, np.uint64), np.ones(n, bool)
    for o in offsets:
        part = ids[o : o + n]
        ok &= part > 0
        out = (out ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.where(ok, out | np.uint64(1), np.uint64(0))


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about HELD in sum, one size at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, HELD + (ends[a - 1] if a else 0), "right")))
        yield a, b
        a = b


class Index:
    """All masked windows of some items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        self.items, self.names = [], []
        self.exact: dict[int, dict[tuple, list[int]]] = {}
        span = len(MASKS[0])
        for name, text in dict.fromkeys(items):
            own = tokens_of(text)
            if len(own) < SHORTEST:
                continue
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in own], np.int64)
            if len(own) < MATCHED:
                self.exact.setdefault(len(own), {}).setdefault(tuple(ids.tolist()), []).append(name)
                continue
            self.items.append(ids)
            self.names.append(name)
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.items])
        self.seeds = []
        for k, mask in enumerate(MASKS):
            made = [_hashes(ids, _offsets(mask), span) for ids in self.items]
            keys = np.concatenate([np.zeros(0, np.uint64), *made])
            which = np.repeat(np.arange(len(made)), [len(m) for m in made])
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(m)) for m in made)])
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.seeds.append((keys[order], which[order], at[order].astype(np.int64), bits))

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item_id to the longest overlap: first token in the document, tokens, equal tokens."""
        own = tokens_of(text)
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in own), np.int64, len(own))
        if not ids.any():
            return {}
        found: dict[int, tuple[int, int, int]] = {}
        for item, shift in self._diagonals(ids):
            own_item = self.items[item]
            lo, hi = max(0, shift), min(len(ids), shift + len(own_item))
            leak = self._overlap(ids[lo:hi] == own_item[lo - shift : hi - shift])
            if leak:
                name = self.names[item]
                if name not in found or leak[2] > found[name][2]:
                    found[name] = (lo + leak[0], *leak[1:])
        for size, wanted in self.exact.items():
            heads = {w[0] for w in wanted}
            for a in np.flatnonzero(ids[: max(0, len(ids) - size + 1)]).tolist():
                if ids[a] in heads:
                    for name in wanted.get(tuple(ids[a : a + size].tolist()), ()):
                        found.setdefault(name, (a, size, size))
        return found

    def _diagonals(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(item, place of its first token in the document) of the diagonals that hold a hit and MATCHED equal tokens."""
        longest = int(self.sizes.max(initial=0))
        width, wanted = len(ids) + longest, [np.zeros(0, np.int64)]
        for mask, (keys, which, at, bits) in zip(MASKS, self.seeds, strict=True):
            if not len(keys):
                continue
            mine = _hashes(ids, _offsets(mask), len(mask))
            live = np.flatnonzero(bits[(mine >> np.uint64(64 - _BITS)).astype(np.int64)] & (mine > 0))
            lo, hi = np.searchsorted(keys, mine[live]), np.searchsorted(keys, mine[live], "right")
            for a, b in _parts(hi - lo):
                n = (hi - lo)[a:b]
                place = np.repeat(live[a:b], n)
                entry = np.arange(int(n.sum())) + np.repeat(lo[a:b] - (np.cumsum(n) - n), n)
                wanted.append(np.unique(which[entry] * width + place - at[entry] + longest))
        item, shift = np.divmod(np.unique(np.concatenate(wanted)), max(1, width))
        shift -= longest
        first = np.maximum(0, shift)
        n = np.minimum(len(ids), shift + self.sizes[item]) - first
        kept: list[tuple[int, int]] = []
        for a, b in _parts(n):
            begin = np.cumsum(n[a:b]) - n[a:b]
            along = np.arange(int(n[a:b].sum())) - np.repeat(begin, n[a:b])
            same = ids[np.repeat(first[a:b], n[a:b]) + along] == self.flat[np.repeat((self.starts[item] + first - shift)[a:b], n[a:b]) + along]
            enough = a + np.flatnonzero(np.add.reduceat(same, begin, dtype=np.int64) >= MATCHED)
            kept += zip(item[enough].tolist(), shift[enough].tolist(), strict=True)
        return kept

    @staticmethod
    def _overlap(same: np.ndarray) -> tuple[int, int, int] | None:
        """The stretch with the most equal tokens of one diagonal that is a leak: first, tokens, equal tokens.

        GIVE_UP tokens in a row that differ end a stretch; within, every pair of ends counts.
        """
        best = None
        equal = np.flatnonzero(same)
        for at in np.split(equal, np.flatnonzero(np.diff(equal) > GIVE_UP) + 1):
            if len(at) < max(MATCHED, best[2] + 1 if best else 0):
                continue
            # tokens p to q are a leak if q + 1 - p >= IDENTITY * (at[q] + 1 - at[p]): worth[p] <= worth[q] + 1 - IDENTITY
            worth = np.arange(len(at)) - IDENTITY * at
            first = np.searchsorted(-np.minimum.accumulate(worth), -worth - (1 - IDENTITY) - 1e-9)
            size = np.arange(len(at)) + 1 - first
            q = int(size.argmax())
            if size[q] >= max(MATCHED, best[2] + 1 if best else 0):
                best = int(at[first[q]]), int(at[q] - at[first[q]] + 1), int(size[q])
        return best


def _passes(benchmark: DataFrame) -> list[DataFrame]:
    """Bounded parts of the benchmark, of about BLOCK_TOKENS tokens."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / 5
    parts = 1 + int(total // BLOCK_TOKENS)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [items]


LEAK = "array<struct<item_id:long,first_token:long,tokens:long,equal_tokens:long>>"


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with `leaks`, the overlaps with benchmark items by item_id."""
    spark = tune(docs.sparkSession)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first_token", "tokens", "equal_tokens")]))
    parts, names = _passes(benchmark), [*docs.columns, fresh("leaks", docs.columns)]
    at, row, found = docs.columns.index(text_column), len(docs.columns), None
    if len(parts) > 1:  # rows that repeat must be told apart, in every pass alike
        docs = cut(docs.toDF(*[f"_c{k}" for k in range(row)]).withColumn("_row", F.monotonically_increasing_id()), "rows")
    for part in parts:
        shared = spark.sparkContext.broadcast(Index(sorted((r[0], r[1]) for r in part.collect())))  # BLOCK_TOKENS tokens, about

        def find(batch: pa.RecordBatch, shared=shared) -> list:
            find = shared.value.find
            return [[[{"item_id": k, "first_token": a, "tokens": n, "equal_tokens": e} for k, (a, n, e) in sorted(find(t or "").items())] for t in batch.column(at).to_pylist()]]

        out = with_columns(docs, find, f"leaks {LEAK}", [kind])
        if len(parts) == 1:
            return out.toDF(*names)
        some = cut(out.select("_row", F.col(out.columns[-1]).alias("_leaks")).where(F.size("_leaks") > 0), "leaks")
        shared.destroy()
        found = some if found is None else found.unionByName(some)
    leaks = found.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("_leaks"))).alias("_leaks"))
    return docs.join(leaks, "_row", "left").select(*docs.columns[:row], F.coalesce("_leaks", F.array().cast(LEAK)).alias("_leaks")).toDF(*names)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (item_ids), leaks (the overlaps) of every document."""
    out = with_leaks(docs.select("doc_id", "text"), benchmark)
    items = F.array_distinct(F.transform("leaks", lambda x: x["item_id"]))
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "leaks")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no passage with the benchmark, columns as they were."""
    own = [f"_c{k}" for k in range(len(docs.columns))]
    return with_leaks(docs, benchmark).toDF(*own, "_leaks").where(F.size("_leaks") == 0).select(*own).toDF(*docs.columns)
