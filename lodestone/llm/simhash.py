"""SimHash near-dedup with a binary trie self-join.

component_table() is the plain operator: 64-bit fingerprints of word shingles,
links between fingerprints that differ in few bits, connected components.
Fingerprints are made distinct first, so groups of equal texts cost one row.
A fingerprint within the budget of another agrees with it in one of budget + 1
blocks of bits: for each block the fingerprints are rotated so that it leads,
dealt out by its value, and joined below that node of the trie; a node with
very many is dealt out further, by pairs of nodes below it. Within a task
only a spanning forest of the links is passed on, so a dense group gives no
more rows than it has members.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero, linked like any other; a null doc_id is kept as a row and
never names a component unless all its members' ids are null; repeated rows
each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, map_batches, tune, utf8
from lodestone.llm.components import components
from lodestone.llm.trie import forest, self_join

#: Of the contract: words in a shingle, seed of the hash, bits that linked fingerprints may differ in.
WORDS, SEED, BITS, BUDGET = 3, 42, 64, 2
#: Rows gathered before the groups among them are joined; rows of a group from which it is dealt out further, by so many bits.
GATHER, HOT, SUB = 1 << 20, 1 << 18, 8
_FULL = (1 << 64) - 1


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the lower-cased text's word shingles, repeats included; fewer words give one shingle of all."""
    from xxhash import xxh64_intdigest

    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) < words:
        return np.array([xxh64_intdigest(b" ".join(own), SEED)], np.uint64)
    line = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own]).tolist()
    starts = [0, *ends]
    return np.fromiter((xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)), np.uint64, len(own) - words + 1)


_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS_OF for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, text_column: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(shingle_hashes(t, words)) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(made), pa.int64())], ["doc_id", "fp"])

    return map_batches(tune(docs.sparkSession) and docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column), make, "doc_id long, fp long")


def block_bounds(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the blocks, from the highest down."""
    widths = [bits // blocks + (k < bits % blocks) for k in range(blocks)]
    return [(bits - sum(widths[: k + 1]), w) for k, w in enumerate(widths)]


def _rotate(x: np.ndarray, left: int, bits: int) -> np.ndarray:
    if not left:
        return x
    mask = np.uint64((1 << bits) - 1)
    return ((x << np.uint64(left)) | (x >> np.uint64(bits - left))) & mask


def dealt(fps: np.ndarray, bits: int, budget: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of budget + 1 blocks: its number, its values, and the fingerprints rotated so that it leads."""
    for k, (low, width) in enumerate(block_bounds(bits, budget + 1)):
        turned = _rotate(fps, bits - low - width, bits)
        yield k, turned >> np.uint64(bits - width), turned


def _differ(block: np.ndarray, bits: int, budget: int) -> np.ndarray:
    """Per row, the bits (of its rotated fingerprint) of the blocks before its own, in each of which a pair must differ to be new."""
    bounds = block_bounds(bits, budget + 1)
    rows = np.zeros((budget + 1, budget), np.uint64)
    for k, (low, width) in enumerate(bounds):
        for e, (other, w) in enumerate(bounds[:k]):
            rows[k, e] = int(_rotate(np.array([((1 << w) - 1) << other], np.uint64), bits - low - width, bits)[0])
    return rows[block]


def joined(rows: DataFrame, bits: int, budget: int, extra: list[str], links: Callable) -> DataFrame:
    """Rows (key, block, fp rotated, node, extra...) to links (u, v) of nodes.

    links(part, i, j) picks, from all pairs of one gathering, those to pass on.
    """
    width = block_bounds(bits, budget + 1)[-1][1]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done(part: dict) -> Iterator[pa.RecordBatch]:
            key = part["key"]
            if len(key) < 2:
                return
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lo, hi = edges, np.append(edges[1:], len(key))
            fps = part["fp"].view(np.uint64)
            for i, j in links(part, self_join(fps, lo, hi, bits - 1 - width, budget, _differ(part["block"], bits, budget))):
                yield pa.RecordBatch.from_arrays([pa.array(part["node"][i]), pa.array(part["node"][j])], ["u", "v"])

        for batch in batches:
            held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "block", "fp", "node", *extra)})
            if sum(len(h["key"]) for h in held) >= GATHER:
                part = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                last = int(np.searchsorted(part["key"], part["key"][-1]))  # where the last, perhaps unfinished group begins
                yield from done({n: x[:last] for n, x in part.items()})
                held = [{n: x[last:] for n, x in part.items()}]
        if held:
            yield from done({n: np.concatenate([h[n] for h in held]) for n in held[0]})

    ordered = rows.repartition("key").sortWithinPartitions("key", "fp")
    return map_batches(ordered, join, "u long, v long")


def split_hot(rows: DataFrame, budget: int) -> DataFrame:
    """rows (key, sub, ...) without `sub`, the SUB bits below the block; groups of over HOT rows are dealt out further.

    Two linked fingerprints differ in `budget` of these bits at most, so a hot
    group becomes a group for each pair of values that do, and every row goes
    to those of its value. Pairs within one value are met more than once.
    """
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "hot")
    n = counts.count()
    if not n:
        return rows.drop("sub")
    marks = counts.withColumn("hot", F.lit(True))
    marked = rows.join(F.broadcast(marks) if n <= 1_000_000 else marks, "key", "left")
    masks = F.array(*[F.lit(m) for m in range(1 << SUB) if m.bit_count() <= budget])
    other = F.col("sub").bitwiseXOR(F.col("mask"))
    pair = F.least("sub", other) * (1 << SUB) + F.greatest("sub", other) + 1
    warm = marked.where("hot").withColumn("mask", F.explode(masks)).withColumn("key", F.shiftleft(pair.cast("long"), 44) + F.col("key"))
    return marked.where("hot is null").drop("hot", "sub").unionByName(warm.drop("hot", "sub", "mask"))


def sub_bits(turned: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The SUB bits below the leading block."""
    return ((turned >> np.uint64(bits - width - SUB)) & np.uint64((1 << SUB) - 1)).astype(np.int32)


def _spanning(part: dict, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the pairs, kept small while they come."""
    i = j = np.zeros(0, np.int64)
    n = len(part["key"])
    for a, b in pairs:
        i, j = np.append(i, a), np.append(j, b)
        if len(i) > 4 * n + GATHER:
            keep = forest(n, i, j, np.zeros(len(i)))
            i, j = i[keep], j[keep]
    if len(i):
        keep = forest(n, i, j, np.zeros(len(i)))
        yield i[keep], j[keep]


def component_table(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    made = cut(fingerprints(docs, words), "fingerprints")
    classes = cut(made.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for k, value, turned in dealt(node.view(np.uint64), BITS, budget):
                sub = sub_bits(turned, BITS, block_bounds(BITS, budget + 1)[k][1])
                yield pa.RecordBatch.from_arrays([pa.array(_signed(value) * (budget + 1) + k), pa.array(np.full(len(node), k, np.int32)), pa.array(_signed(turned)), pa.array(node), pa.array(sub)], ["key", "block", "fp", "node", "sub"])

    rows = split_hot(map_batches(classes.select("fp"), deal, "key long, block int, fp long, node long, sub int"), budget)
    reached = cut(components(joined(rows, BITS, budget, [], _spanning)), "components")
    named = reached.join(classes, reached["node"] == classes["fp"])
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id").unionByName(classes.join(reached, classes["fp"] == reached["node"], "left_anti").select("fp", F.col("first_id").alias("component_id")))
    return made.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
