"""Near copies by shingle similarity: SimHash tries bring pairs together, an exact check decides.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of SIMILARITY or more. Equal texts (by 128 bits) are one class.
Each class gets several independent SimHash words of its shingle set. Word by
word, the lowest bits are joined by the binary trie self-join of the plain
operator; as many bits as keep a row's chance partners below one, and as many
words as bring RECALL of the pairs at the threshold together (more similar
pairs surely). How often a bit of two sets at the threshold differs is counted
out for small sets, which differ more often and so get more words.
Pairs whose further bits are far apart are dropped at once, all others are
checked on their exact shingle sets. In a dense group, of more than DENSE
pairs a member, a task passes on a minimum spanning forest, which holds each
member's nearest pair, instead of all pairs; every block of every word does so
anew, by bits of its own. The forest keeps the group known: where the checked pairs
leave it in several parts, every pair of different parts is checked as well,
in cells of bounded size, so no pair that was brought together goes unchecked.

The plan depends on the number of documents by this rule alone.

Defined cases: texts without words are copies of each other; texts of fewer
words than a shingle have one shingle; a null text counts as empty; a text of
any length is one sketch, its shingles taken in parts of bounded size; in a
group the row with the smallest doc_id stays (null ids last), and of rows that
repeat it one; an empty table gives no rows; columns are kept, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, map_batches, tune, utf8
from lodestone.llm.components import components
from lodestone.llm.simhash import block_bounds, dealt, shingle_hashes, split_hot, sub_bits
from lodestone.llm.trie import forest, self_join

WORDS, SIMILARITY, RECALL, BUDGET = 5, 0.8, 0.999, 3
#: Pairs a member above which a group is dense; rows gathered before they are joined.
DENSE, GATHER = 2, 1 << 18
#: Members of a dense group on one side of a cell, shingles compared at once there.
CELL, SHINGLES = 256, 1 << 12
#: Rows of three longs up to which a stored table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Further bits that two texts at the threshold differ in: the mean and so many standard deviations.
SPREAD = 3.5


#: Shingles up to which the rate of differing bits is counted out.
SMALL = 64


@cache
def bit_rate(n: int, similarity: float) -> float:
    """The greatest chance that a bit differs between a set of n shingles and one of as many or fewer at the threshold; in the limit for n over SMALL."""
    if n > SMALL:
        return math.acos(2 * similarity / (1 + similarity)) / math.pi
    least = lambda k, x: sum(math.comb(k, i) for i in range(max(0, x), k + 1)) / 2**k  # noqa: E731  chance of x or more of k coins
    worst = 0.0
    for m in range(math.ceil(similarity * n - 1e-9), n + 1):
        both = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
        if both > m or both == n:
            continue
        chances = [(math.comb(both, s) / 2**both, least(n - both, n // 2 + 1 - s), least(m - both, m // 2 + 1 - s)) for s in range(both + 1)]
        worst = max(worst, sum(c * (a * (1 - b) + b * (1 - a)) for c, a, b in chances))
    return worst


def plan(n: int, similarity: float = SIMILARITY) -> tuple[int, np.ndarray]:
    """Bits joined for n texts, and the number of words of a text by its shingles (the last for more than SMALL)."""
    bits = 20
    while bits < 56 and sum(math.comb(bits, k) for k in range(BUDGET + 1)) * n > 2.0**bits:
        bits += 1

    def words(size: int) -> int:
        p = bit_rate(size, similarity)
        met = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(BUDGET + 1))
        return 2 if met >= RECALL else max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - met)))

    need = [words(k) for k in range(SMALL + 2)]
    # a pair shares the words of the one that has fewer: each has what its largest partner needs
    return bits, np.array([max(need[k : min(SMALL + 1, math.floor(k / similarity + 1e-9)) + 1]) for k in range(SMALL + 2)])


def class_hash(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def sketch(text: bytes, by_size: np.ndarray) -> np.ndarray:
    """Independent 64-bit SimHash words of the text's shingle set, as many as its size asks for."""
    hashes = np.unique(shingle_hashes(text, WORDS))
    words = int(by_size[min(len(hashes), len(by_size) - 1)])
    if not len(hashes):
        return np.zeros(words, np.uint64)
    salt = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    base = np.arange(words * 8)[:, None] * 256
    counts = np.zeros(words * 8 * 256)
    for a in range(0, len(hashes), 2048):
        x = hashes[a : a + 2048] + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        cells = x.view(np.uint8).reshape(words, -1, 8).transpose(0, 2, 1).reshape(words * 8, -1) + base
        counts += np.bincount(cells.ravel(), minlength=len(counts))
    ones = counts.reshape(words * 8, 256) @ _BITS_OF
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").reshape(words, 8).copy().view(np.uint64).ravel()


def _dense(i: np.ndarray, j: np.ndarray, apart: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a minimum spanning forest, and which pairs are of a dense group."""
    tree = forest(n, i, j, apart)
    label = np.arange(n)
    for _ in range(64):  # smallest member of each group, over the forest
        low = np.minimum(label[i[tree]], label[j[tree]])
        before = label.copy()
        np.minimum.at(label, i[tree], low)
        np.minimum.at(label, j[tree], low)
        label = label[label]
        if (label == before).all():
            break
    pairs = np.bincount(label[i], minlength=n)
    members = np.bincount(label, minlength=n)
    return tree, (pairs > DENSE * members)[label[i]]


def _pick(i: np.ndarray, j: np.ndarray, apart: np.ndarray, n: int, found: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Positions of the pairs to pass on: all of a sparse group, of a dense one a minimum spanning forest."""
    tree, dense = found or _dense(i, j, apart, n)
    keep = ~dense
    keep[tree] = True
    return np.flatnonzero(keep)


def candidates(classes: DataFrame, bits: int, by_size: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v, thin) of classes (cls, sketch) that are to be checked; pairs left out are joined by a chain of thin ones."""
    blocks, words = BUDGET + 1, int(by_size.max())
    bounds = block_bounds(bits, blocks)
    p = max(bit_rate(k, similarity) for k in range(SMALL + 2))
    rest = 128 - bits
    most = math.ceil(rest * p + SPREAD * math.sqrt(rest * p * (1 - p)))
    low = np.uint64((1 << bits) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column(0).to_numpy()
            raw = batch.column(1).to_pylist()
            own = np.array([len(x) // 8 for x in raw], np.int64)
            rows = np.zeros((len(cls), words), np.uint64)
            rows[np.arange(words) < own[:, None]] = np.frombuffer(b"".join(raw), np.uint64)
            for t in range(words):
                live = np.flatnonzero(own > t)
                word, more = rows[live, t], rows[live, t - 1 if t else 1]
                for k, value, turned in dealt(word & low, bits, BUDGET):
                    key = (value.astype(np.int64) * words + t) * blocks + k
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(word.view(np.int64)), pa.array(more.view(np.int64)), pa.array(cls[live]), pa.array(sub_bits(turned, bits, bounds[k][1]))], ["key", "word", "more", "cls", "sub"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k, (bottom, width) in enumerate(bounds):  # each block's rows have a rotation of their own
                rows = part[:, part[0] % blocks == k]
                if rows.shape[1] < 2:
                    continue
                left = bits - bottom - width
                turn = lambda x, left=left: ((x << np.uint64(left)) | (x >> np.uint64(bits - left))) & low if left else x
                fps = turn(rows[1].view(np.uint64) & low)
                order = np.lexsort((fps, rows[0]))
                rows, fps = rows[:, order], fps[order]
                edge = np.flatnonzero(np.append(True, np.diff(rows[0]) != 0))
                lo, hi = edge, np.append(edge[1:], rows.shape[1])
                differ = np.array([int(turn(np.array([((1 << w) - 1) << b], np.uint64))[0]) for b, w in bounds[:k]], np.uint64)
                high, more = rows[1].view(np.uint64) & ~low, rows[2].view(np.uint64)
                kept: list[tuple[np.ndarray, ...]] = []
                room = 0

                def picked(kept: list[tuple[np.ndarray, ...]], n: int = len(fps)) -> tuple[np.ndarray, ...]:
                    i, j, apart, thin = map(np.concatenate, zip(*kept, strict=True))
                    found = _dense(i, j, apart, n)
                    at = _pick(i, j, apart, n, found)
                    return i[at], j[at], apart[at], (thin | found[1])[at]

                for i, j in self_join(fps, lo, hi, bits - 1 - width, BUDGET, np.tile(differ, (len(fps), 1)) if k else None):
                    apart = np.bitwise_count(high[i] ^ high[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j])
                    ok = apart <= most
                    kept.append((i[ok], j[ok], apart[ok], np.zeros(int(ok.sum()), bool)))
                    room += int(ok.sum())
                    if room > 8 * len(fps) + GATHER:
                        kept, room = [picked(kept)], 0
                if kept:
                    i, j, _, thin = picked(kept)
                    u, v = rows[3][i], rows[3][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(thin)], ["u", "v", "thin"])

        held = np.zeros((4, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(4)])], axis=1)
            if held.shape[1] >= GATHER:
                last = int(np.searchsorted(held[0], held[0, -1]))  # where the last, perhaps unfinished group begins
                yield from done(held[:, :last])
                held = held[:, last:]
        yield from done(held)

    rows = split_hot(map_batches(classes.select("cls", "sketch"), deal, "key long, word long, more long, cls long, sub int"), BUDGET)
    return map_batches(rows.repartition("key").sortWithinPartitions("key"), join, "u long, v long, thin boolean").groupBy("u", "v").agg(F.max("thin").alias("thin"))


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (u, v) whose shingle sets are similar; texts has (cls, text), one row a class."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, mine = [], None, None
            for u, a, b in zip(batch.column(0).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
                if u != last:
                    last, mine = u, np.unique(shingle_hashes(a, WORDS))
                other = np.unique(shingle_hashes(b, WORDS))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                either = len(mine) + len(other) - both
                keep.append(both >= similarity * either)
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["u", "v"])

    a, b = texts.select(F.col("cls").alias("u"), F.col("text").alias("a")), texts.select(F.col("cls").alias("v"), F.col("text").alias("b"))
    return map_batches(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), check, "u long, v long")


def _alike(asking: list[np.ndarray], others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which shingle sets of the first list are similar to which of the second."""
    both = np.zeros((len(asking), len(others)))
    sides = []
    for sets in (asking, others):
        sides.append((np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    for a in range(0, len(shared), SHINGLES):
        part = shared[a : a + SHINGLES]
        holds = []
        for (flat, row), sets in zip(sides, (asking, others), strict=True):
            column = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            here = part[column] == flat
            matrix = np.zeros((len(sets), len(part)), np.float32)
            matrix[row[here], column[here]] = 1
            holds.append(matrix)
        both += holds[0] @ holds[1].T
    either = np.array([len(x) for x in asking])[:, None] + np.array([len(x) for x in others]) - both
    return both >= similarity * either


def across(pairs: DataFrame, part: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between the parts (cls, part) that a dense group is left in: all pairs of different parts are checked.

    The members outside a group's largest part meet all members, in cells of
    CELL by CELL dealt out by hash. A cell passes on a spanning forest of the
    parts that it found similar.
    """
    ends = pairs.where("thin").select("u", "v")
    for end in ("u", "v"):
        ends = ends.join(part.toDF(end, f"{end}_part"), end, "left").withColumn(f"{end}_part", F.coalesce(f"{end}_part", end))
    group = components(ends.select(F.col("u_part").alias("u"), F.col("v_part").alias("v"))).toDF("part", "dense")
    members = cut(group.join(part, "part", "left").select(F.coalesce("cls", "part").alias("cls"), "dense", "part"), "members")
    sizes = members.groupBy("dense", "part").agg(F.count("*").alias("n")).groupBy("dense")
    sizes = sizes.agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("most")).where("parts > 1")
    sides = [F.ceil(n / CELL).cast("int").alias(side) for n, side in ((F.col("n") - F.col("most.n"), "rows"), (F.col("n"), "columns"))]
    open_groups = cut(sizes.select("dense", F.col("most.part").alias("largest"), *sides), "open")
    members = members.join(_sized(open_groups), "dense")
    place = lambda side: F.pmod(F.xxhash64("cls"), F.col(side)).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    asking = members.where("part <> largest").select("dense", place("rows").alias("row"), every("columns").alias("column"), F.lit(True).alias("asks"), "cls", "part")
    asked = members.select("dense", every("rows").alias("row"), place("columns").alias("column"), F.lit(False).alias("asks"), "cls", "part")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            (mine, others) = sides
            if not mine or not others:
                return
            i, j = np.nonzero(_alike([x[2] for x in mine], [x[2] for x in others], similarity))
            names, label = np.unique([x[1] for x in (*mine, *others)], return_inverse=True)
            i, j = i, j + len(mine)
            new = label[i] != label[j]
            i, j = i[new], j[new]
            at = forest(len(names), label[i], label[j], np.zeros(len(i)))
            cls = np.array([x[0] for x in (*mine, *others)], np.int64)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(cls[i[at]]), pa.array(cls[j[at]])], ["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for key, asks, cls, part, text in zip(keys, *(batch.column(k).to_pylist() for k in range(3, 6)), utf8(batch.column(6)), strict=True):
                if key != cell:
                    yield from done()
                    cell, sides = key, ([], [])
                sides[0 if asks else 1].append((cls, part, np.unique(shingle_hashes(text, WORDS))))
        yield from done()

    rows = asking.unionByName(asked).join(texts, "cls").select("dense", "row", "column", "asks", "cls", "part", "text")
    return map_batches(rows.repartition("dense", "row", "column").sortWithinPartitions("dense", "row", "column"), check, "u long, v long")


def _sized(stored: DataFrame) -> DataFrame:
    """A stored table of few narrow columns, broadcast if its rows are counted to be few."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(hash, group, keeper, n) of every class that has a copy, equal or near: its group and the smallest doc_id there."""
    tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", class_hash(F.col("text")))
    bits, by_size = plan(max(2, docs.count()), similarity)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[bytes, bytes] = {}
            texts = utf8(batch.column(1))
            for t in texts:
                if t not in made:
                    made[t] = sketch(t, by_size).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([made[t] for t in texts], pa.binary())], ["doc_id", "hash", "sketch"])

    # every row's sketch is drawn where its text is, so that no text is shuffled for it
    drawn = map_batches(own.select("doc_id", "text", "hash"), draw, "doc_id long, hash binary, sketch binary")
    classes = drawn.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # numbers are drawn once, when written
    pairs = cut(candidates(classes, bits, by_size, similarity), "pairs")
    ends = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    ends = cut(classes.select("cls", "hash", "first_id").join(ends, "cls", "left_semi"), "ends")
    texts = own.join(_sized(ends), "hash").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("cls", "text")
    wanted = cut(texts.dropDuplicates(["cls"]), "texts")
    reached = components(similar(pairs.select("u", "v"), wanted, similarity))
    if pairs.where("thin").limit(1).count():
        reached = cut(reached, "parts")
        more = across(pairs, reached.toDF("cls", "part"), wanted, similarity)
        reached = components(reached.toDF("u", "v").unionByName(more))
    grouped = classes.join(reached, classes["cls"] == reached["node"], "left").select("hash", F.coalesce("root", "cls").alias("group"), "first_id", "n", F.col("root").isNotNull().alias("linked"))
    grouped = grouped.where("linked or n > 1")
    least = grouped.groupBy("group").agg(F.min("first_id").alias("keeper"))
    return cut(grouped.join(least, "group").select("hash", "group", "keeper", "n"), "groups")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of copies."""
    columns = [f"_c{k}" for k in range(len(docs.columns))]
    found = groups(docs, similarity).select(F.col("hash").alias("_hash"), F.col("group").alias("_group"), F.col("keeper").alias("_keeper"))
    own = docs.toDF(*columns)
    text, ident = columns[docs.columns.index("text")], columns[docs.columns.index("doc_id")]
    own = own.withColumn("_hash", class_hash(F.col(text))).join(_sized(found), "_hash", "left")
    single = own.where("_group is null").select(*columns)
    kept = own.where(F.col("_group").isNotNull() & F.col(ident).eqNullSafe(F.col("_keeper"))).dropDuplicates(["_group"]).select(*columns)
    return single.unionByName(kept).toDF(*docs.columns)
