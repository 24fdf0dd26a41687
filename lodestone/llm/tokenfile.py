"""Token-id files: frequency-ranked ids, byte-aligned, control bytes apart.

Every text is encoded with the tokenizers library and gets an end id. Ids are
replaced by their rank in the corpus (the most frequent is 0), and a rank
takes one to four bytes. Two bits a rank, four ranks to a control byte, tell
how many; control bytes and data bytes are separate streams, so a file is
decoded by a table look-up of all control bytes at once. Documents lie in
ascending doc_id order, first within a file and then over the files. The ids
by rank are a file of their own beside these, in the same coding, so a folder
holds all that its reader needs.

Defined cases: a null text counts as empty and gives the end id alone; null
doc_ids come first; rows with equal ids lie in the order of their tokens; a
document of any length lies in one file, which grows with it; without
documents there are no token files and the result is empty; other columns are
ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha1
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, map_batches, read_blobs, shared_path, tune, utf8, write_blobs
from lodestone.llm.pieces import GAP, STOP, plain_parts, spans

#: The id that ends a document; bytes of a file and of a range of documents, about; most ranges (then larger); words that a worker remembers.
END, FILE_BYTES, RANGE_BYTES, MOST_RANGES, CACHE = 2, 8 << 20, 16 << 20, 10_000, 1_400_000
#: Bytes of a group of texts and of the groups whose words are looked up together, about; a longer text is a group by itself.
GROUP_BYTES, HELD_BYTES = 2 << 20, 16 << 20
#: Rows up to which the table of files is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
MAGIC, RANKS_MAGIC = b"LDTK0002", b"LDTKRANK"
#: Lengths that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(ranks: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of documents of the given sizes; each document's control bytes are its own."""
    ranks = ranks.astype("<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    slots = np.zeros(4 * int((-(-sizes // 4)).sum()), np.uint8)
    slots[_slots(sizes)] = codes
    return (slots.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data.tobytes()


def _slots(sizes: np.ndarray) -> np.ndarray:
    """Each rank's place among the two-bit codes, where a document's codes fill whole bytes."""
    per = -(-sizes // 4)
    first = 4 * (np.cumsum(per) - per)
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def unpack(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranks of documents of the given sizes; each document's control bytes are its own."""
    lengths = LENGTHS[control].ravel()[_slots(sizes)]
    starts = np.cumsum(lengths) - lengths
    data = np.append(data, np.zeros(4, np.uint8))
    out = data[starts].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Known:
    """Words and their ids, which lie behind one another; the first words are STOP and GAP."""

    def __init__(self, kind: str) -> None:
        self.at = {STOP: 0, GAP: 1}
        self.ids, self.first, self.sizes = np.array([END], kind), np.array([0, 1]), np.array([1, 0])

    def find(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; -1 if not known."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list[bytes], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.ids, self.sizes = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, *sizes])
        self.first = np.cumsum(self.sizes) - self.sizes


#: Words that this worker knows, by tokenizer; they outlive a task.
_KNOWN: dict[str, Known] = {}


def flat_encoder(vocabulary: str) -> Callable[[list[list[bytes]]], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Encodes groups of texts in UTF-8 with the library: all ids of a group, and how many each text has.

    Texts are taken apart into words, and only words that are not known are
    encoded, many in one text: a token that ends a word tells where the next
    begins. Pieces that are not plain, or hold a special token, are encoded
    one by one.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(vocabulary)
    library.no_truncation()
    library.no_padding()
    tokens = library.get_vocab(with_added_tokens=True)
    kind = "<u2" if max(tokens.values()) < 1 << 16 else "<u4"
    ends_word = np.zeros(max(tokens.values()) + 1, bool)
    ends_word[[k for t, k in tokens.items() if t.endswith("</w>")]] = True
    special = [t.content.encode() for t in library.get_added_tokens_decoder().values()]
    key = sha1(vocabulary.encode()).hexdigest()

    def each(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([k for ids in made for k in ids], kind), np.array([len(ids) for ids in made], np.int64)

    def learn(known: Known, words: list[bytes], odd: list[bytes]) -> None:
        made = []
        for a in range(0, len(words), 512):
            some = b" ".join(words[a : a + 512]).decode()
            ids = np.array(library.encode_batch_fast([some], add_special_tokens=False)[0].ids, kind)
            last = np.flatnonzero(ends_word[ids]) + 1
            whole = len(last) == len(words[a : a + 512]) and last[-1] == len(ids)  # or else a tokenizer of another kind
            made.append((ids, np.diff(last, prepend=0)) if whole else each(some.split(" ")))
        made.append(each([w.removeprefix(GAP).decode() for w in odd]))
        known.add(words + odd, *zip(*made, strict=True))

    def encode(groups: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        known = _KNOWN.setdefault(key, Known(kind))
        if len(known.at) > CACHE:
            known = _KNOWN[key] = Known(kind)
        plain, odd = [], []
        for texts in groups:
            joined, others = plain_parts(texts, special)
            at, short = spans(joined)
            plain.append(pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(short)]))
            odd.append([GAP + u for u in others])
        found = pa.chunked_array(plain, pa.binary()).dictionary_encode().unify_dictionaries()  # one dictionary
        del plain
        names = found.chunk(0).dictionary.to_pylist()
        numbers = known.find(names)
        new = np.flatnonzero(numbers < 0)
        numbers[new] = len(known.at) + np.arange(len(new))
        learn(known, [names[k] for k in new.tolist()], [u for u in set().union(*odd) if u not in known.at])
        for part, others in zip(found.chunks, odd, strict=True):
            words = numbers[part.indices.to_numpy()]
            words[words == 1] = known.find(others)
            sizes = known.sizes[words]
            stops = np.cumsum(sizes)
            at = np.repeat(known.first[words] - (stops - sizes), sizes)
            at += np.arange(len(at))
            yield known.ids[at], np.diff(stops[words == 0], prepend=0)

    return encode


def encoder(vocabulary: str) -> Callable[[list[str | None]], list[bytes]]:
    """Encodes texts to little-endian ids, each with the end id."""
    flat = flat_encoder(vocabulary)

    def encode(texts: list[str | None]) -> list[bytes]:
        ((ids, sizes),) = flat([[(t or "").encode() for t in texts]])
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes))[: len(texts)]]

    return encode


def ids_table(docs: DataFrame, vocabulary: str, size: int, width: int, text_column: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, the end id last), and on a task's last row the counts of all its ids."""
    shared = tune(docs.sparkSession).sparkContext.broadcast(vocabulary)  # one file of a public tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, last, held, room = flat_encoder(shared.value), np.zeros(size, np.int64), None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for (ids, _), (made, sizes) in zip(held, encode([texts for _, texts in held]), strict=True):
                seen[:] += np.bincount(made, minlength=size)
                bounds = pa.py_buffer((np.append(0, np.cumsum(sizes)) * width).astype(np.int32))
                column = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, bounds, pa.py_buffer(made)])
                yield pa.RecordBatch.from_arrays([ids, column, pa.nulls(len(sizes), pa.binary())], ["doc_id", "ids", "counts"])

        def made() -> Iterator[pa.RecordBatch]:
            nonlocal held, room
            for batch in batches:
                texts, a = utf8(batch.column(1)), 0
                before = np.cumsum([0, *map(len, texts)])
                while a < len(texts):
                    b = max(a + 1, int(np.searchsorted(before, before[a] + GROUP_BYTES, "right")) - 1)
                    if held and room + before[b] - before[a] > HELD_BYTES:
                        yield from out()
                        held, room = [], 0
                    held.append((batch.column(0).slice(a, b - a), texts[a:b]))
                    room += int(before[b] - before[a])
                    a = b
            if held:
                yield from out()

        for batch in made():
            if last is not None:
                yield last
            last = batch
        if last is not None:
            counts = pa.array([None] * (last.num_rows - 1) + [seen.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([*last.columns[:2], counts], last.schema.names)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column), run, "doc_id long, ids binary, counts binary")


def rank_table(ids: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Ids by falling frequency over all documents, ties by id, ids that do not occur last; and how many ids there are in all."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                seen += np.frombuffer(raw, "<i8")
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["id", "n"])

    rows = ids.select("counts").where("counts is not null")  # one row a task
    got = map_batches(rows, spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # one row an id
    total = np.zeros(size, np.int64)
    total[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return np.argsort(-total, kind="stable").astype(np.uint32), int(total.sum())


def ranks_blob(order: np.ndarray) -> bytes:
    """The file of the ids by rank."""
    control, data = pack(order, np.array([len(order)]))
    return struct.pack("<8sqqq", RANKS_MAGIC, len(order), len(control), len(data)) + control + data + b"\0"


def parse_ranks(content: bytes) -> np.ndarray:
    magic, n, control, data = struct.unpack_from("<8sqqq", content)
    if magic != RANKS_MAGIC:
        raise ValueError("not a file of ranks")
    return unpack(np.frombuffer(content, np.uint8, control, 32), np.frombuffer(content, np.uint8, data, 32 + control), np.array([n]))


def _blob(part: int, index: int, docs: list[int | None], sizes: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks, np.array(sizes, np.int64))
    head = struct.pack("<8sqqqqq", MAGIC, part, index, len(docs), len(control), len(data))
    table = np.array([0 if d is None else d for d in docs], "<i8").tobytes() + np.array(sizes, "<i8").tobytes() + bytes(d is None for d in docs)
    return head + table + control + data + b"\0"


def write(ids: DataFrame, path: str, order: np.ndarray, width: int, total: int) -> None:
    """Files of the documents in ascending doc_id order: a range's documents meet in one task, and a file holds documents of one range.

    Of one doc_id that has very many rows, these are parted by how their ids begin.
    """
    spark = ids.sparkSession
    write_blobs(spark.createDataFrame([(bytearray(ranks_blob(order)),)], "value binary").coalesce(1), f"{path}/ranks")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)  # one number an id
    kind = f"<u{width}"

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, at, index, held, room = shared.value, TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            docs, raw = zip(*held, strict=True)
            made = _blob(at, index, docs, [len(r) // width for r in raw], rank[np.frombuffer(b"".join(raw), kind)])
            return pa.RecordBatch.from_pydict({"value": pa.array([made], pa.binary())})

        for batch in batches:
            for doc, raw in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                if held and room >= FILE_BYTES:
                    yield out()
                    index, held, room = index + 1, [], 0
                held.append((doc, raw))
                room += len(raw) * 4 // 5 + 17  # two bytes an id become about 1.6
        if held:
            yield out()

    ranges = min(MOST_RANGES, max(1 + total * width // RANGE_BYTES, spark.sparkContext.defaultParallelism))
    placed = ids.select("doc_id", "ids").repartitionByRange(ranges, "doc_id", F.substring("ids", 1, 8)).sortWithinPartitions("doc_id", "ids")
    write_blobs(map_batches(placed, files, "value binary"), f"{path}/files")


def parse(content: bytes, order: np.ndarray) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """Range, index, doc_ids, sizes and all ids of a file."""
    magic, part, index, n, control, data = struct.unpack_from("<8sqqqqq", content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = 48
    ids = np.frombuffer(content, "<i8", n, at)
    sizes = np.frombuffer(content, "<i8", n, at + 8 * n)
    none = np.frombuffer(content, np.uint8, n, at + 16 * n)
    at += 17 * n
    ranks = unpack(np.frombuffer(content, np.uint8, control, at), np.frombuffer(content, np.uint8, data, at + control), sizes)
    return part, index, [None if x else int(k) for k, x in zip(ids, none, strict=True)], sizes, order[ranks]


def read(spark: SparkSession, path: str, columns: str, result: Callable[[np.ndarray], object], kinds: Iterable[pa.DataType]) -> DataFrame:
    """doc_id, start, n_tokens and what result() makes of each document's ids, from the files alone."""
    (ranks,) = read_blobs(tune(spark), f"{path}/ranks").select("content").collect()  # one number an id
    shared = spark.sparkContext.broadcast(parse_ranks(bytes(ranks[0])))
    names, kinds = [c.split()[0] for c in columns.split(", ")], list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, index, docs, sizes, ids = parse(batch.column(0)[k].as_py(), shared.value)
                ends = np.cumsum(sizes)
                made = zip(*(result(ids[b - n : b]) for b, n in zip(ends, sizes, strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int64()), pa.array([index] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(ends - sizes), pa.array(sizes), *(pa.array(list(m), t) for m, t in zip(made, kinds, strict=True))], ["part", "index", "doc_id", "within", "n_tokens", *names])

    rows = cut(map_batches(read_blobs(spark, f"{path}/files").select("content"), run, f"part long, index long, doc_id long, within long, n_tokens long, {columns}"), "decoded")
    sums = cut(rows.groupBy("part", "index").agg(F.max(F.col("within") + F.col("n_tokens")).alias("n")), "sums")  # one row a file
    upto = lambda order: F.sum("n").over(order) - F.col("n")
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select("part", upto(Window.orderBy("part")).alias("start"))  # MOST_RANGES rows
    before = sums.select("part", "index", upto(Window.partitionBy("part").orderBy("index")).alias("inner")).join(F.broadcast(parts), "part")
    before = before.select("part", "index", (F.col("start") + F.col("inner")).alias("before"))
    return rows.join(F.broadcast(before) if sums.count() <= BROADCAST_ROWS else before, ["part", "index"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", *names)


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = docs.sparkSession
    vocabulary = Path(vocabulary_path).read_text(encoding="utf-8")
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_str(vocabulary).get_vocab(with_added_tokens=True).values()) + 1
    width = 2 if size <= 1 << 16 else 4
    ids = cut(ids_table(docs, vocabulary, size, width), "ids")
    order, total = rank_table(ids, size)
    path = shared_path(spark, "tokens")
    write(ids, path, order, width, total)
    return read(spark, path, "ids_crc32 long", lambda x: (zlib.crc32(x.astype("<u4").tobytes()),), [pa.int64()])
