"""BPE by a minimal acyclic transducer: frequent words from an automaton, others by exact merges.

The words that are most frequent in the corpus are compiled into a minimal
acyclic automaton that shares suffixes as well as prefixes. The outputs on a
word's arcs add up to the word's number, which gives its token ids. The
automaton is plain arrays in one file, which is written to the shared folder
and which Spark hands to every executor once; all its workers map that copy
into memory, read-only. A word that the automaton does not accept is merged
pair by pair, lowest rank first, which gives what the tokenizers library gives.

Defined cases: a null text counts as empty and gives no ids and an empty text;
strings of special tokens in a text become their ids, as in the library;
lone parts of very long texts need no special care, since a text is split at
blanks before anything else; words that tie for the last places of the lexicon
go by their letters; repeated rows are encoded each on their own; an empty
table gives an empty lexicon and no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_batches, read_blobs, shared_path, tune, write_blobs
from lodestone.llm.pieces import ODD, is_plain, plain_words, units

#: Words in the lexicon and the longest of them in bytes; entries of a worker's cache; distinct words counted before they are passed on.
LEXICON_WORDS, LONGEST, CACHE, COUNTED = 1 << 16, 48, 600_000, 400_000
_NONE = 1 << 30


def _slot(key, size: int):
    """Where a pair's search begins in a hash table of a power of two."""
    return ((key >> 32) * 40503 + (key & 0xFFFFFFFF) * 60493) & (size - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (c for c in range(256) if c not in set(printable))
    letters = {c: chr(c) for c in printable} | {c: chr(256 + n) for n, c in enumerate(others)}
    return [letters[c] for c in range(256)]


_LETTER_OF = dict(enumerate(byte_letters()))


class Vocabulary:
    """Ids, merge ranks and special tokens of a word-end BPE tokenizer file; pickles as its text."""

    def __init__(self, text: str):
        self.text = text

    def __getstate__(self) -> dict:
        return {"text": self.text}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(Path(path).read_text(encoding="utf-8"))

    @cached_property
    def parts(self) -> dict:
        return json.loads(self.text)

    @cached_property
    def ids(self) -> dict[str, int]:
        return self.parts["model"]["vocab"]

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {(a, b): k for k, (a, b) in enumerate(self.parts["model"]["merges"])}

    @cached_property
    def special(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self.parts["added_tokens"]}

    @cached_property
    def tokens(self) -> list[str]:
        every = self.ids | self.special
        out = [""] * (max(every.values()) + 1)
        for token, k in every.items():
            out[k] = token
        return out

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.text)

    def letters(self, word: str) -> str:
        """A plain word in the vocabulary's letters."""
        return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTER_OF)

    def words(self, piece: str) -> list[str]:
        """The words of a text without ASCII blanks, in the vocabulary's letters."""
        if is_plain(piece):
            return [self.letters(w) for w in plain_words(piece)]
        made = self.library.normalizer.normalize_str(piece)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(made)]

    def merge(self, word: str) -> list[int]:
        """Exact merges of one word: again and again the pair of lowest rank, the leftmost first."""
        letters = [*word[:-1], word[-1] + "</w>"]
        letters = [x for x in letters if x in self.ids]
        if len(letters) > 64:
            return self._merge_long(letters)
        none, rank = 1 << 30, self.ranks.get
        ranks = [rank(p, none) for p in zip(letters, letters[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            letters[at] += letters.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((letters[at - 1], letters[at]), none)
            if at < len(ranks):
                ranks[at] = rank((letters[at], letters[at + 1]), none)
        return [self.ids[x] for x in letters]

    @cached_property
    def arrays(self) -> tuple[np.ndarray, ...]:
        """For merge_all: ids of letters within and at the end of a word; the pairs' hash table (keys, ranks); ids that the ranks make."""
        inner, last = np.full(1 << 16, -1, np.int32), np.full(1 << 16, -1, np.int32)
        for letter in byte_letters():
            inner[ord(letter)] = self.ids.get(letter, -1)
            last[ord(letter)] = self.ids.get(letter + "</w>", -1)
        size = 1 << (4 * len(self.ranks)).bit_length()
        keys, ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        made = np.zeros(len(self.ranks) + 1, np.int32)
        for (a, b), rank in self.ranks.items():
            made[rank] = self.ids[a + b]
            key = self.ids[a] << 32 | self.ids[b]
            at = _slot(key, size)
            while keys[at] >= 0:
                at = (at + 1) % size
            keys[at], ranks[at] = key, rank
        return inner, last, keys, ranks, made

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """merge() of many words: each step merges one pair in every word that has one left."""
        out: list[list[int]] = [[]] * len(words)
        inner, last, keys, ranks, made = self.arrays
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        short = order[(sizes[order] > 0) & (sizes[order] <= 32)]
        for k in order[sizes[order] > 32].tolist():
            out[k] = self.merge(words[k])
        for a in range(0, len(short), 8192):
            some = short[a : a + 8192]
            n, width = sizes[some], int(sizes[some[-1]])
            code = np.frombuffer("".join([words[k] for k in some.tolist()]).encode("utf-16-le"), np.uint16)
            flat, ends = inner[code], np.cumsum(n) - 1
            flat[ends] = last[code[ends]]
            if (flat < 0).any():  # a vocabulary without all letters
                for k in some.tolist():
                    out[k] = self.merge(words[k])
                continue
            token = np.full((len(some), width + 1), -1, np.int64)
            token[np.arange(width + 1) < n[:, None]] = flat
            live, column = np.arange(len(some)), np.arange(width)
            while len(live):
                now = token[live]
                key = now[:, :-1] << 32 | now[:, 1:]
                key[now[:, 1:] < 0] = -2
                at = _slot(key, len(keys))
                hit = keys[at]
                rank = np.where(hit == key, ranks[at], _NONE)
                more = np.flatnonzero((hit != key) & (hit >= 0) & (key >= 0))
                while len(more):
                    at.flat[more] = (at.flat[more] + 1) % len(keys)
                    hit = keys[at.flat[more]]
                    found = hit == key.flat[more]
                    rank.flat[more[found]] = ranks[at.flat[more[found]]]
                    more = more[~found & (hit >= 0)]
                best = rank.argmin(1)
                lowest = rank[np.arange(len(live)), best]
                go = lowest < _NONE
                live, now, best = live[go], now[go], best[go]
                now[np.arange(len(live)), best] = made[lowest[go]]
                now[:, 1:-1] = np.where(column[1:] > best[:, None], now[:, 2:], now[:, 1:-1])
                token[live] = now
            left = (token >= 0).sum(1)
            whole, ends = token[token >= 0].tolist(), np.cumsum(left).tolist()
            for k, b, m in zip(some.tolist(), ends, left.tolist(), strict=True):
                out[k] = whole[b - m : b]
        return out

    def _merge_long(self, letters: list[str]) -> list[int]:
        """The same with a queue, for words of any length."""
        n, ranks = len(letters), self.ranks
        after, before, live = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        queue = [(r, k, letters[k], letters[k + 1]) for k in range(n - 1) if (r := ranks.get((letters[k], letters[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            j = after[k]
            if not live[k] or j < 0 or letters[k] != a or letters[j] != b:
                continue
            letters[k], live[j], after[k] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := ranks.get((letters[x], letters[y]))) is not None:
                    heapq.heappush(queue, (r, x, letters[x], letters[y]))
        return [self.ids[x] for x, on in zip(letters, live, strict=True) if on]


def compile_transducer(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer from words to ids, as bytes.

    Words are added in order; a state that can get no more arcs is replaced by
    an equal one if there is such (shared suffixes). An arc's output is the
    number of accepted words that come before those through it.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (final, ((byte, target), ...)) of frozen states

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    open_nodes: list[list] = [[False, []]]
    path = b""
    for word in words:
        common = 0
        while common < min(len(path), len(word)) and path[common] == word[common]:
            common += 1
        for k in range(len(path), common, -1):
            node = open_nodes.pop()
            open_nodes[-1][1].append((path[k - 1], freeze(node)))
        open_nodes += [[False, []] for _ in word[common:]]
        open_nodes[-1][0] = True
        path = word
    for k in range(len(path), 0, -1):
        node = open_nodes.pop()
        open_nodes[-1][1].append((path[k - 1], freeze(node)))
    root = freeze(open_nodes[0])

    size = np.zeros(len(states), np.int64)  # targets are frozen before their sources
    key, target, output = [], [], []
    for k, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, to in arcs:
            key.append(k << 8 | byte)
            target.append(to)
            output.append(n)
            n += size[to]
        size[k] = n
    final = np.array([f for f, _ in states], np.uint8)
    ids = np.concatenate([np.zeros(0, np.int64), *(entries[w] for w in words)]).astype(np.uint32)
    ends = np.cumsum([0, *(len(entries[w]) for w in words)])
    order = np.argsort(np.array(key, np.int64), kind="stable")
    arrays = [np.array([root], np.int64), np.array(key, np.int64)[order], np.array(target, np.int64)[order], np.array(output, np.int64)[order], ends.astype(np.int64), ids, final]
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Transducer:
    """Reads a compiled transducer through a memory map."""

    KINDS = (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint32, np.uint8)

    def __init__(self, data: bytes | mmap.mmap):
        self.map = data
        head = np.frombuffer(self.map, np.int64, 1 + len(self.KINDS))
        at, arrays = 8 * len(head), []
        for kind, size in zip(self.KINDS, head[1:], strict=True):
            arrays.append(np.frombuffer(self.map, kind, int(size) // np.dtype(kind).itemsize, at))
            at += int(size) + (-int(size)) % 8
        (self.root,), self.key, self.target, self.output, self.ends, self.ids, self.final = arrays

    @classmethod
    def open(cls, path: str) -> Transducer:
        with Path(path).open("rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for words that are not accepted. All words take a step at a time."""
        found: list[list[int] | None] = [None] * len(words)
        if not words or not len(self.key):
            return found
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        who = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
        state, number = np.full(len(who), self.root), np.zeros(len(who), np.int64)
        step = 0
        while len(who):
            over = sizes[who] == step
            for k, s, n in zip(who[over], state[over], number[over], strict=True):
                if self.final[s]:
                    found[k] = self.ids[self.ends[n] : self.ends[n + 1]].tolist()
            who, state, number = who[~over], state[~over], number[~over]
            want = state << 8 | raw[starts[who] + step]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[arc] == want
            who, arc = who[ok], arc[ok]
            state, number = self.target[arc], number[ok] + self.output[arc]
            step += 1
        return found


class Codec:
    """Encodes whole texts and decodes ids; keeps what it has worked out for words it met."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        self.vocabulary, self.transducer = vocabulary, transducer
        self.known: dict[str, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")

    def _ids_of(self, words: set[str]) -> dict[str, list[int]]:
        found = dict(zip(words, self.transducer.lookup([w.encode() for w in words]), strict=True))
        unseen = [w for w, ids in found.items() if ids is None]
        return found | dict(zip(unseen, self.vocabulary.merge_all(unseen), strict=True))

    def _words(self, piece: str) -> list:
        """Words, and ids of special tokens, of a piece (a text without ASCII blanks)."""
        out, at = [], 0
        for m in self.special.finditer(piece):
            out += [*self.vocabulary.words(piece[at : m.start()]), self.vocabulary.special[m[0]]]
            at = m.end()
        return out + self.vocabulary.words(piece[at:])

    def learn(self, new: list[str]) -> None:
        """Work out the ids of units that are not known, as bytes."""
        letters, plain = self.vocabulary.letters, [u for u in new if u[0] != ODD]
        odd = {u: self._words(u[1:]) for u in new if u[0] == ODD}
        words = list(map(letters, plain))
        ids = self._ids_of({*words, *(w for ws in odd.values() for w in ws if isinstance(w, str))})
        made = [ids[w] for w in words] + [[k for w in ws for k in ([w] if isinstance(w, int) else ids[w])] for ws in odd.values()]
        flat = np.array([k for m in made for k in m], np.uint32).tobytes()
        at = 0
        for unit, m in zip([*plain, *odd], made, strict=True):
            self.known[unit] = flat[at : at + 4 * len(m)]
            at += 4 * len(m)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        special = list(self.vocabulary.special)
        split = [units(t, special) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        self.learn(list(set().union(*split).difference(self.known)))
        known = self.known
        return [np.frombuffer(b"".join([known[u] for u in us]), np.uint32).tolist() for us in split]

    def decode(self, ids: Iterable[int]) -> str:
        """As a tokenizer without a decoder does: the tokens with blanks between."""
        tokens = self.vocabulary.tokens
        return " ".join([tokens[k] for k in ids])


def count_words(docs: DataFrame, special: list[str], text_column: str = "text") -> DataFrame:
    """(word, n) over all documents; tasks pass on partial counts, so that one hot word is a few rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen.keys()), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(units(text, special))
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        yield out()

    rows = map_batches(docs.select(text_column), count, "word string, n long")
    return rows.where(f"octet_length(word) <= {LONGEST}").groupBy("word").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, vocabulary: Vocabulary, words: int = LEXICON_WORDS, text_column: str = "text") -> bytes:
    """Compile the most frequent words of the corpus; the driver gets `words` rows at most."""
    top = count_words(docs, list(vocabulary.special), text_column).orderBy(F.desc("n"), "word").limit(words).toArrow()
    plain = [vocabulary.letters(w) for w in top.column("word").to_pylist() if w[0] != ODD]
    return compile_transducer({w.encode(): ids for w, ids in zip(plain, vocabulary.merge_all(plain), strict=True) if len(w.encode()) <= LONGEST})


def encode_documents(docs: DataFrame, vocabulary_path: str, compiled: bytes | None = None, text_column: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string."""
    return _run(docs, vocabulary_path, compiled, text_column, "ids array<int>, decoded string", lambda ids, text: (ids, text))


def tokenize_documents(docs: DataFrame, vocabulary_path: str, compiled: bytes | None = None, text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, and the digests of digest_documents."""
    digest = _digest(vocabulary_path)
    return _run(docs, vocabulary_path, compiled, text_column, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids), np.array(ids, np.int32), *digest(ids, text)[1:]))


def digest_documents(docs: DataFrame, vocabulary_path: str, compiled: bytes | None = None, text_column: str = "text") -> DataFrame:
    """doc_id and the digests of what encode_documents gives, taken where the ids are made."""
    return _run(docs, vocabulary_path, compiled, text_column, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest(vocabulary_path))


def _digest(vocabulary_path: str):
    decimal = [str(k) for k in range(len(Vocabulary.load(vocabulary_path).tokens))]

    def digest(ids: list[int], text: str) -> tuple:
        return len(ids), sha256(" ".join([decimal[k] for k in ids]).encode()).hexdigest(), sha256(text.encode()).hexdigest()

    return digest


#: Codecs of this worker by the name of their file; they outlive a task.
_CODECS: dict[str, Codec] = {}


def share(spark: SparkSession, compiled: bytes) -> str:
    """Hand the compiled file to all executors, which fetch it once each; its name there."""
    path = shared_path(spark, "lexicon")
    write_blobs(spark.createDataFrame([(bytearray(compiled + b"\0"),)], "value binary").coalesce(1), path)
    (file,) = read_blobs(spark, path).select("path").collect()  # one file
    spark.sparkContext.addFile(file[0])
    return file[0].rsplit("/", 1)[1]


def _codec(vocabulary: Vocabulary, name: str) -> Codec:
    if name not in _CODECS:
        _CODECS.clear()  # a worker serves one lexicon at a time
        _CODECS[name] = Codec(vocabulary, Transducer.open(SparkFiles.get(name)))
    return _CODECS[name]


def _run(docs: DataFrame, vocabulary_path: str, compiled: bytes | None, text_column: str, columns: str, result) -> DataFrame:
    spark = tune(docs.sparkSession)
    vocabulary = Vocabulary.load(vocabulary_path)
    if compiled is None:
        compiled = build(docs, vocabulary, text_column=text_column)
    shared, name = spark.sparkContext.broadcast(vocabulary), share(spark, compiled)  # bounded by the vocabulary file and LEXICON_WORDS
    schema = "doc_id long, " + columns
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        codec = _codec(shared.value, name)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = [result(ids, codec.decode(ids)) for ids in codec.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), kinds.get(n, pa.string())) for n, c in zip(names, zip(*made, strict=True), strict=True))], ["doc_id", *names])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_column), encode, schema)
