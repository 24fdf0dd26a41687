"""Archives, search, near copies, the language model and the pipeline against brute force, with the odd cases."""

import gzip
import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import archives, components, decontaminate, hmm, language, maxscore, nearcopies, quality, simhash, trie
from lodestone.llm.common import table
from lodestone.llm.queries import oracle_sql, queries, vocabulary_path

SMALL = "/root/testdata/sf0.001"


# ---- archives

def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "refers_to": F.lit(5), "payload": F.lit(0)})


BIG = "é" * 600


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    rows = [(1, "http://a/ b", BIG), (2, "http://a/2", BIG), (9, None, BIG), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", "WARC/1.1\r\n\r\n\x00" * 90), (None, "u", BIG)]
    got = {r.page_id: r for r in archives.round_trip(pages(spark, *rows, rows[2]), version).collect()}
    assert archives.round_trip(pages(spark, *rows, rows[2]), version).count() == 10
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(got[k].record_type, got[k].refers_to) for k in (1, 2, 9, 5, 6)] == [("revisit", 9), ("revisit", 9), ("response", None), ("response", None), ("response", None)]
    assert archives.round_trip(pages(spark, *rows).limit(0), version).count() == 0


def test_arc_records_are_taken_by_declared_length():
    payload = b"x\nhttp://fake 1.1.1.1 20200101000000 text/html 3\nabc"
    for version in (1, 2):
        content = archives.write_arc([(1, "http://a/ é", payload), (2, None, b"")], version)
        for raw in (content, gzip.compress(content)):
            records = list(archives.read_arc(raw))
            assert [r.http[1] for r in records] == [payload, b""] and records[0].version == version
            assert records[0].fields["url"] == "http://a/%20%C3%A9" and records[0].fields["date"] == archives.CAPTURED
    with pytest.raises(ValueError, match="shorter"):
        list(archives.read_arc(archives.write_arc([(1, "u", payload)], 1)[:-20]))


def test_arc_files_are_converted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(archives.write_arc([(1, "http://a/1", b"one"), (2, "http://a/2", b"two")], 1))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(archives.write_arc([(3, "http://b/3", b"three")], 2)))
    archives.convert_archives(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    rows = archives.read_archives(spark, f"file://{tmp_path}/out").orderBy("page_id").collect()
    assert [(r.page_id, r.url, r.payload_bytes, r.date) for r in rows] == [(1, "http://a/1", 3, "2026-01-01T00:00:00Z"), (2, "http://a/2", 3, "2026-01-01T00:00:00Z"), (3, "http://b/3", 5, "2026-01-01T00:00:00Z")]
    assert len({r.record_id for r in rows}) == 3
    raw = [h for f in (tmp_path / "out").glob("*.txt") for h, _ in archives.read_warc(f.read_bytes())]
    assert sorted(h["warc-type"] for h in raw) == ["response"] * 3 + ["warcinfo"] * 2 and len({h["warc-record-id"] for h in raw}) == 5


def test_types_are_those_of_the_records():
    block = b"20260101000000\nwww.example.org A 127.0.0.1\n"
    line = b"dns:www.example.org 127.0.0.1 20260102030405 text/dns %d\n" % len(block)
    content = archives.write_arc([(1, "http://a/1", b"one")], 1) + line + block + b"\n"
    made = [next(archives.read_warc(archives.to_warc(arc, n))) for n, arc in enumerate(archives.read_arc(content, info=True))]
    assert [(h["warc-type"], h["content-type"]) for h, _ in made] == [("warcinfo", "application/warc-fields"), ("response", "application/http; msgtype=response"), ("resource", "text/dns")]
    assert made[2][1] == block and made[2][0]["warc-date"] == "2026-01-02T03:04:05Z" and b"ARC version 1" in made[0][1]


def test_no_two_records_share_an_identifier(spark):
    big = "long " * 400_000
    df = pages(spark, *[(1, "u", BIG)] * 3, *[(None, "u", "x")] * 3, (0, "u", BIG), (5, "v", big), (4, "v", big))
    path = archives.shared_path(spark, "warc")
    archives.pages_to_warc(df.select("page_id", "url", F.col("html").cast("binary").alias("payload")), path)
    rows = archives.read_archives(spark, path).collect()
    assert len({r.record_id for r in rows}) == len(rows) == 9
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows if r.page_id in (0, 1, 4, 5)} == {(0, "revisit", 1, 1200), (1, "response", None, 1200), (4, "revisit", 5, 2_000_000), (5, "response", None, 2_000_000)}
    ids = {r.record_id for r in rows if r.page_id in (1, 5)}
    raw = [h for f in Path(path.removeprefix("file:")).glob("*.txt") for h, _ in archives.read_warc(f.read_bytes())]
    assert {h["warc-refers-to"] for h in raw if h["warc-type"] == "revisit"} <= ids


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    made = c.execute(oracle_sql()[name])
    names = [x[0] for x in made.description]
    want = sorted(map(tuple, made.fetchall()), key=repr)
    got = sorted((tuple(r[n] for n in names) for r in queries()[name](spark, SMALL).collect()), key=repr)
    assert got == want and len(got) > 0


# ---- search

def best_of_all(rows, width, k=10):
    """(query_id, rank, vec_id, score) by brute force in Python's integers, over rows that take part."""
    whole = lambda x: math.floor(x * 1024) if abs(x) < 2.0**900 else int(x) * 1024
    own = [(i, [whole(x) for x in v] + [0] * (width - len(v))) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in own if i % 100 == 0}):
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for me, x in own if me == q for i, y in own if i != q)[:k]
        out += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best, 1)]
    return out


def found(df):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in maxscore.top_k(df).collect())


def test_search_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(0, 260)]
    rows[57] = (57, rows[3][1])
    rows += [(400, []), (800, [1.0, 2.0]), (900, [-0.5] * 6), (900, [-0.5] * 6), (900, [9.0] * 6), (901, [3.0] * 6), (901, [3.0] * 6)]
    odd = [(300, None), (500, [1.0, None, 2.0]), (600, [float("nan")] * 6), (700, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "x": F.lit(3), "score": F.lit(2), "label": F.lit(0)})
    assert found(df) == best_of_all(rows, 6)
    assert maxscore.top_k(df.limit(0)).count() == 0
    assert [r.vec_id for r in maxscore.top_k(df.where("vec_id in (0, 1)")).collect()] == [1]
    assert [r.score for r in maxscore.top_k(spark.createDataFrame([(0, []), (1, [])], "vec_id long, embedding array<double>")).collect()] == [0]


def test_vectors_of_any_finite_size_take_part(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [(i, (rng.standard_normal(2) * 10.0 ** rng.integers(-2, 12)).tolist()) for i in range(250)]
    rows += [(1, [300000.0, 1.0]), (1000, [1e14, -1e14]), (1001, [1e14, -1e14 + 1]), (1002, [-1e300, 1.7e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = best_of_all([r for r in rows if r[0] != 1002], 2)
    assert found(df.where("vec_id <> 1002")) == want
    monkeypatch.setattr(maxscore, "WIDE_GROUP", 40)  # several groups of wide rows
    monkeypatch.setattr(maxscore, "LEAST", 30)
    assert found(df.where("vec_id <> 1002")) == want
    assert {r[2] for r in found(df)} >= {1002} and len(found(df)) == len(want)
    floats = spark.createDataFrame([(0, [300000.0, 1.0]), (1, [300000.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert found(floats) == best_of_all([(0, [300000.0, 1.0]), (1, [300000.0, 1.0]), (2, [0.5, 0.5])], 2)


def test_search_over_many_groups_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.integers(-8, 9, (700, 4))
    monkeypatch.setattr(maxscore, "GROUP", 40)
    monkeypatch.setattr(maxscore, "FIRST", 100)
    df = spark.createDataFrame([(i, (x / 1024).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in maxscore.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 700, 100):
        assert got[q] == [(k, int(v[q] @ v[k])) for k in sorted((k for k in range(700) if k != q), key=lambda k: (-int(v[q] @ v[k]), k))[:10]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_maxscore_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, d, scale = int(rng.integers(1, 60)), int(rng.integers(1, 9)), int(rng.integers(1, 40))
    x = rng.integers(-scale, scale + 1, (n, d))
    old, maxscore.SHARD = maxscore.SHARD, int(rng.integers(1, 20))
    try:
        made = list(maxscore.search_group(np.arange(n), x, np.arange(min(n, 4)), x[:4], 5))
    finally:
        maxscore.SHARD = old
    for q, ids, scores in made:
        want = sorted((-int(x[q] @ x[k]), k) for k in range(n) if k != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == want


# ---- near copies

def truth_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def grouped(n, links):
    """Smallest member of each node's group."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash_components(spark):
    rng = np.random.default_rng(6)
    base = " ".join(f"w{k}" for k in rng.integers(0, 900, 800))
    texts = [None, "", " \n", "One", "one", "a b", "A  B", base, base.upper(), base + " x", "x " + base, base + " x y", "é É", "word " * 5000, LONG := "k " * 60_000]
    assert LONG
    texts += [" ".join(f"v{k}" for k in rng.integers(0, 50, 12)) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (None, base), (3, "One")], "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit(1), "node": F.lit("z")})
    rows = simhash.component_table(docs).collect()
    assert len(rows) == len(texts) + 2
    fps = [truth_fingerprint(t) for t in texts]
    want = grouped(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    for r in rows:
        k = 7 if r.doc_id is None else r.doc_id
        assert r.fingerprint == f"{fps[k]:016x}" and r.component_id == want[k]
    assert simhash.component_table(docs.limit(0)).count() == 0
    assert [r.component_id for r in simhash.component_table(docs.where("doc_id is null")).collect()] == [None]


def test_hot_groups_are_dealt_out_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    test_simhash_components(spark)
    test_near_copies_against_brute_force(spark)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_trie_join_finds_all_pairs(seed):
    rng = np.random.default_rng(seed)
    bits, budget = 16, int(rng.integers(0, 4))
    centres = rng.integers(0, 1 << bits, 5)
    fps = np.unique((centres[rng.integers(0, 5, 120)] ^ (1 << rng.integers(0, bits, 120)) ^ (1 << rng.integers(0, bits, 120))).astype(np.uint64))
    old, trie.DIRECT = trie.DIRECT, int(rng.integers(1, 60))
    old_front, trie.FRONTIER = trie.FRONTIER, 64
    try:
        got = {(int(i), int(j)) for a, b in trie.self_join(fps, np.array([0]), np.array([len(fps)]), bits - 1, budget) for i, j in zip(a, b, strict=True)}
    finally:
        trie.DIRECT, trie.FRONTIER = old, old_front
    assert got == {(i, j) for j in range(len(fps)) for i in range(j) if int(fps[i] ^ fps[j]).bit_count() <= budget}


def test_forest_is_minimal_and_spans():
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = 30
        i, j = rng.integers(0, n, 60), rng.integers(0, n, 60)
        w = rng.integers(0, 50, 60)
        keep = trie.forest(n, i, j, w)
        assert grouped(n, zip(i, j, strict=True)) == grouped(n, zip(i[keep], j[keep], strict=True))
        parent, best = list(range(n)), 0
        for a, b, x in sorted(zip(i.tolist(), j.tolist(), w.tolist(), strict=True), key=lambda e: e[2]):
            label = grouped(n, [(p, q) for p, q in enumerate(parent)])
            if label[a] != label[b]:
                parent[label[max(a, b, key=lambda v: label[v])]] = min(label[a], label[b])
                best += x
        assert w[keep].sum() == best


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 130)]
    star = [(5, k) for k in range(200, 260)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (300, 5)], "u long, v long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert all(got[k] == 100 for k in range(100, 131)) and all(got[k] == 5 for k in (5, 300, *range(200, 260))) and len(got) == 31 + 62
    assert components.components(links.limit(0)).count() == 0


def test_near_duplicates_leave_one_of_each_group(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    near = [[w if i != at else "edited" for i, w in enumerate(words)] for at in (50, 200, 350)]
    far = [w if rng.random() > 0.2 else "other" for w in words]
    texts = [" ".join(x) for x in (words, *near, far)] + [" ".join(words)] * 3 + ["", None, "  ", "tiny text", "Tiny  text", LONG := "long " * 50_000]
    assert LONG
    texts += [" ".join(f"z{k}" for k in rng.integers(0, 5000, 60)) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[14])], "doc_id long, text string").withColumns({"cls": F.lit(1), "group": F.lit(2), "_keeper": F.lit(3)})
    kept = nearcopies.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 8, 11, 13, *range(14, 54)]
    assert nearcopies.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(10)
    texts = []
    for _ in range(25):
        base = [f"w{k}" for k in rng.integers(0, 3000, 150)]
        for _ in range(4):
            rate = rng.choice([0.0, 0.005, 0.02, 0.06])
            texts.append(" ".join(w if rng.random() > rate else f"e{rng.integers(0, 999)}" for w in base))
    sets = [set(nearcopies.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.drop_near_duplicates(docs).collect()) == sorted(set(grouped(len(texts), alike)))


def test_copies_that_resemble_one_text_alone_stay_one_group(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(304)]
    texts = [" ".join(words)]
    for c in range(400):
        at = set((np.arange(6) * 49 + 5 + rng.integers(0, 40, 6)).tolist())
        texts.append(" ".join(f"e{c}x{k}" if k in at else w for k, w in enumerate(words)))
    monkeypatch.setattr(nearcopies, "CELL", 64, raising=False)  # several cells
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in nearcopies.drop_near_duplicates(docs).collect()] == [0]


def test_a_dense_group_gives_few_pairs():
    n = 400
    i, j = np.triu_indices(n, 1)
    keep = nearcopies._pick(i, j, np.random.default_rng(0).integers(0, 30, len(i)), n)
    assert len(keep) == n - 1 and set(grouped(n, zip(i[keep].tolist(), j[keep].tolist(), strict=True))) == {0}


# ---- the language model

def test_base_scores_and_exact_likelihood(spark):
    texts = ["the cat sat on the mat", "the dog sat", None, "", "the the the", "Unseen WORDS here", "a " * 5000, "cat dog cat dog"] + [f"the cat {k} sat" for k in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "the cat"), (1, texts[1])], "doc_id long, text string").withColumns({"word": F.lit(1), "row": F.lit(2), "n": F.lit(3), "held_out": F.lit(True), "like": F.lit(0)})
    rows = hmm.score_documents(docs).collect()
    every = [*enumerate(texts), (None, "the cat"), (1, texts[1])]
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in every}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for k, t in every if not held[k] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    by = dict(every)
    assert len(rows) == len(every)
    for r in rows:
        own = tokens(by[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.score < 0
    assert hmm.score_documents(docs.limit(0)).count() == 0


def test_scores_are_those_of_a_forward_recursion_by_hand(spark, monkeypatch):
    """Few frequent words, so that classes of rare words count; the first model, whose numbers can be made again here."""
    monkeypatch.setattr(hmm, "FREQUENT", 4)
    monkeypatch.setattr(hmm, "END", 4 + hmm.CLASSES)
    monkeypatch.setattr(hmm, "SYMBOLS", 5 + hmm.CLASSES)
    texts = ["the cat sat on the mat", "the dog sat", "", "a rare word here", "Unseen WORDS here", "the mat the mat"] + [f"the cat {k} sat" for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    counts = Counter(w for k, t in enumerate(texts) if not held[k] for w in t.lower().encode().split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[:4]
    rare = {w: n for w, n in counts.items() if w not in top}
    symbol = lambda w: top.index(w) if w in top else 4 + zlib.crc32(w[-3:]) % hmm.CLASSES
    first = np.zeros(hmm.SYMBOLS)
    for w, n in counts.items():
        first[symbol(w)] += n
    first[hmm.END] = held.count(False)
    model = hmm._start(first)
    size = Counter()
    for w, n in rare.items():
        size[symbol(w)] += n + 1
    for r in hmm.score_documents(docs, rounds=0).collect():
        words = texts[r.doc_id].lower().encode().split()
        state, want = model.start, 0.0
        for at, (s, chance) in enumerate([*((symbol(w), 1.0 if w in top else (rare.get(w, 0) + 1) / (size[symbol(w)] + 1)) for w in words), (hmm.END, 1.0)]):
            state = (state if at == 0 else state @ model.move) * model.emit[s] * chance
            want += math.log10(state.sum())
            state = state / state.sum()
        assert r.score == pytest.approx(want, rel=1e-9)


def test_long_documents_are_taken_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T)
    docs = [rng.integers(0, 6, n) for n in (3000, 5, 700)]
    whole, likes = hmm.expected(model, docs), hmm.likelihood(model, docs)
    monkeypatch.setattr(hmm, "TOGETHER", 200)
    parts = hmm.expected(model, docs)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True)) and np.allclose(likes, hmm.likelihood(model, docs))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_forward_and_expectations_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    k, s = 3, 6
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T)
    docs = [rng.integers(0, s, int(n)) for n in rng.integers(1, 30, 6)]
    old, hmm.SEGMENT = hmm.SEGMENT, int(rng.integers(1, 9))
    try:
        like, (moves, emissions, total) = hmm.likelihood(model, docs), hmm.expected(model, docs)
    finally:
        hmm.SEGMENT = old
    want_moves, want_emissions = np.zeros((k + 1, k + 1)), np.zeros((s, k))
    for d, got in zip(docs, like, strict=True):
        n = len(d)
        a, b = np.zeros((n, k)), np.ones((n, k))
        a[0] = model.start * model.emit[d[0]]
        for t in range(1, n):
            a[t] = (a[t - 1] @ model.move) * model.emit[d[t]]
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (model.emit[d[t + 1]] * b[t + 1])
        z = a[-1].sum()
        assert got == pytest.approx(math.log(z), rel=1e-9)
        want_moves[k, :k] += a[0] * b[0] / z
        for t in range(n):
            want_emissions[d[t]] += a[t] * b[t] / z
            if t:
                want_moves[:k, :k] += a[t - 1][:, None] * model.move * (model.emit[d[t]] * b[t]) / z
    assert np.allclose(moves, want_moves) and np.allclose(emissions, want_emissions) and total == pytest.approx(like.sum())


def test_training_beats_the_unigram_model_on_held_out_text(spark):
    rows = queries()["op5_hmm"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


# ---- the pipeline

def test_pipeline_against_its_stages_by_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SMALL, "documents")
    left = docs
    model = language.learn(left)
    named = {k: language.infer([t], *model) for k, t in ((r.doc_id, r.text) for r in left.collect())}
    ids = [k for k, (p, s, _) in named.items() if p[0] != "und" and s[0] >= corpus_pipeline.LEAST_SHARE]
    left = left.where(F.col("doc_id").isin(ids))
    q = quality.fit(left, table(spark, SMALL, "labels"))
    rows = [(r.doc_id, r.text) for r in left.collect()]
    scores = q.score([t.encode() for _, t in rows])
    rows = [x for x, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    rows.sort()
    sets = [set(nearcopies.shingle_hashes(t.encode(), 5).tolist()) for _, t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    rows = [rows[k] for k in sorted(set(grouped(len(rows), alike)))]
    index = decontaminate.Index([(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()])
    rows = [(k, t) for k, t in rows if not index.find(t)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    got = {r.doc_id: r["ids"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {k: library.encode(t, add_special_tokens=False).ids for k, t in rows} and len(got) > 100


CLASHING = {"lang_pred": "'und'", "lang_score": "0.0D", "LANG_SET": "1", "quality_score": "1.0D", "_cls": "1", "_hash": "1", "_row": "1", "_leaks": "array(1)", "leaks": "2", "leaks_": "array()", "group": "1", "sketch": "2"}


def clashing(docs):
    return docs.select("*", *[F.expr(v).alias(k) for k, v in CLASHING.items()])


def test_stages_keep_the_columns_and_survive_odd_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = clashing(spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "plain words in a row here", "en", "s", 5), (2, "plain words in a row here", "en", "s", 5), (3, "x " * 40_000, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SMALL)
            assert out.columns == docs.columns, name
            assert out.count() <= rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() == rows.count()


def test_columns_of_clashing_names_change_no_stage(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SMALL, "documents")
    docs = docs.unionByName(spark.createDataFrame([(10**9, "12 34 !?", "en", "s", 8)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        ids = sorted(r[0] for r in stage(spark, docs, SMALL).select("doc_id").collect())
        assert sorted(r[0] for r in stage(spark, clashing(docs), SMALL).select("doc_id").collect()) == ids, name
        assert name != "language_id" or 10**9 not in ids


def test_several_passes_tell_rows_apart(spark, monkeypatch):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    docs, bench = docs.union(docs.limit(20)), table(spark, SMALL, "benchmark")
    rows = lambda: sorted(map(str, decontaminate.find_leaks(docs, bench).collect()))
    want = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 1000)
    assert rows() == want and any("contaminated=True" in r for r in want)
    assert decontaminate.drop_leaks(clashing(docs), bench).columns == clashing(docs).columns


# ---- words of a sketch

@pytest.mark.parametrize(("n", "m", "both"), [(5, 4, 4), (14, 14, 13), (23, 20, 20)])
def test_the_rate_of_differing_bits_is_that_of_drawn_sets(n, m, both):
    rng = np.random.default_rng(n)
    draws = 200_000
    shared, a, b = (rng.binomial(k, 0.5, draws) for k in (both, n - both, m - both))
    seen = ((2 * (shared + a) > n) != (2 * (shared + b) > m)).mean()
    assert seen <= nearcopies.bit_rate(n, 0.8) + 0.005
    assert nearcopies.bit_rate(5, 0.8) == pytest.approx(0.1875)


def test_short_near_copies_are_found(spark):
    rng = np.random.default_rng(21)
    rows = []
    for k in range(600):
        words = [f"a{x}" for x in rng.integers(0, 10**9, int(rng.integers(8, 30)))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]  # one shingle more, at 0.8 or above
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.doc_id % 2 for r in nearcopies.drop_near_duplicates(docs).collect()) <= 2
