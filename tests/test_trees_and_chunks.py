"""Clusters, keywords, trees, sentences, chunks and ingest."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import chunk, cluster, dense, ingest, keywords, tree
from lodestone.plans import catalogue
from lodestone.plans.base import stored


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(42)
    v = rng.normal(0, 0.3, (60, 10))
    v[:20, :5] += 5
    v[20:40, :5] -= 5
    v[40:, 0] += 10
    return spark.createDataFrame([(i, i // 20, x.tolist()) for i, x in enumerate(v)], "doc_id long, cluster int, vector array<double>")


def test_blobs_are_found(blobs):
    got = cluster.split_into(blobs.select("doc_id", "vector"), 3).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.doc_id // 20, set()).add(r.cluster)
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3


def test_few_rows_are_one_cluster(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "doc_id long, vector array<double>")
    assert {r.cluster for r in cluster.split_into(rows, 3).collect()} == {0}
    assert {len(r.vector) for r in cluster.reduced(rows, 32).collect()} == {32}


def test_memberships_sum_to_one_and_thresholds_are_monotone(blobs):
    centres = dense.elementwise(blobs, "cluster", "vector")
    shares = cluster.memberships(blobs, centres).cache()
    sums = [r.s for r in shares.groupBy("doc_id").agg(F.sum("probability").alias("s")).collect()]
    assert np.allclose(sums, 1)
    n = [cluster.secondary(shares, t, 0.1).where("is_secondary").count() for t in (0.0, 0.2, 0.4, 0.9)]
    assert n == sorted(n, reverse=True) and n[-1] == 0


def test_medoid_is_the_member_nearest_to_its_centre(blobs):
    centres = dense.elementwise(blobs, "cluster", "vector")
    rows = blobs.collect()
    for r in cluster.medoids(blobs, centres).collect():
        own = [x for x in rows if x.cluster == r.cluster]
        mean = np.mean([x.vector for x in own], axis=0)
        assert r.doc_id == min(own, key=lambda x: np.linalg.norm(np.array(x.vector) - mean)).doc_id


def test_noise_goes_to_the_nearest_centre(blobs):
    centres = dense.elementwise(blobs, "cluster", "vector")
    noisy = blobs.withColumn("cluster", F.when(F.col("doc_id") == 5, -1).otherwise(F.col("cluster")))
    assert {r.doc_id: r.cluster for r in cluster.noise_to_nearest(noisy, centres).collect()}[5] == 0


def test_every_document_is_in_one_leaf(blobs):
    nodes, members = cluster.build_tree(blobs, stored, leaf_size=8)
    assert members.count() == 60 == members.select("doc_id").distinct().count()
    rows = {r.node_id: r for r in nodes.collect()}
    assert all(r.parent_id is None or r.parent_id in rows for r in rows.values())
    assert all(r.doc_count <= 8 or r.depth == 8 for r in rows.values() if r.is_leaf)


def test_keywords_leave_stop_words_out(spark):
    rows = spark.createDataFrame([(0, "the cats chase the mice and the cats sleep"), (1, "stocks and bonds and stocks"), (2, "12 !! ?"), (3, "")], "group int, text string")
    got = keywords.ctfidf(rows).collect()
    words = {r.term for r in got if r.group == 0}
    assert "cats" in words and not words & {"the", "and"} and "cats chase" in words
    assert {r.group for r in got} == {0, 1, 2}


def test_ctfidf_scores_by_hand(spark):
    rows = spark.createDataFrame([(0, "aa aa bb"), (1, "bb cc")], "group int, text string")
    got = {(r.group, r.term): r.score for r in keywords.ctfidf(rows, 50).collect()}
    assert got[0, "aa"] == round(2 / 5 * np.log(1 + 2 / 2), 9) and got[1, "bb"] == round(1 / 3 * np.log(1 + 2 / 3), 9)


def test_sentences_keep_abbreviations_numbers_and_urls_whole():
    text = "Dr. Smith paid 3.14 dollars to Inc. X yesterday. See https://a.b/c. for details and more words.\n- a bullet point\n- b\n\nLast paragraph here it is."
    parts = [text[a:b] for a, b in chunk.sentences(text)]
    assert parts[0].strip() == "Dr. Smith paid 3.14 dollars to Inc. X yesterday."
    assert any(p.startswith("- a bullet") for p in parts) and any(p.startswith("- b") for p in parts)
    assert parts[-1] == "Last paragraph here it is."


def test_code_blocks_stay_whole():
    text = "Before the code there is text. ```\nx = 1. y = 2.\n\n z. \n``` After the code there is more."
    assert any("x = 1. y = 2." in text[a:b] and "z." in text[a:b] for a, b in chunk.sentences(text))


def test_short_sentences_join_the_next_and_long_ones_are_cut():
    assert chunk.sentences("Hi. This is a longer sentence here.") == [(0, 35)]
    assert max(b - a for a, b in chunk.sentences("x" * 5000)) <= 2000
    cut = chunk.sentences("word " * 1000)
    assert all(b - a <= 2200 for a, b in cut)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab. !?\n-1`\t")), max_size=400))
def test_sentences_cover_the_text(text):
    parts = chunk.sentences(text)
    assert "".join(text[a:b] for a, b in parts) == text
    assert all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 99))
def test_chunks_nest_and_cover(n, seed):
    rng = np.random.default_rng(seed)
    text = " ".join(f"w{k % 7}{'.' if rng.random() < 0.1 else ''}" for k in rng.integers(0, 50, n))
    for made in (chunk.token_chunks(text), chunk.semantic_chunks(text)):
        if not text:
            assert made == []
            continue
        assert made[0][:3] == (0, 0, len(text))
        for level in {m[0] for m in made}:
            for _, a, b, _ in (m for m in made if m[0] == level and level):
                assert any(x <= a and b <= y for l, x, y, _ in made if l == level - 1)


def test_valleys_are_spaced_and_deep():
    sims = np.array([1.0, 0.2, 0.9, 0.3, 1.0, 0.95, 1.0])
    assert chunk.valleys(sims, 2, 1) == [1, 3] and chunk.valleys(sims, 2, 3) == [1] and chunk.valleys(sims[:2], 1, 1) == []


def test_chunk_graph_links(spark):
    text = " ".join(f"Sentence number {k} has these words in it." for k in range(200))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    graph = chunk.chunk_graph(stored(chunk.chunk_table(docs), "chunks"), docs).collect()
    by = {r.node_id: r for r in graph}
    assert len(by) == len(graph) > 3
    for r in graph:
        assert (r.parent_id is None) == (r.level == 0)
        if r.next_sibling:
            assert by[r.next_sibling].start == r.end and by[r.next_sibling].parent_id == r.parent_id
        if r.first_child:
            assert by[r.first_child].start == r.start


def test_paths_to_the_root(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("a", "r", 1), ("b", "a", 2)], "node_id string, parent_id string, depth int")
    assert {r.node_id: r.path for r in tree.paths(nodes, nodes.select("node_id"), 4).collect()} == {"r": "r", "a": "r/a", "b": "r/a/b"}


def test_ingest_finds_duplicates_within_the_batch(spark):
    store = spark.createDataFrame([("a", "old", [1.0]), ("z", "same", [2.0])], "id string, text string, embedding array<double>")
    batch = spark.createDataFrame([("a", "new", 1), ("b", "x", 2), ("c", "x", 3), ("d", "same", 4)], "id string, text string, seq long")
    done = ingest.classified(batch, store)
    assert {r.id: r.action for r in done.collect()} == {"a": "update", "b": "insert", "c": "duplicate", "d": "duplicate"}
    assert ingest.counts(done).first().asDict() == {"inserted": 1, "updated": 1, "duplicates": 2}
    after = {r.id: r.embedding for r in ingest.merged(batch, store).collect()}
    assert after == {"a": None, "b": None, "z": [2.0]}


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "x")], "seq long, text string")
    assert sorted(r.seq for r in ingest.deduplicated(rows, "seq").collect()) == [1, 2]


def test_a_failed_job_stays_failed(spark):
    rows = spark.createDataFrame([("j", 1, "pending", 0, None), ("j", 2, "failed", 3, "boom"), ("j", 3, "processing", 4, None), ("k", 1, "completed", 5, None)], "job_id string, seq long, status string, processed long, message string")
    got = {r.job_id: (r.status, r.message) for r in ingest.job_states(rows).collect()}
    assert got == {"j": ("failed", "boom"), "k": ("completed", None)}


def test_whole_turns_are_masked_and_keep_their_keys(spark, tmp_path):
    word = "It. Is\n\n1. one? "
    texts = {(1, 0): word * 100, (0, 1000): word, (1, 2): word * 300, (2, 0): "", (2, 1): "a `b` c"}
    spark.createDataFrame([(*k, t) for k, t in texts.items()], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = catalogue.queries()["CH3_masked_code"](spark, str(tmp_path)).collect()
    want = {}
    for k, t in texts.items():
        block = "```" + t.replace("`", "") + "```"
        whole = f"Before it. {block} After it."
        flat, blocks = chunk._masked(whole)
        assert blocks == [(11, 11 + len(block))] and flat == f"Before it. {'x' * len(block)} After it."
        want[k] = len({n for n, (a, b) in enumerate(chunk.sentences(whole)) for at in range(*blocks[0]) if a <= at < b})
    assert sorted((r.conv_id, r.turn, r.pieces) for r in rows) == sorted((*k, n) for k, n in want.items())
    assert want[1, 0] == want[0, 1000] == 1 < want[1, 2]


@pytest.mark.parametrize("filler", ["word ", "line one\nline two\n", "x"])
def test_turns_that_a_sentence_can_hold_are_one_piece(spark, tmp_path, filler):
    most = chunk.LONG + chunk.AHEAD - 6  # the fences are six characters
    sizes = {**dict(enumerate((1000, 1983, 1984, 1985, 1993, 1994, 1995, 2029, most))), 100: most + 1, 101: 3 * most}
    spark.createDataFrame([(1, k, (filler * n)[:n]) for k, n in sizes.items()], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.pieces for r in catalogue.queries()["CH3_masked_code"](spark, str(tmp_path)).collect()}
    assert got.keys() == sizes.keys()
    assert all((n == 1) == (k < 100) for k, n in got.items())


def test_code_is_cut_only_if_no_sentence_can_hold_it():
    rng = np.random.default_rng(5)
    fill = lambda n: "".join(rng.choice(["word ", "one\n", "xxxxx", "a b. C ", "\n\n"], n // 2))[:n]
    whole = 0
    for _ in range(300):
        text = ""
        for n in rng.integers(0, 3000, 4).tolist():
            around = [("```", "```"), ("<!--", "-->"), ("", "")][rng.integers(3)]
            text += around[0] + fill(n) + around[1] + "".join(rng.choice(["y", "z "], int(rng.integers(1, 1500))))
        parts = chunk.sentences(text)
        assert "".join(text[a:b] for a, b in parts) == text
        assert all(a < b <= a + chunk.LONG + chunk.AHEAD for a, b in parts)
        for x, y in chunk._masked(text)[1]:
            if y - x <= chunk.LONG + chunk.AHEAD:
                whole += 1
                assert any(a <= x and y <= b for a, b in parts)
    assert whole > 100
