"""Ranks, fusion, reranking and evaluation against small tables worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, dense, evaluate, fusion, mining, passages, rank, rerank


def ranking(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, doc_id long, rank int")


def order(df, column="rank"):
    return [r.doc_id for r in df.orderBy("query_id", column).collect()]


@pytest.fixture(scope="module")
def lists(spark):
    a = ranking(spark, *[(1, d, k) for k, d in enumerate((10, 11, 12, 13, 14), 1)])
    b = ranking(spark, *[(1, d, k) for k, d in enumerate((20, 12, 21, 22, 23), 1)])
    return {"a": a, "b": b}


def test_rrf_sums_and_breaks_ties_by_the_first_list(lists):
    rows = fusion.rrf(lists).orderBy("rank").collect()
    assert [r.doc_id for r in rows][:3] == [12, 10, 20]
    assert abs(rows[0].score - round(1 / 63 + 1 / 62, 9)) < 1e-12


def test_default_ranks(lists):
    zero = {n: r.withColumn("rank", F.col("rank") - 1) for n, r in lists.items()}
    rows = {r.doc_id: r.score for r in fusion.rrf_with_defaults({"a": (zero["a"], 0.8, 1000), "b": (zero["b"], 1.2, 500)}).collect()}
    assert abs(rows[10] - round(0.8 / 60 + 1.2 / 560, 9)) < 1e-12


def test_union_keeps_the_first_lists_order(lists):
    assert order(fusion.union(lists)) == [10, 11, 12, 13, 14, 20, 21, 22, 23]
    assert order(fusion.union(lists, 6)) == [10, 11, 12, 13, 14, 20]


def test_tail_overtakes_only_when_interleaved(spark):
    rows = ranking(spark, *[(1, d, d) for d in range(1, 5)]).withColumn("score", 1.0 / F.col("rank")).withColumn("judged", F.col("doc_id").cast("double"))
    tiered = order(fusion.head_and_tail(rows, 2, "judged"), "final_rank")
    mixed = order(fusion.head_and_tail(rows, 2, "judged", "interleave"), "final_rank")
    assert set(tiered[:2]) == {1, 2} and mixed[0] == 3


def test_flat_scores_scale_to_zero(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.0)], "g long, s double")
    assert {r[0] for r in rows.select(rank.min_max(F.col("s"), "g")).collect()} == {0.0}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, "bird fish cat"), (4, ""), (5, "whale"), (6, "dog dog")], "doc_id long, text string")
    tokens = bm25.tokenised(docs, bm25.full_tokens(F.col("text")))
    terms = spark.createDataFrame([(1, "cat"), (1, "cat"), (1, "absent")], "query_id long, term string")
    got = {r.doc_id: r.score for r in bm25.score(tokens, terms).collect()}
    avgdl = (3 + 1 + 3 + 0 + 1 + 2) / 6
    idf = math.log(1 + (6 - 2 + 0.5) / 2.5)
    assert got == {1: round(idf * 2 / (2 + 1.5 * (0.25 + 0.75 * 3 / avgdl)), 6), 3: round(idf / (1 + 1.5 * (0.25 + 0.75 * 3 / avgdl)), 6)}
    assert bm25.score(tokens.limit(0), terms).count() == 0


def test_full_text_prefers_more_and_closer_terms(spark):
    docs = spark.createDataFrame([(1, "red apples grow"), (2, "red of of of walls and then far away apple"), (3, "green")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red apple")], "query_id long, text string")
    rows = bm25.full_text(docs, asked).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [1, 2] and all(0 < r.score < 1 for r in rows)


def test_dense_top_k_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8)).astype("float32")
    v[7] = v[3]  # a tie
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "doc_id long, vector array<float>")
    asked = rows.where("doc_id < 3").withColumnRenamed("doc_id", "query_id")
    got = dense.top_k(rows, asked, 5).orderBy("query_id", "rank").collect()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for q in range(3):
        s = np.round(u @ u[q], 9)
        want = sorted(range(60), key=lambda i: (-s[i], i))[:5]
        assert [r.doc_id for r in got if r.query_id == q] == want
    assert dense.top_k(rows, asked.limit(0), 5).count() == 0


def test_nearest_rank_is_not_interpolated(spark):
    ranks = spark.createDataFrame([(i, b) for i, b in enumerate((1, 2, 3, 4, None))], "query_id long, best int")
    row = evaluate.rank_summary(ranks).first()
    assert (row.n_hit, row.mean_rank, row.p50_rank, row.p95_rank) == (4, 2.5, 3, 4)


def test_hit_rates_grow_with_k(spark):
    ranks = spark.createDataFrame([(i, b) for i, b in enumerate((1, 7, 30, None))], "query_id long, best int")
    rates = [r.hit_rate_pct for r in evaluate.hit_rates(ranks).orderBy("k").collect()]
    assert rates == sorted(rates) and rates[0] == 25.0 and rates[-1] == 75.0


def test_recall_without_gold_is_one(spark):
    rows = evaluate.recall_table(ranking(spark, (1, 5, 1)), ranking(spark, (1, 5, 0), (1, 6, 0)).select("query_id", "doc_id"), spark.createDataFrame([(1,), (2,)], "query_id long"))
    got = {r[0]: r[1] for r in rows.select("query_id", evaluate.recall(F.col("found_10"), F.col("expected"))).collect()}
    assert got == {1: 0.5, 2: 1.0}


def test_parse_drops_repeats_and_strangers(spark):
    reply = F.lit("Sure: [3, 1, 99, 3, x, 0.0] and [2]")
    assert spark.range(1).select(rerank.parsed_indices(F.lit("[3, 1, 99, 3, 0.0] and [2]"), F.lit(5))).first()[0] == [3, 1, 0]
    assert spark.range(1).select(rerank.parsed_indices(reply, F.lit(5))).first()[0] == [2]
    assert spark.range(1).select(rerank.parsed_indices(F.lit("none"), F.lit(5))).first()[0] == []


def test_cascade_appends_the_rest(spark):
    rows = ranking(spark, *[(1, d, d) for d in range(1, 7)])
    judged = spark.createDataFrame([(1, 3, 9.0), (1, 2, 8.0), (1, 1, 1.0)], "query_id long, doc_id long, judged double")
    assert order(rerank.cascade(rows, [(4, 2, judged)])) == [3, 2, 1, 4, 5, 6]


def test_mmr_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((12, 4))
    score = np.sort(rng.random(12))[::-1]
    rows = spark.createDataFrame([(1, i, float(score[i]), i + 1) for i in range(12)], "query_id long, doc_id long, score double, rank int")
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in range(11)], "doc_id long, vector array<double>")  # one candidate has no vector
    got = order(rerank.mmr(rows, vectors, take=6))
    s = (score[:11] - score[:11].min()) / (score[:11].max() - score[:11].min() + 1e-9)
    sims, near, left, want = v[:11] @ v[:11].T, np.zeros(11), list(range(11)), []
    for _ in range(6):
        best = max(left, key=lambda i: (0.5 * s[i] - 0.5 * near[i], -i))
        want.append(best)
        left.remove(best)
        near = np.maximum(near, sims[best])
    assert got == want


def test_pareto_keeps_strict_improvements(spark):
    rows = spark.createDataFrame([(100.0, 10), (200.0, 10), (300.0, 12), (400.0, 11), (400.0, 13)], "size double, hits int")
    got = {(r["size"], r.hits): r.is_optimal for r in rank.pareto(rows, "size", "hits").collect()}
    assert got == {(100.0, 10): True, (200.0, 10): False, (300.0, 12): True, (400.0, 13): True, (400.0, 11): False}


def test_page_clamps_and_counts(spark):
    rows = ranking(spark, *[(1, d, d) for d in range(1, 8)])
    got = rank.page(rows, "query_id", 5, 500).collect()
    assert [r.doc_id for r in got] == [6, 7] and all(r.exhausted and r.remaining == 0 for r in got)


def test_passages(spark):
    docs = spark.createDataFrame([(1, 'x "one two three four five six seven eight" y'), (2, "one two three"), (3, "one two three four five six sevEn eight")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "two three"), (3, None)], "query_id long, text string")
    assert {tuple(r) for r in passages.holding(docs, asked).collect()} == {(1, 1), (2, 1), (2, 2), (2, 3)}


def test_split_is_reproducible_and_small(spark):
    rows = mining.split(spark.range(2000).withColumnRenamed("id", "doc_id"), "doc_id", 42)
    n = rows.where("part = 'validation'").count()
    assert 5 <= n <= 40 and n == mining.split(spark.range(2000).withColumnRenamed("id", "doc_id"), "doc_id", 42).where("part = 'validation'").count()


def test_sample_is_bounded_per_group(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("g"), "id")
    assert {r["count"] for r in rank.sampled(rows, "g", "id", 5, 1).groupBy("g").count().collect()} == {5}


def test_ranks_of_goals_are_counted_with_ties(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [2.0, 0.0])], "doc_id long, vector array<double>")
    goals = spark.createDataFrame([(10, [1.0, 0.0], 2, 1.0), (11, [0.0, 3.0], 3, 1.0), (12, [1.0, 0.0], 3, 0.0)], "query_id long, vector array<double>, doc_id long, bar double")
    got = dense.at_or_above(vectors, goals).groupBy("query_id").agg(F.sum("n").alias("n")).collect()
    assert {r.query_id: r.n for r in got} == {10: 2, 11: 1, 12: 4}
    assert dense.at_or_above(vectors, goals.limit(0)).count() == 0


def test_a_table_over_the_bound_is_not_broadcast(spark, monkeypatch):
    centres = spark.createDataFrame([(0, [0.0]), (1, [5.0]), (2, [9.0])], "cluster int, centre array<double>")
    rows = spark.createDataFrame([(1, [1.0]), (2, [8.0])], "doc_id long, vector array<double>")
    plan = lambda: dense.few(centres)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan() or "broadcast" in plan().lower()
    monkeypatch.setattr(dense, "FEW", 2)
    assert "broadcast" not in plan().lower()
    assert {r.doc_id: r.cluster for r in dense.nearest(rows, centres).collect()} == {1: 0, 2: 2}
