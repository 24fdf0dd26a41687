"""Retrieval, fusion, reranking and evaluation (RT, and the AG, WN and ST that work on ranked lists).

Two sets of questions: the benchmark's passages, whose gold are the documents
that hold them; and every hundredth vector, whose text query is its document's
title and whose gold are the other vectors with its label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import bm25, dense, evaluate, fusion, maxsim, mining, models, passages, rank, rerank
from lodestone.plans.base import fingerprint, query, rounded, shared_path, stored, table
from lodestone.plans.scalars import STOPS, TERMS_SQL

DEPTH = 100


# ---- what many queries start from

def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold(spark: SparkSession, d: str) -> DataFrame:
    return passages.holding(table(spark, d, "documents"), items(spark, d))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return bm25.tokenised(table(spark, d, "documents"), bm25.full_tokens(F.col("text")))


#: Stored indexes of this process by application and corpus.
_INDEXES: dict[tuple[str, str], bm25.Index] = {}


def index(spark: SparkSession, d: str) -> bm25.Index:
    """The corpus's stored index: built by the first query, read by all others as long as the files are the same."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, f"{d}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = bm25.Index.build(tokens(spark, d), shared_path(spark, "index"))
    return _INDEXES[key]


def item_terms(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("query_id", F.explode(bm25.full_tokens(F.col("text"))).alias("term"))


def item_ranking(spark: SparkSession, d: str, k: int = DEPTH, method: str = "lucene") -> DataFrame:
    return rank.top_k(bm25.score(index(spark, d), item_terms(spark, d), method=method), "query_id", "score", "doc_id", k)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector as a question: query_id, vector, label."""
    return vectors(spark, d).where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


def titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), tx.title(F.col("text"), F.col("source")).alias("text"))
    return docs.join(asked(spark, d).select("query_id"), "query_id", "left_semi")


def dense_list(spark: SparkSession, d: str, k: int = DEPTH) -> DataFrame:
    return dense.top_k(vectors(spark, d), asked(spark, d), k)


def text_list(spark: SparkSession, d: str, k: int = DEPTH) -> DataFrame:
    terms = titles(spark, d).select("query_id", F.explode(bm25.full_tokens(F.col("text"))).alias("term"))
    return rank.top_k(bm25.score(index(spark, d), terms), "query_id", "score", "doc_id", k)


def label_gold(spark: SparkSession, d: str) -> DataFrame:
    pairs = asked(spark, d).select("query_id", "label").join(vectors(spark, d).select("doc_id", "label"), "label")
    return pairs.where("query_id <> doc_id").select("query_id", "doc_id")


def lists(spark: SparkSession, d: str, k: int = DEPTH) -> dict[str, DataFrame]:
    return {"dense": stored(dense_list(spark, d, k), "dense"), "text": stored(text_list(spark, d, k), "text")}


# ---- the same in SQL

DT = rf"dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOPS})) AS tokens FROM documents), dl AS (SELECT doc_id, len(tokens) AS dl FROM dt), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"


def _terms(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOPS}))"


LUCENE = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"


def _bm(queries: str, value: str = LUCENE, name: str = "bm", k: int = DEPTH) -> str:
    """CTEs from `queries` (query_id, text) to `name` (query_id, doc_id, score, rank)."""
    return f"""{DT}, {name}q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({_terms('text')}) AS term FROM ({queries}))),
tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM dt) WHERE term IN (SELECT term FROM {name}q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
{name}s AS (SELECT query_id, doc_id, round(sum({value}), 6) AS score FROM {name}q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {name}s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k})"""


ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
TITLES = "SELECT doc_id AS query_id, CASE WHEN trim(substr(split_part(text, chr(10), 1), 1, 100)) = '' THEN source ELSE substr(split_part(text, chr(10), 1), 1, 100) END AS text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)"
GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
VEC = "ve AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v, label, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS s FROM embeddings)"


def _dn(k: int = DEPTH, value: str = "list_dot_product(q.v, c.v) / q.s / c.s") -> str:
    return f"""{VEC}, dns AS (SELECT q.doc_id AS query_id, c.doc_id, round({value}, 9) AS score FROM ve q, ve c WHERE q.doc_id % 100 = 0),
dn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM dns QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k})"""


LGOLD = "lgold AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)"
BOTH = f"{_dn()}, {_bm(TITLES)}"
RRF = """ff AS (SELECT query_id, doc_id, min(dr) AS rank_dense, min(br) AS rank_text FROM (SELECT query_id, doc_id, rank AS dr, NULL AS br FROM dn UNION ALL SELECT query_id, doc_id, NULL, rank FROM bm) GROUP BY ALL),
fs AS (SELECT *, round(coalesce(1.0 / (60 + rank_dense), 0) + coalesce(1.0 / (60 + rank_text), 0), 9) AS score FROM ff),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank_dense NULLS LAST, rank_text NULLS LAST, doc_id) AS INTEGER) AS rank FROM fs)"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(lists(spark, d))


# ---- BM25, full text, dense

@query("RT2_bm25_topk", f"WITH {_bm(ITEMS)} SELECT query_id, doc_id, score, rank FROM bm")
def rt2(spark: SparkSession, d: str) -> DataFrame:
    return item_ranking(spark, d).select("query_id", "doc_id", "score", "rank")


@query(
    "RT2_bm25_hit_rates",
    f"WITH {_bm(ITEMS)}, {GOLD}, b AS (SELECT i.item_id, min(bm.rank) AS best FROM benchmark i LEFT JOIN gold g ON g.query_id = i.item_id LEFT JOIN bm ON bm.query_id = i.item_id AND bm.doc_id = g.doc_id GROUP BY ALL) SELECT CAST(k AS INTEGER) AS k, count(CASE WHEN best <= k THEN 1 END) AS hits, count(*) AS n, round(100.0::DOUBLE * count(CASE WHEN best <= k THEN 1 END) / count(*), 3) AS hit_rate_pct FROM b, (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k) GROUP BY k",
)
def rt2_hits(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hit_rates(evaluate.gold_ranks(item_ranking(spark, d), gold(spark, d), items(spark, d)))


METHODS_SQL = {
    "robertson": "greatest(0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))",
    "atire": "ln(n / df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))",
    "bm25l": "ln((n + 1) / (df + 0.5)) * 2.5 * (tf / (0.25 + 0.75 * dl / avgdl) + 0.5) / (1.5 + tf / (0.25 + 0.75 * dl / avgdl) + 0.5)",
    "bm25+": "ln((n + 1) / df) * (1 + tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))",
}
for _method, _value in METHODS_SQL.items():

    @query(f"RT2_bm25_{_method.replace('+', 'plus')}", f"WITH {_bm(ITEMS, _value, k=10)} SELECT query_id, doc_id, score, rank FROM bm")
    def rt2_method(spark: SparkSession, d: str, method: str = _method) -> DataFrame:
        return item_ranking(spark, d, 10, method).select("query_id", "doc_id", "score", "rank")


@query("SNK5_stored_postings", f"WITH {DT} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(tokens) AS term FROM dt) GROUP BY term")
def snk5(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


POOL = f"""pt AS (SELECT dn.query_id, dn.doc_id, {{blank}} AS tokens FROM dn JOIN documents USING (doc_id)),
ps AS (SELECT query_id, count(*) AS n, avg(len(tokens)) AS avgdl FROM pt GROUP BY query_id),
pq AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TERMS_SQL}) AS term FROM ({TITLES})) GROUP BY ALL),
pf AS (SELECT query_id, doc_id, dl, term, count(*) AS tf FROM (SELECT query_id, doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM pt) GROUP BY ALL),
pd AS (SELECT query_id, term, count(*) AS df FROM pf GROUP BY ALL),
pb AS (SELECT query_id, doc_id, round(sum(times * greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM pf JOIN pq USING (query_id, term) JOIN pd USING (query_id, term) JOIN ps USING (query_id) GROUP BY ALL)""".format(
    blank=r"list_filter(regexp_split_to_array(lower(substr(text, 1, 2000)), '\s+'), lambda t: t <> '')"
)


@query("RT1_pool_bm25", f"WITH {_dn()}, {POOL} SELECT query_id, doc_id, score FROM pb WHERE score > 0")
def rt1(spark: SparkSession, d: str) -> DataFrame:
    terms = titles(spark, d).select("query_id", F.explode(tx.query_terms(F.col("text"))).alias("term"))
    return bm25.pool_score(dense_list(spark, d), table(spark, d, "documents"), terms)


@query(
    "AG2_pool_statistics",
    f"WITH {_dn()}, {POOL} SELECT query_id, term, df, n, round(avgdl, 6) AS avgdl FROM pq JOIN pd USING (query_id, term) JOIN ps USING (query_id)",
)
def ag2(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", tx.blank_tokens(tx.truncated(F.col("text"))).alias("tokens"))
    pool = dense_list(spark, d).select("query_id", "doc_id").join(docs, "doc_id")
    stats = pool.groupBy("query_id").agg(F.count("*").alias("n"), rounded(F.avg(F.size("tokens"))).alias("avgdl"))
    terms = titles(spark, d).select("query_id", F.explode(tx.query_terms(F.col("text"))).alias("term")).distinct()
    df = pool.select("query_id", F.explode(F.array_distinct("tokens")).alias("term")).join(terms, ["query_id", "term"]).groupBy("query_id", "term").agg(F.count("*").alias("df"))
    return df.join(stats, "query_id")


STEM = r"regexp_replace({term}, '([a-z]{{3}})(?:ies|es|s|ing|ed|ly|e)$', '\1')"


@query(
    "RT3_full_text",
    f"""WITH pl AS (SELECT doc_id, unnest(s) AS term, unnest(range(len(s))) AS pos FROM (SELECT doc_id, list_transform({_terms('text')}, lambda t: {STEM.format(term='t')}) AS s FROM documents)),
aq AS (SELECT DISTINCT query_id, {STEM.format(term='term')} AS term FROM (SELECT item_id AS query_id, unnest({TERMS_SQL}) AS term FROM benchmark)),
hi AS (SELECT query_id, doc_id, count(DISTINCT term) * count(*) / sqrt(max(pos) - min(pos) + 1) AS density FROM pl JOIN aq USING (term) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(density / (density + 1), 9) AS score FROM hi)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3000""",
)
def rt3(spark: SparkSession, d: str) -> DataFrame:
    return bm25.full_text(table(spark, d, "documents"), items(spark, d))


@query("RT4_dense_topk", f"WITH {_dn()} SELECT query_id, doc_id, score, rank FROM dn")
def rt4(spark: SparkSession, d: str) -> DataFrame:
    return dense_list(spark, d).select("query_id", "doc_id", "score", "rank")


@query("WN2_inner_product_topk", f"WITH {_dn(20, 'list_dot_product(q.v, c.v)')} SELECT query_id, doc_id, score, rank FROM dn")
def wn2(spark: SparkSession, d: str) -> DataFrame:
    return dense.top_k(vectors(spark, d), asked(spark, d), 20, "inner").select("query_id", "doc_id", "score", "rank")


@query("WN3_l2_topk", f"WITH {_dn(20)} SELECT query_id, doc_id, round(sqrt(greatest(2 - 2 * score, 0)), 6) AS score, rank FROM dn")
def wn3(spark: SparkSession, d: str) -> DataFrame:
    return dense.by_distance(vectors(spark, d), asked(spark, d), 20).select("query_id", "doc_id", "score", "rank")


@query("WN4_partial_topk", "SELECT source, doc_id, n_chars, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def wn4(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 5)


@query("RT5_small_scan", f"WITH {_dn(1000000)} SELECT query_id, doc_id, score FROM dn WHERE rank <= 500")
def rt5(spark: SparkSession, d: str) -> DataFrame:
    return dense.top_k(vectors(spark, d), asked(spark, d), 500).select("query_id", "doc_id", "score")


@query("WN1_rank_map", f"WITH {_dn()} SELECT query_id, doc_id, rank - 1 AS rank0 FROM dn")
def wn1(spark: SparkSession, d: str) -> DataFrame:
    return rank.ranked(dense_list(spark, d).drop("rank"), "query_id", "score", "doc_id", first=0).select("query_id", "doc_id", F.col("rank").alias("rank0"))


@query("WN5_slices", f"WITH {_dn()} SELECT k, query_id, doc_id FROM dn, (SELECT unnest([5, 20, 100]) AS k) WHERE rank <= k")
def wn5(spark: SparkSession, d: str) -> DataFrame:
    return rank.slices(dense_list(spark, d), [5, 20, 100]).select("k", "query_id", "doc_id")


@query("AG1_best_of_variants", f"WITH {VEC} SELECT q.label AS query_id, c.doc_id, round(max(list_dot_product(q.v, c.v) / q.s / c.s), 9) AS score FROM ve q, ve c WHERE q.doc_id % 100 = 0 GROUP BY ALL")
def ag1(spark: SparkSession, d: str) -> DataFrame:
    groups = asked(spark, d).select("query_id", "label")
    n = vectors(spark, d).count()
    found = dense.top_k(vectors(spark, d), asked(spark, d), n).join(groups, "query_id")
    return found.groupBy(F.col("label").alias("query_id"), "doc_id").agg(F.max("score").alias("score"))


# ---- late interaction

TOKV = "tv AS (SELECT vec_id // 5 AS doc_id, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS vs FROM embeddings GROUP BY 1)"
MAXSIM = "list_sum(list_transform(q.vs, lambda a: list_max(list_transform(c.vs, lambda b: list_dot_product(a, b)))))"


def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.expr("vec_id div 5").alias("g"), "vec_id", "embedding")
    return maxsim.token_table(rows, "g", "vec_id", "embedding")


@query("RT6_maxsim", f"WITH {TOKV} SELECT q.doc_id AS query_id, c.doc_id, round({MAXSIM}, 6) AS score FROM tv q JOIN tv c ON q.doc_id % 20 = 0")
def rt6(spark: SparkSession, d: str) -> DataFrame:
    docs = stored(token_vectors(spark, d), "tokens")
    return maxsim.score_all(docs, docs.where("doc_id % 20 = 0"))


@query(
    "RT7_late_interaction_rerank",
    f"WITH {_dn(50)}, {TOKV}, p AS (SELECT DISTINCT query_id // 5 AS query_id, doc_id // 5 AS doc_id FROM dn), s AS (SELECT p.query_id, p.doc_id, round({MAXSIM}, 6) AS score FROM p JOIN tv q ON q.doc_id = p.query_id JOIN tv c ON c.doc_id = p.doc_id) SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s",
)
def rt7(spark: SparkSession, d: str) -> DataFrame:
    """A real candidate list, and for each question an id without vectors, which is dropped."""
    docs = stored(token_vectors(spark, d), "tokens")
    near = dense_list(spark, d, 50).select(F.expr("query_id div 5").alias("query_id"), F.expr("doc_id div 5").alias("doc_id")).distinct()
    return maxsim.rerank(near.unionByName(near.select("query_id", F.lit(-1).cast("long").alias("doc_id")).distinct()), docs, docs)


POOLED = f"""{TOKV}, mp AS (SELECT doc_id, list_transform(range(1, 65), lambda i: list_max(list_transform(vs, lambda v: v[i]))) AS m FROM tv), mn AS (SELECT doc_id, m, sqrt(list_dot_product(m, m)) AS s FROM mp),
qt AS (SELECT doc_id AS query_id, unnest(range(len(vs))) AS i, unnest(vs) AS v FROM tv WHERE doc_id % 20 = 0),
c1 AS (SELECT query_id, i, doc_id, round(list_dot_product(v, m) / s / sqrt(list_dot_product(v, v)), 9) AS score FROM qt, mn),
c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY query_id, i ORDER BY score DESC, doc_id) <= 20),
c4 AS (SELECT query_id, doc_id, max(score) AS score FROM c2 GROUP BY query_id, doc_id), c3 AS (SELECT * FROM c4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20)"""


@query("RT8_pooled_prefilter", f"WITH {POOLED} SELECT c3.query_id, c3.doc_id, round({MAXSIM}, 6) AS score FROM c3 JOIN tv q ON q.doc_id = c3.query_id JOIN tv c ON c.doc_id = c3.doc_id")
def rt8(spark: SparkSession, d: str) -> DataFrame:
    docs = stored(token_vectors(spark, d), "tokens")
    asking = docs.where("doc_id % 20 = 0")
    return maxsim.rerank(maxsim.prefilter(docs, asking, 20), asking, docs).select("query_id", "doc_id", "score")


@query("AG18_max_pool", f"WITH {TOKV}, mp AS (SELECT doc_id, list_transform(range(1, 65), lambda i: list_max(list_transform(vs, lambda v: v[i]))) AS m FROM tv) SELECT doc_id, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS head, round(m[64] / sqrt(list_dot_product(m, m)), 6) AS tail FROM mp")
def ag18(spark: SparkSession, d: str) -> DataFrame:
    return maxsim.pooled(token_vectors(spark, d)).select("doc_id", rounded(F.col("vector")[0]).alias("head"), rounded(F.element_at("vector", -1)).alias("tail"))


@query(
    "RT9_dense_then_maxsim",
    f"WITH {_dn(50)}, {TOKV}, p AS (SELECT DISTINCT query_id // 5 AS query_id, doc_id // 5 AS doc_id FROM dn), s AS (SELECT p.query_id, p.doc_id, round({MAXSIM}, 6) AS score FROM p JOIN tv q ON q.doc_id = p.query_id JOIN tv c ON c.doc_id = p.doc_id) SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10",
)
def rt9(spark: SparkSession, d: str) -> DataFrame:
    docs = stored(token_vectors(spark, d), "tokens")
    near = dense_list(spark, d, 50).select(F.expr("query_id div 5").alias("query_id"), F.expr("doc_id div 5").alias("doc_id")).distinct()
    return maxsim.rerank(near, docs, docs).where("rank <= 10").select("query_id", "doc_id", "score")


@query(
    "RT31_quantisation_drift",
    "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127 AS k FROM v), b AS (SELECT vec_id, label, v, list_transform(v, lambda x: greatest(least(round_even(x / k, 0), 127), -128) * k) AS w FROM s) SELECT q.vec_id AS query_id, round(avg(abs(list_dot_product(q.v, c.w) - list_dot_product(q.v, c.v))), 6) AS mean_drift FROM b q JOIN b c ON q.label = c.label WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id",
)
def rt31(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("scale", vx.quantise_scale(F.col("vector")))
    rows = rows.withColumn("back", vx.dequantised(vx.quantised(F.col("vector"), F.col("scale")), F.col("scale")))
    pairs = asked(spark, d).select("query_id", "label", F.col("vector").alias("q")).join(rows, "label")
    drift = F.abs(vx.dot(F.col("q"), F.col("back")) - vx.dot(F.col("q"), F.col("vector")))
    return pairs.groupBy("query_id").agg(rounded(F.avg(drift)).alias("mean_drift"))


# ---- fusion

@query("RT10_rrf", f"WITH {BOTH}, {RRF} SELECT query_id, doc_id, score, rank FROM fr")
def rt10(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).select("query_id", "doc_id", "score", "rank")


@query(
    "RT11_rrf_with_defaults",
    f"WITH {BOTH}, ff AS (SELECT query_id, doc_id, min(dr) AS a, min(br) AS b FROM (SELECT query_id, doc_id, rank - 1 AS dr, NULL AS br FROM dn UNION ALL SELECT query_id, doc_id, NULL, rank - 1 FROM bm) GROUP BY ALL), s AS (SELECT query_id, doc_id, round(0.8 / (60 + coalesce(a, 1000000)) + 1.2 / (60 + coalesce(b, 500)), 9) AS score FROM ff) SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS INTEGER) AS rank FROM s",
)
def rt11(spark: SparkSession, d: str) -> DataFrame:
    both = {n: r.withColumn("rank", F.col("rank") - 1) for n, r in lists(spark, d).items()}
    return fusion.rrf_with_defaults({"dense": (both["dense"], 0.8, 1_000_000), "text": (both["text"], 1.2, 500)}).select("query_id", "doc_id", "score", "rank")


@query(
    "JN5_rank_maps_outer_join",
    f"WITH {BOTH} SELECT coalesce(dn.query_id, bm.query_id) AS query_id, coalesce(dn.doc_id, bm.doc_id) AS doc_id, CAST(coalesce(dn.rank - 1, 1000000) AS BIGINT) AS dense_rank, CAST(coalesce(bm.rank - 1, 500) AS BIGINT) AS text_rank FROM dn FULL JOIN bm ON dn.query_id = bm.query_id AND dn.doc_id = bm.doc_id",
)
def jn5(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.tagged(lists(spark, d))
    at = lambda name, default: F.coalesce(F.min(F.when(F.col("list") == name, F.col("rank") - 1)), F.lit(default)).cast("long")
    return rows.groupBy("query_id", "doc_id").agg(at("dense", 1_000_000).alias("dense_rank"), at("text", 500).alias("text_rank"))


@query(
    "RT12_rrf_weighted",
    f"WITH {BOTH}, ff AS (SELECT query_id, doc_id, min(dr) AS a, min(br) AS b FROM (SELECT query_id, doc_id, rank AS dr, NULL AS br FROM dn UNION ALL SELECT query_id, doc_id, NULL, rank FROM bm) GROUP BY ALL) SELECT query_id, doc_id, round(coalesce(1.5 / (30 + a), 0) + coalesce(1.0 / (30 + b), 0), 9) AS score FROM ff",
)
def rt12(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(lists(spark, d), 30, {"dense": 1.5, "text": 1.0}, {"dense": 200, "text": 500}).select("query_id", "doc_id", "score")


#: A given judgement of a pair, as a model would supply it.
JUDGED = "CAST((doc_id * 7 + query_id) % 11 AS DOUBLE) / 10"


def judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("judged", ((F.col("doc_id") * 7 + F.col("query_id")) % 11).cast("double") / 10)


BLEND = f"""ju AS (SELECT *, {JUDGED} AS judged FROM fr), he AS (SELECT *, 0.7 * (judged - min(judged) OVER w) / (CASE WHEN max(judged) OVER w = min(judged) OVER w THEN 1 ELSE max(judged) OVER w - min(judged) OVER w END) + 0.3 * (score - min(score) OVER w) / (CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END) AS blend FROM ju WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
ta AS (SELECT *, (score - min(score) OVER w) / (CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END) AS blend FROM ju WHERE rank > 50 WINDOW w AS (PARTITION BY query_id)),
al AS (SELECT query_id, doc_id, rank, round(blend, 9) AS blend, 0 AS tier FROM he UNION ALL SELECT query_id, doc_id, rank, round(blend, 9), 1 FROM ta)"""


@query("RT13_blend", f"WITH {BOTH}, {RRF}, {BLEND} SELECT query_id, doc_id, round(blend, 6) AS blend FROM al WHERE tier = 0")
def rt13(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(fused(spark, d).where("rank <= 50"))
    return fusion.blended(rows, "score", "judged").select("query_id", "doc_id", rounded(F.col("blend")).alias("blend"))


for _mode, _order in (("tiered", "tier, blend DESC, rank"), ("interleave", "blend DESC, rank")):

    @query(f"RT14_final_{_mode}", f"WITH {BOTH}, {RRF}, {BLEND} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_order}) AS INTEGER) AS final_rank FROM al")
    def rt14(spark: SparkSession, d: str, mode: str = _mode) -> DataFrame:
        return fusion.head_and_tail(judged(fused(spark, d)), 50, "judged", mode).select("query_id", "doc_id", "final_rank")


@query("ST1_union", f"WITH {BOTH} SELECT query_id, doc_id FROM dn UNION SELECT query_id, doc_id FROM bm")
def st1(spark: SparkSession, d: str) -> DataFrame:
    both = lists(spark, d)
    return both["dense"].select("query_id", "doc_id").unionByName(both["text"].select("query_id", "doc_id")).distinct()


UNION = "un AS (SELECT query_id, doc_id, min(place * 1000000 + rank) AS pos FROM (SELECT query_id, doc_id, rank, 0 AS place FROM {a} UNION ALL SELECT query_id, doc_id, rank, 1 FROM {b}) GROUP BY ALL), ur AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, doc_id) AS INTEGER) AS rank FROM un)"


@query("ST2_ordered_union", f"WITH {BOTH}, {UNION.format(a='dn', b='bm')} SELECT query_id, doc_id, rank FROM ur")
def st2(spark: SparkSession, d: str) -> DataFrame:
    return fusion.union(lists(spark, d))


@query("ST3_capped_pool", f"WITH {BOTH}, a1 AS (SELECT * FROM dn WHERE rank <= 40), b1 AS (SELECT * FROM bm WHERE rank <= 60), {UNION.format(a='a1', b='b1')} SELECT query_id, doc_id, rank FROM ur WHERE rank <= 70")
def st3(spark: SparkSession, d: str) -> DataFrame:
    return rerank.pool_of(lists(spark, d), {"dense": 40, "text": 60}, 70)


# ---- reranking by models and given judgements

#: Share of a question's distinct words that a text holds, from (query_id, doc_id) of `p`.
OVERLAP = r"""qa AS (SELECT p.query_id, p.doc_id, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda t: t <> '')) AS q, list_distinct(list_filter(regexp_split_to_array(lower({passage}), '\s+'), lambda t: t <> '')) AS t FROM p JOIN benchmark b ON b.item_id = p.query_id JOIN documents d ON d.doc_id = p.doc_id),
qs AS (SELECT query_id, doc_id, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END AS model_score FROM qa)"""


def _overlap(depth: int, passage: str, k: int) -> str:
    return f"""WITH {_bm(ITEMS, k=depth)}, p AS (SELECT query_id, doc_id FROM bm), {OVERLAP.format(passage=passage)}
SELECT query_id, doc_id, model_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY model_score DESC, doc_id) AS INTEGER) AS rank FROM qs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY model_score DESC, doc_id) <= {k}"""


@query("RT15_cross_encoder", _overlap(20, "substr(d.text, 1, 512)", 20))
def rt15(spark: SparkSession, d: str) -> DataFrame:
    pairs = item_ranking(spark, d, 20).join(table(spark, d, "documents").select("doc_id", F.substring("text", 1, 512).alias("passage")), "doc_id")
    pairs = pairs.join(items(spark, d).withColumnRenamed("text", "question"), "query_id").select("query_id", "doc_id", "question", "passage")
    return rank.ranked(models.score_pairs(pairs, "question", "passage"), "query_id", "model_score", "doc_id")


@query("RT16_light_reranker", _overlap(50, "d.text", 10))
def rt16(spark: SparkSession, d: str) -> DataFrame:
    pairs = item_ranking(spark, d, 50).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    pairs = pairs.join(items(spark, d).withColumnRenamed("text", "question"), "query_id").select("query_id", "doc_id", "question", "text")
    return rank.top_k(models.score_pairs(pairs, "question", "text"), "query_id", "model_score", "doc_id", 10)


@query(
    "RT18_leaf_routing",
    "WITH l AS (SELECT q.vec_id AS query_id, c.label AS leaf, round(max(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, leaf) AS r FROM l) SELECT query_id, vec_id AS doc_id, CAST(min(r) AS INTEGER) AS rank FROM r JOIN embeddings e ON e.label = r.leaf WHERE score > 0.5 OR r <= 3 GROUP BY ALL",
)
def rt18(spark: SparkSession, d: str) -> DataFrame:
    members = vectors(spark, d).select(F.col("label").alias("leaf"), "doc_id")
    n = vectors(spark, d).count()
    scores = dense.top_k(vectors(spark, d), asked(spark, d), n, "inner", exclude_self=True).join(members, "doc_id").groupBy("query_id", "leaf").agg(F.round(F.max("score"), 6).alias("score"))
    return rerank.leaf_routing(scores, members, 0.5, 3)


def _with_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return stored(fused(spark, d).select("query_id", "doc_id", "score", "rank"), "fused"), vectors(spark, d).select("doc_id", "vector")


#: A query's fused pool with scores from 0 to 1 and its order.
SCALED = "po AS (SELECT fr.query_id, fr.doc_id, fr.score, ve.v FROM fr JOIN ve USING (doc_id) WHERE rank <= 200), sc AS (SELECT query_id, doc_id, v, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-9) AS s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM po WINDOW w AS (PARTITION BY query_id))"


@query(
    "RT19_mmr_dense",
    f"""WITH RECURSIVE {BOTH}, {RRF}, {SCALED}, le AS (
SELECT query_id, doc_id, v, s, r, 0::DOUBLE AS near, 1 AS step FROM sc
UNION ALL
SELECT query_id, doc_id, v, s, r, greatest(near, list_dot_product(v, picked)), step + 1 FROM (SELECT *, first_value(r) OVER w AS best, first_value(v) OVER w AS picked FROM le WINDOW w AS (PARTITION BY query_id, step ORDER BY round(0.5 * s - 0.5 * near, 9) DESC, r)) WHERE r <> best)
SELECT query_id, doc_id, CAST(step AS BIGINT) AS rank FROM le QUALIFY row_number() OVER (PARTITION BY query_id, step ORDER BY round(0.5 * s - 0.5 * near, 9) DESC, r) = 1""",
)
def rt19(spark: SparkSession, d: str) -> DataFrame:
    return rerank.mmr(*_with_vectors(spark, d))


@query(
    "RT20_mmr_query",
    f"WITH {BOTH}, {RRF}, {SCALED}, va AS (SELECT sc.query_id, sc.doc_id, sc.r, round(0.5 * sc.s - 0.5 * greatest(0, list_dot_product(sc.v, q.v)), 9) AS value FROM sc JOIN ve q ON q.doc_id = sc.query_id) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r = 1 DESC, value DESC, r) AS rank FROM va",
)
def rt20(spark: SparkSession, d: str) -> DataFrame:
    return rerank.mmr(*_with_vectors(spark, d), query_vectors=asked(spark, d))


@query(
    "RT21_away_from_head",
    f"WITH {BOTH}, {RRF}, po AS (SELECT fr.query_id, fr.doc_id, fr.score, fr.rank, ve.v FROM fr JOIN ve USING (doc_id) WHERE rank <= 200), sc AS (SELECT *, (score - min(score) OVER w) / (CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END) AS s, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM po WINDOW w AS (PARTITION BY query_id)), ne AS (SELECT a.query_id, a.doc_id, a.s, max(CASE WHEN a.doc_id = b.doc_id THEN -1.0 ELSE list_dot_product(a.v, b.v) END) AS near FROM sc a JOIN sc b ON a.query_id = b.query_id AND b.r <= 10 GROUP BY ALL) SELECT query_id, doc_id, round(s - 0.5 * near, 6) AS score FROM ne",
)
def rt21(spark: SparkSession, d: str) -> DataFrame:
    return rerank.away_from_head(*_with_vectors(spark, d)).select("query_id", "doc_id", "score")


CENTRES = "ce AS (SELECT label AS cluster, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY ALL) GROUP BY label)"


@query(
    "RT22_cluster_expansion",
    f"WITH {BOTH}, {CENTRES}, sz AS (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY 1), tc AS (SELECT DISTINCT query_id, label AS cluster FROM bm JOIN embeddings ON vec_id = doc_id), co AS (SELECT q.doc_id AS query_id, ce.cluster, round(list_dot_product(q.v, c) / q.s / sqrt(list_dot_product(c, c)), 9) AS cosine FROM ve q, ce WHERE q.doc_id % 100 = 0), cs AS (SELECT co.query_id, co.cluster, round(CASE WHEN cosine < 0.1 THEN 0 ELSE cosine * ln(1 + size) * CASE WHEN tc.cluster IS NULL THEN 1 ELSE 1.5 END END, 6) AS score FROM co JOIN sz USING (cluster) LEFT JOIN tc ON tc.query_id = co.query_id AND tc.cluster = co.cluster), cr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cluster) AS INTEGER) AS cluster_rank FROM cs WHERE score > 0), me AS (SELECT label AS cluster, vec_id AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT query_id, cluster, cluster_rank, doc_id, score FROM cr JOIN me USING (cluster) WHERE r <= 50",
)
def rt22(spark: SparkSession, d: str) -> DataFrame:
    centres = dense.elementwise(table(spark, d, "embeddings"), "label", "embedding").withColumnRenamed("label", "cluster")
    members = vectors(spark, d).select(F.col("label").alias("cluster"), "doc_id")
    found = rerank.cluster_expansion(asked(spark, d), centres, members, text_list(spark, d).select("query_id", "doc_id"))
    return found.withColumn("cluster", F.col("cluster").cast("int"))


@query(
    "RT23_parse_reply",
    "WITH r AS (SELECT conv_id, turn, 'Ranking: [' || CAST(turn AS VARCHAR) || ', ' || CAST(conv_id % 7 AS VARCHAR) || ', 99, ' || CAST(turn AS VARCHAR) || ', 2, 1.0] done [5]' AS reply FROM conversations), v AS (SELECT conv_id, turn, list_filter([turn, conv_id % 7, 99, turn, 2, 1], lambda x: x < 6) AS l FROM r) SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: len(list_filter(list_slice(l, 1, i - 1), lambda y: y = x)) = 0), ',') AS picked FROM v",
)
def rt23(spark: SparkSession, d: str) -> DataFrame:
    turn, conv = F.col("turn").cast("string"), (F.col("conv_id") % 7).cast("string")
    reply = F.concat(F.lit("Ranking: ["), turn, F.lit(", "), conv, F.lit(", 99, "), turn, F.lit(", 2, 1.0] done [5]"))
    picked = rerank.parsed_indices(reply, F.lit(6))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(picked.cast("array<string>"), ",").alias("picked"))


@query(
    "RT24_cascade",
    f"""WITH {_bm(ITEMS)}, a AS (SELECT query_id, doc_id, rank, CASE WHEN rank <= 50 THEN {JUDGED} END AS j FROM bm), a1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC NULLS LAST, rank) AS p FROM a), a2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN j IS NOT NULL AND p <= 20 THEN 0 ELSE 1 END, CASE WHEN j IS NOT NULL AND p <= 20 THEN p ELSE rank END) AS rank FROM a1),
b AS (SELECT query_id, doc_id, rank, CASE WHEN rank <= 20 THEN CAST((doc_id * 3 + query_id) % 5 AS DOUBLE) END AS j FROM a2), b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC NULLS LAST, rank) AS p FROM b) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN j IS NOT NULL AND p <= 10 THEN 0 ELSE 1 END, CASE WHEN j IS NOT NULL AND p <= 10 THEN p ELSE rank END) AS INTEGER) AS rank FROM b1""",
)
def rt24(spark: SparkSession, d: str) -> DataFrame:
    first = stored(item_ranking(spark, d).select("query_id", "doc_id", "rank"), "ranking")
    one = judged(first.select("query_id", "doc_id"))
    two = first.select("query_id", "doc_id", ((F.col("doc_id") * 3 + F.col("query_id")) % 5).cast("double").alias("judged"))
    return rerank.cascade(first, [(50, 20, one), (20, 10, two)])


GRADE = "(doc_id + query_id) % 3"


def graded(spark: SparkSession, d: str) -> DataFrame:
    rows = item_ranking(spark, d).select("query_id", "doc_id", "rank")
    return rows.withColumn("grade", (F.col("doc_id") + F.col("query_id")) % 3).withColumn("again", (F.col("doc_id") * 5 + F.col("query_id")) % 3).withColumn("yes", (F.col("doc_id") + F.col("query_id")) % 4 == 0)


@query("RT25_yes_first", f"WITH {_bm(ITEMS)} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN (doc_id + query_id) % 4 = 0 THEN 0 ELSE 1 END, rank) AS INTEGER) AS new_rank FROM bm")
def rt25(spark: SparkSession, d: str) -> DataFrame:
    return rerank.yes_first(graded(spark, d)).select("query_id", "doc_id", "new_rank")


@query(
    "RT26_three_levels",
    f"WITH {_bm(ITEMS)}, a AS (SELECT query_id, doc_id, rank, {GRADE} AS g, row_number() OVER (PARTITION BY query_id ORDER BY {GRADE} DESC, rank) AS p FROM bm), b AS (SELECT *, CASE WHEN p <= 30 THEN greatest(g, (doc_id * 5 + query_id) % 3) ELSE g END AS h FROM a) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h DESC, rank) AS INTEGER) AS new_rank FROM b",
)
def rt26(spark: SparkSession, d: str) -> DataFrame:
    return rerank.graded(graded(spark, d), "grade", "again", 30).select("query_id", "doc_id", "new_rank")


@query(
    "RT27_chunk_picks",
    f"WITH {_bm(ITEMS)}, a AS (SELECT *, {GRADE} AS g, row_number() OVER (PARTITION BY query_id, (rank - 1) // 10 ORDER BY (doc_id * 5 + query_id) % 3 DESC, rank) AS p FROM bm) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g + CASE WHEN p = 1 THEN 3 ELSE 0 END DESC, rank) AS INTEGER) AS new_rank FROM a",
)
def rt27(spark: SparkSession, d: str) -> DataFrame:
    return rerank.chunk_picks(graded(spark, d), "grade", "again").select("query_id", "doc_id", "new_rank")


@query(
    "RT28_strict_pass",
    f"WITH {_bm(ITEMS)}, a AS (SELECT *, {GRADE} AS g, row_number() OVER (PARTITION BY query_id ORDER BY {GRADE} DESC, rank) AS p FROM bm) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN p <= 20 AND (doc_id + query_id) % 4 = 0 THEN 3 ELSE g END DESC, rank) AS INTEGER) AS new_rank FROM a",
)
def rt28(spark: SparkSession, d: str) -> DataFrame:
    return rerank.strict_pass(graded(spark, d), "grade", "yes").select("query_id", "doc_id", "new_rank")


# ---- mining and exhaustive evaluation

@query(
    "RT29_hard_negatives",
    f"WITH {_dn(1000000)} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM dn WHERE doc_id <> query_id AND doc_id <> query_id + 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 24",
)
def rt29(spark: SparkSession, d: str) -> DataFrame:
    positives = asked(spark, d).select("query_id", (F.col("query_id") + 1).alias("doc_id"))
    return mining.hard_negatives(vectors(spark, d), asked(spark, d), positives, 24).select("query_id", "doc_id", "rank")


@query("RT29_positive_ranks", f"WITH {_dn(1000000)} SELECT query_id, rank FROM dn WHERE doc_id = query_id + 1")
def rt29_ranks(spark: SparkSession, d: str) -> DataFrame:
    positives = asked(spark, d).select("query_id", (F.col("query_id") + 1).alias("doc_id"))
    return mining.positive_ranks(vectors(spark, d), asked(spark, d), positives)


EVAL_KS = (1, 2, 3, 5, 10, 20, 50, 100, 200, 500, 1000, 2000)


@query(
    "RT30_exhaustive_eval",
    f"WITH {_dn(1000000)}, {LGOLD}, b AS (SELECT dn.query_id, min(rank) AS best FROM dn JOIN lgold USING (query_id, doc_id) GROUP BY 1), q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0) SELECT CAST(k AS INTEGER) AS k, count(CASE WHEN best <= k THEN 1 END) AS hits, count(*) AS n, round(100.0::DOUBLE * count(CASE WHEN best <= k THEN 1 END) / count(*), 3) AS hit_rate_pct FROM q LEFT JOIN b USING (query_id), (SELECT unnest({list(EVAL_KS)}) AS k) GROUP BY k",
)
def rt30(spark: SparkSession, d: str) -> DataFrame:
    n = vectors(spark, d).count()
    ranks = evaluate.gold_ranks(dense_list(spark, d, n), label_gold(spark, d), asked(spark, d))
    return evaluate.hit_rates(ranks, EVAL_KS)


# ---- evaluation tables

BEST = f"{_bm(ITEMS)}, {GOLD}, be AS (SELECT i.item_id AS query_id, min(bm.rank) AS best FROM benchmark i LEFT JOIN gold g ON g.query_id = i.item_id LEFT JOIN bm ON bm.query_id = i.item_id AND bm.doc_id = g.doc_id GROUP BY ALL)"


def best_ranks(spark: SparkSession, d: str) -> DataFrame:
    return stored(evaluate.gold_ranks(item_ranking(spark, d), gold(spark, d), items(spark, d)), "ranks")


@query("AG7_rank_summary", f"WITH {BEST}, s AS (SELECT list(best ORDER BY best) AS l FROM be WHERE best IS NOT NULL) SELECT len(l) AS n_hit, round(list_avg(l), 6) AS mean_rank, l[CAST(floor(len(l) * 0.5) AS BIGINT) + 1] AS p50_rank, l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] AS p95_rank FROM s")
def ag7(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rank_summary(best_ranks(spark, d))


RECALLS = f"{_bm(ITEMS)}, {GOLD}, re AS (SELECT i.item_id AS query_id, count(g.doc_id) AS expected, count(bm.rank) AS found_all, count(CASE WHEN bm.rank <= 10 THEN 1 END) AS found_10, count(CASE WHEN bm.rank <= 20 THEN 1 END) AS found_20, count(CASE WHEN bm.rank <= 50 THEN 1 END) AS found_50 FROM benchmark i LEFT JOIN gold g ON g.query_id = i.item_id LEFT JOIN bm ON bm.query_id = i.item_id AND bm.doc_id = g.doc_id GROUP BY ALL)"


def recalls(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_table(item_ranking(spark, d), gold(spark, d), items(spark, d))


@query("JN12_retrieved_gold", f"WITH {RECALLS} SELECT query_id, expected, found_all, found_10, found_20, found_50 FROM re")
def jn12(spark: SparkSession, d: str) -> DataFrame:
    return recalls(spark, d)


@query(
    "AG8_micro_macro_recall",
    f"WITH {RECALLS} SELECT query_id % 4 AS type, count(*) AS n, sum(expected)::BIGINT AS expected, round(sum(found_all) / nullif(sum(expected), 0), 6) AS micro, round(avg(CASE WHEN expected = 0 THEN 1.0 ELSE found_all / expected END), 6) AS macro, round(avg(CASE WHEN expected = 0 THEN 1.0 ELSE found_10 / expected END), 6) AS macro_10 FROM re GROUP BY 1",
)
def ag8(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("expected")
    return recalls(spark, d).groupBy((F.col("query_id") % 4).alias("type")).agg(
        F.count("*").alias("n"), F.sum("expected").alias("expected"), rounded(F.try_divide(F.sum("found_all"), F.sum("expected"))).alias("micro"),
        rounded(F.avg(evaluate.recall(F.col("found_all"), e))).alias("macro"), rounded(F.avg(evaluate.recall(F.col("found_10"), e))).alias("macro_10"),
    )


@query("AG9_mrr", f"WITH {BEST} SELECT query_id % 4 AS type, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr, count(CASE WHEN best <= 10 THEN 1 END) AS hits_10 FROM be GROUP BY 1")
def ag9(spark: SparkSession, d: str) -> DataFrame:
    return best_ranks(spark, d).groupBy((F.col("query_id") % 4).alias("type")).agg(rounded(evaluate.mrr(F.col("best"))).alias("mrr"), F.count_if(F.col("best") <= 10).alias("hits_10"))


@query(
    "AG10_single_source_hits",
    f"WITH {BEST}, s AS (SELECT query_id, min(source) AS source FROM gold JOIN documents USING (doc_id) GROUP BY query_id HAVING count(DISTINCT source) = 1) SELECT source, count(*) AS n, count(CASE WHEN best <= 10 THEN 1 END) AS hits FROM s JOIN be USING (query_id) GROUP BY source",
)
def ag10(spark: SparkSession, d: str) -> DataFrame:
    where = gold(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    single = where.groupBy("query_id").agg(F.min("source").alias("source"), F.count_distinct("source").alias("n")).where("n = 1").drop("n")
    return single.join(best_ranks(spark, d), "query_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("best") <= 10).alias("hits"))


@query("AG11_rank_buckets", f"WITH {BEST} SELECT CASE WHEN best IS NULL THEN 'none' WHEN best <= 1 THEN '1' WHEN best <= 10 THEN '2-10' ELSE '11-100' END AS bucket, count(*) AS n FROM be GROUP BY 1")
def ag11(spark: SparkSession, d: str) -> DataFrame:
    return best_ranks(spark, d).groupBy(evaluate.bucket(F.col("best")).alias("bucket")).agg(F.count("*").alias("n"))


@query("AG12_failures", f"WITH {RECALLS} SELECT query_id % 4 AS type, count(*) AS n, round(avg(CASE WHEN (CASE WHEN expected = 0 THEN 1.0 ELSE found_10 / expected END) < 0.5 THEN 1.0 ELSE 0 END), 6) AS failure_rate FROM re GROUP BY 1")
def ag12(spark: SparkSession, d: str) -> DataFrame:
    failed = (evaluate.recall(F.col("found_10"), F.col("expected")) < 0.5).cast("double")
    return recalls(spark, d).groupBy((F.col("query_id") % 4).alias("type")).agg(F.count("*").alias("n"), rounded(F.avg(failed)).alias("failure_rate"))


GRID = [10, 20, 50, 100]
GRID_SQL = f"{BOTH}, {LGOLD}, g AS (SELECT a, b FROM (SELECT unnest({GRID}) AS a), (SELECT unnest({GRID}) AS b)), un AS (SELECT DISTINCT a, b, query_id, doc_id FROM (SELECT a, b, query_id, doc_id FROM dn, g WHERE rank <= a UNION ALL SELECT a, b, query_id, doc_id FROM bm, g WHERE rank <= b)), uq AS (SELECT a, b, un.query_id, count(*) AS size, count(lgold.doc_id) AS gold FROM un LEFT JOIN lgold USING (query_id, doc_id) GROUP BY ALL)"


def union_grid(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, query_id, size, gold) of the unions of the lists' first a and b."""
    both = lists(spark, d)
    grid = F.broadcast(spark.range(1).select(F.explode(F.array(*map(F.lit, GRID))).alias("a")).select("a", F.explode(F.array(*map(F.lit, GRID))).alias("b")))
    rows = both["dense"].join(grid, F.col("rank") <= F.col("a")).select("a", "b", "query_id", "doc_id").unionByName(both["text"].join(grid, F.col("rank") <= F.col("b")).select("a", "b", "query_id", "doc_id")).distinct()
    hit = label_gold(spark, d).withColumn("is_gold", F.lit(True))
    return rows.join(hit, ["query_id", "doc_id"], "left").groupBy("a", "b", "query_id").agg(F.count("*").alias("size"), F.count("is_gold").alias("gold"))


@query("AG13_union_grid", f"WITH {GRID_SQL} SELECT a, b, count(CASE WHEN gold > 0 THEN 1 END) AS hits, round(avg(size), 6) AS mean_size FROM uq GROUP BY a, b")
def ag13(spark: SparkSession, d: str) -> DataFrame:
    return union_grid(spark, d).groupBy("a", "b").agg(F.count_if(F.col("gold") > 0).alias("hits"), rounded(F.avg("size")).alias("mean_size"))


@query("AG13_union_matrix", f"WITH {GRID_SQL}, m AS (SELECT a, b, round(avg(size), 6) AS s FROM uq GROUP BY a, b) SELECT a, max(CASE WHEN b = 10 THEN s END) AS b10, max(CASE WHEN b = 20 THEN s END) AS b20, max(CASE WHEN b = 50 THEN s END) AS b50, max(CASE WHEN b = 100 THEN s END) AS b100 FROM m GROUP BY a")
def ag13_matrix(spark: SparkSession, d: str) -> DataFrame:
    return union_grid(spark, d).groupBy("a").pivot("b", GRID).agg(rounded(F.avg("size"))).toDF("a", *[f"b{k}" for k in GRID])


SWEEP = [(n, k0) for n in (20, 50, 100) for k0 in (10, 60)]
SWEEP_SQL = f"{BOTH}, {LGOLD}, p AS (SELECT unnest({[n for n, _ in SWEEP]}) AS depth, unnest({[k for _, k in SWEEP]}) AS k0), sr AS (SELECT depth, k0, query_id, doc_id, round(sum(1.0 / (k0 + rank)), 9) AS score, min(CASE WHEN l = 0 THEN rank END) AS a, min(CASE WHEN l = 1 THEN rank END) AS b FROM (SELECT query_id, doc_id, rank, 0 AS l FROM dn UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm), p WHERE rank <= depth GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY depth, k0, query_id ORDER BY score DESC, a NULLS LAST, b NULLS LAST, doc_id) AS rank FROM sr), rg AS (SELECT rk.*, lgold.doc_id IS NOT NULL AS gold FROM rk LEFT JOIN lgold USING (query_id, doc_id)), su AS (SELECT depth, k0, count(CASE WHEN gold AND rank <= 10 THEN 1 END) AS gold_10, count(CASE WHEN gold AND rank <= 50 THEN 1 END) AS gold_50 FROM rg GROUP BY ALL)"


def rrf_sweep(spark: SparkSession, d: str) -> DataFrame:
    """(depth, k0, gold_10, gold_50): the parameter grid is a table, so one pass fuses for all of it."""
    both = fusion.tagged(lists(spark, d))
    grid = F.broadcast(spark.createDataFrame(SWEEP, "depth int, k0 int"))
    rows = both.join(grid, F.col("rank") <= F.col("depth")).groupBy("depth", "k0", "query_id", "doc_id").agg(F.round(F.sum(1.0 / (F.col("k0") + F.col("rank"))), 9).alias("score"), F.min(F.when(F.col("place") == 0, F.col("rank"))).alias("a"), F.min(F.when(F.col("place") == 1, F.col("rank"))).alias("b"))
    w = Window.partitionBy("depth", "k0", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("a"), F.asc_nulls_last("b"), "doc_id")
    hit = label_gold(spark, d).withColumn("is_gold", F.lit(True))
    rows = rows.withColumn("rank", F.row_number().over(w)).join(hit, ["query_id", "doc_id"], "left")
    return rows.groupBy("depth", "k0").agg(F.count_if(F.col("is_gold") & (F.col("rank") <= 10)).alias("gold_10"), F.count_if(F.col("is_gold") & (F.col("rank") <= 50)).alias("gold_50"))


@query("AG14_rrf_sweep", f"WITH {SWEEP_SQL} SELECT depth, k0, gold_10, gold_50 FROM su")
def ag14(spark: SparkSession, d: str) -> DataFrame:
    return rrf_sweep(spark, d)


@query("AG14_best_per_depth", f"WITH {SWEEP_SQL} SELECT depth, k0, gold_50 FROM su QUALIFY row_number() OVER (PARTITION BY depth ORDER BY gold_50 DESC, k0) = 1")
def ag14_best(spark: SparkSession, d: str) -> DataFrame:
    best = rrf_sweep(spark, d).groupBy("depth").agg(F.max_by(F.struct("k0", "gold_50"), F.struct("gold_50", -F.col("k0"))).alias("b"))
    return best.select("depth", "b.k0", "b.gold_50")


@query("AG15_best_checkpoint", "SELECT CAST(label AS VARCHAR) AS checkpoint, round(avg(embedding[1]), 6) AS metric FROM embeddings GROUP BY label ORDER BY round(avg(embedding[1]), 6) DESC, label LIMIT 1")
def ag15(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "embeddings").groupBy("label").agg(rounded(F.avg(F.col("embedding")[0].cast("double"))).alias("metric"))
    best = per.agg(F.max_by(F.struct("label", "metric"), F.struct("metric", -F.col("label"))).alias("b"))
    return best.select(F.col("b.label").cast("string").alias("checkpoint"), "b.metric")


@query(
    "AG23_list_overlap",
    f"WITH {BOTH}, o AS (SELECT coalesce(dn.query_id, bm.query_id) AS query_id, count(CASE WHEN dn.doc_id = bm.doc_id THEN 1 END) / count(*) AS jaccard FROM dn FULL JOIN bm ON dn.query_id = bm.query_id AND dn.doc_id = bm.doc_id GROUP BY 1) SELECT count(*) AS n, round(avg(jaccard), 6) AS mean, round(median(jaccard), 6) AS median FROM o",
)
def ag23(spark: SparkSession, d: str) -> DataFrame:
    both = lists(spark, d)
    return evaluate.jaccard(both["dense"], both["text"]).agg(F.count("*").alias("n"), rounded(F.avg("jaccard")).alias("mean"), rounded(F.median("jaccard")).alias("median"))


@query("AG23_win_tie_loss", f"WITH {BOTH}, {LGOLD}, q AS (SELECT DISTINCT query_id FROM lgold), x AS (SELECT q.query_id, (SELECT min(rank) FROM dn JOIN lgold USING (query_id, doc_id) WHERE dn.query_id = q.query_id) AS a, (SELECT min(rank) FROM bm JOIN lgold USING (query_id, doc_id) WHERE bm.query_id = q.query_id) AS b FROM q) SELECT CASE WHEN coalesce(a, 1000000) < coalesce(b, 1000000) THEN 'dense' WHEN coalesce(a, 1000000) > coalesce(b, 1000000) THEN 'text' ELSE 'tie' END AS winner, count(*) AS n FROM x GROUP BY 1")
def ag23_wins(spark: SparkSession, d: str) -> DataFrame:
    both, goals = lists(spark, d), label_gold(spark, d)
    q = goals.select("query_id").distinct()
    a = evaluate.gold_ranks(both["dense"], goals, q).withColumnRenamed("best", "a")
    b = evaluate.gold_ranks(both["text"], goals, q).withColumnRenamed("best", "b")
    x, y = F.coalesce("a", F.lit(1_000_000)), F.coalesce("b", F.lit(1_000_000))
    return a.join(b, "query_id").groupBy(F.when(x < y, "dense").when(x > y, "text").otherwise("tie").alias("winner")).agg(F.count("*").alias("n"))


CURVE = f"{BEST}, cu AS (SELECT k, count(CASE WHEN best <= k THEN 1 END) AS hits, round(100.0 * count(CASE WHEN best <= k THEN 1 END) / count(*), 3) AS pct FROM be, (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k) GROUP BY k)"


@query("WN6_marginal_gain", f"WITH {CURVE} SELECT CAST(k AS INTEGER) AS k, pct AS hit_rate_pct, CAST(k - lag(k) OVER (ORDER BY k) AS INTEGER) AS d_key, round((pct - lag(pct) OVER (ORDER BY k)) / (k - lag(k) OVER (ORDER BY k)) * 100, 3) AS gain FROM cu")
def wn6(spark: SparkSession, d: str) -> DataFrame:
    curve = evaluate.hit_rates(best_ranks(spark, d))
    return rank.adjacent(curve, "k", "hit_rate_pct").select("k", "hit_rate_pct", "d_key", rounded(F.col("gain"), 3).alias("gain"))


@query("WN7_pareto", f"WITH {GRID_SQL}, s AS (SELECT a, b, sum(gold)::BIGINT AS gold, round(avg(size), 6) AS mean_size FROM uq GROUP BY a, b) SELECT a, b, gold, mean_size, coalesce(gold > max(gold) OVER (ORDER BY mean_size, gold DESC, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_optimal FROM s")
def wn7(spark: SparkSession, d: str) -> DataFrame:
    sums = union_grid(spark, d).groupBy("a", "b").agg(F.sum("gold").alias("gold"), rounded(F.avg("size")).alias("mean_size"))
    return rank.pareto(sums, "mean_size", "gold", ("a", "b"))


@query("WN8_smallest_k", f"WITH {CURVE} SELECT CAST(min(k) AS INTEGER) AS k FROM cu WHERE pct >= 40")
def wn8(spark: SparkSession, d: str) -> DataFrame:
    return rank.smallest_reaching(evaluate.hit_rates(best_ranks(spark, d)), "k", "hit_rate_pct", 40)


@query("WN12_page", f"WITH {_bm(ITEMS)}, t AS (SELECT query_id, count(*) AS n FROM bm GROUP BY 1) SELECT query_id, doc_id, rank, substr(text, 1, 6000) AS text, greatest(n - 15, 0) AS remaining, n <= 15 AS exhausted FROM bm JOIN t USING (query_id) JOIN documents USING (doc_id) WHERE rank BETWEEN 11 AND 15")
def wn12(spark: SparkSession, d: str) -> DataFrame:
    page = rank.page(item_ranking(spark, d), "query_id", 10, 5)
    return page.join(table(spark, d, "documents").select("doc_id", F.substring("text", 1, 6000).alias("text")), "doc_id").select("query_id", "doc_id", "rank", "text", F.col("remaining").cast("long").alias("remaining"), "exhausted")


@query("WN16_inspect_ranking", f"WITH {_bm(ITEMS)}, {GOLD} SELECT bm.query_id, bm.doc_id, bm.rank, gold.doc_id IS NOT NULL AS is_gold FROM bm JOIN benchmark i ON i.item_id = bm.query_id LEFT JOIN gold ON gold.query_id = bm.query_id AND gold.doc_id = bm.doc_id WHERE contains(lower(i.text), 'the') AND bm.rank <= 20")
def wn16(spark: SparkSession, d: str) -> DataFrame:
    wanted = items(spark, d).where(F.contains(F.lower("text"), F.lit("the"))).select("query_id")
    marked = gold(spark, d).withColumn("g", F.lit(True))
    rows = item_ranking(spark, d, 20).join(wanted, "query_id", "left_semi").join(marked, ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", "rank", F.coalesce("g", F.lit(False)).alias("is_gold"))


@query("JN11_passage_holders", f"WITH {GOLD} SELECT query_id, doc_id FROM gold")
def jn11(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d)


@query(
    "JN14_gold_audit",
    f"WITH {GOLD}, a AS (SELECT i.item_id AS query_id, gold.doc_id, e.vec_id FROM benchmark i LEFT JOIN gold ON gold.query_id = i.item_id LEFT JOIN embeddings e ON e.vec_id = gold.doc_id) SELECT CASE WHEN doc_id IS NULL THEN 'missing' WHEN vec_id IS NULL THEN 'no vector' ELSE 'ok' END AS state, count(*) AS n FROM a GROUP BY 1",
)
def jn14(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).select("query_id").join(gold(spark, d), "query_id", "left").join(vectors(spark, d).select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return rows.groupBy(F.when(F.col("doc_id").isNull(), "missing").when(F.col("has").isNull(), "no vector").otherwise("ok").alias("state")).agg(F.count("*").alias("n"))
