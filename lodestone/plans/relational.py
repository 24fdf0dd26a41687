"""Joins, aggregations, windows and set operations that don't start from ranked lists (JN, AG, WN, ST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import dense, rank, tree
from lodestone.plans.base import query, rounded, table
from lodestone.plans.retrieval import ITEMS, _bm, asked, item_ranking, vectors


@query("JN1_hydrate", "SELECT l.doc_id, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id)")
def jn1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id")


@query("JN2_ordered_lookup", f"WITH {_bm(ITEMS, k=20)} SELECT query_id, rank AS pos, doc_id, label FROM bm JOIN embeddings ON vec_id = doc_id")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    """Rows for ranked ids: the place is carried along, ids that are not there are left out."""
    order = item_ranking(spark, d, 20).select("query_id", F.col("rank").alias("pos"), "doc_id")
    return order.join(vectors(spark, d).select("doc_id", "label"), "doc_id").select("query_id", "pos", "doc_id", "label")


@query("JN3_not_embedded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def jn3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("JN4_referenced", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id", "source").join(ids, "doc_id", "left_semi")


#: A tree over the tables: root 0, regions, nations, customers.
NODES_SQL = """nodes AS (SELECT 'root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS depth
UNION ALL SELECT 'r' || r_regionkey, 'root', 1 FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 3 FROM customer)"""
LINKS_SQL = NODES_SQL.replace("nodes AS", "base AS") + ", cnt AS (SELECT parent_id AS node_id, count(*) AS n FROM base WHERE parent_id IS NOT NULL GROUP BY 1), nodes AS (SELECT base.*, coalesce(cnt.n, 0) AS n_children FROM base LEFT JOIN cnt USING (node_id))"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    root = spark.sql("select 'root' as node_id, cast(null as string) as parent_id, 0 as depth")
    return (
        root.union(table(spark, d, "region").selectExpr("concat('r', r_regionkey)", "'root'", "1"))
        .union(table(spark, d, "nation").selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)", "2"))
        .union(table(spark, d, "customer").selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)", "3"))
    )


@query(
    "JN6_path_to_root",
    f"WITH RECURSIVE {NODES_SQL}, up AS (SELECT node_id AS leaf, node_id, parent_id, 0 AS step FROM nodes WHERE depth = 3 UNION ALL SELECT up.leaf, nodes.node_id, nodes.parent_id, up.step + 1 FROM up JOIN nodes ON nodes.node_id = up.parent_id) SELECT leaf, array_to_string(list(node_id ORDER BY step DESC), '/') AS path FROM up GROUP BY leaf",
)
def jn6(spark: SparkSession, d: str) -> DataFrame:
    every = nodes(spark, d)
    return tree.paths(every, every.where("depth = 3").select("node_id"), 8).select(F.col("node_id").alias("leaf"), "path")


@query("AG6_tree_stats", f"WITH {LINKS_SQL} SELECT count(*) AS total, count(CASE WHEN n_children = 0 THEN 1 END) AS leaves, count(CASE WHEN n_children > 0 THEN 1 END) AS internal, max(depth) AS max_depth FROM nodes")
def ag6(spark: SparkSession, d: str) -> DataFrame:
    return tree.stats(tree.with_child_counts(nodes(spark, d)))


@query("WN13_tree_edges", f"WITH {NODES_SQL} SELECT parent_id AS source, node_id AS target, depth FROM nodes WHERE parent_id IS NOT NULL")
def wn13(spark: SparkSession, d: str) -> DataFrame:
    return tree.edges(nodes(spark, d))


@query(
    "WN17_tree_view",
    f"WITH {LINKS_SQL}, k AS (SELECT * FROM nodes WHERE depth <= 2 ORDER BY n_children DESC, node_id LIMIT 20) SELECT n.parent_id AS source, n.node_id AS target FROM k n JOIN k p ON p.node_id = n.parent_id",
)
def wn17(spark: SparkSession, d: str) -> DataFrame:
    return tree.view(tree.with_child_counts(nodes(spark, d)), 2, 20, "n_children").select("source", "target")


@query(
    "WN10_sibling_links",
    f"WITH {NODES_SQL} SELECT node_id, parent_id, lead(node_id) OVER w AS next_sibling, row_number() OVER w - 1 AS sibling_idx, count(*) OVER (PARTITION BY parent_id) AS n_siblings FROM nodes WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY parent_id ORDER BY node_id)",
)
def wn10(spark: SparkSession, d: str) -> DataFrame:
    rows = tree.sibling_links(nodes(spark, d).where("parent_id is not null"), "parent_id", "node_id", "node_id")
    return rows.select("node_id", "parent_id", "next_sibling", F.col("sibling_idx").cast("long").alias("sibling_idx"), "n_siblings")


@query(
    "JN7_interval_parent",
    "WITH s AS (SELECT conv_id, turn * 10 AS a, turn * 10 + 9 AS b, 1 AS level FROM conversations), p AS (SELECT conv_id, 0 AS a, max(turn) * 10 + 9 AS b, 0 AS level FROM conversations GROUP BY conv_id) SELECT s.conv_id, s.a AS start, p.b AS parent_end FROM s JOIN p ON p.conv_id = s.conv_id AND s.a >= p.a AND s.b <= p.b",
)
def jn7(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    low = turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 9).alias("end"), F.lit(1).alias("level"))
    top = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.lit(0).cast("long").alias("start"), (F.max("turn") * 10 + 9).alias("end")).withColumn("level", F.lit(0))
    found = tree.interval_parents(low.unionByName(top))
    return found.where("level = 1").select(F.col("doc_id").alias("conv_id"), "start", F.col("parent_end"))


@query("JN9_all_pairs_similarity", "SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0")
def jn9(spark: SparkSession, d: str) -> DataFrame:
    n = vectors(spark, d).count()
    return dense.top_k(vectors(spark, d), asked(spark, d), n, "inner").select("query_id", "doc_id", "score")


MEANS = "me AS (SELECT label AS cluster, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY ALL) GROUP BY label)"
DIST = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))))"
VD = "vd AS (SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("JN10_nearest_centre", f"WITH {MEANS}, {VD}, p AS (SELECT doc_id, cluster, round({DIST}, 9) AS distance FROM vd, me) SELECT doc_id, cluster, round(distance, 6) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, cluster) = 1")
def jn10(spark: SparkSession, d: str) -> DataFrame:
    centres = dense.elementwise(table(spark, d, "embeddings"), "label", "embedding").withColumnRenamed("label", "cluster")
    return dense.nearest(vectors(spark, d), centres).select("doc_id", "cluster", rounded(F.col("distance")).alias("distance"))


@query("JN13_text_to_id", "SELECT c.conv_id, c.turn, m.first_id FROM conversations c JOIN (SELECT text, min(conv_id * 100 + turn) AS first_id FROM conversations GROUP BY text) m ON m.text = c.text")
def jn13(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", tx.content_hash(F.col("text")).alias("h"))
    known = rows.groupBy("h").agg(F.min(F.col("conv_id") * 100 + F.col("turn")).alias("first_id"))
    return rows.join(known, "h").select("conv_id", "turn", "first_id")


@query("JN15_compare_stores", "WITH a AS (SELECT vec_id, sha256(CAST(vec_id AS VARCHAR) || ':' || CAST(round(embedding[1]::DOUBLE, 6) AS VARCHAR)) AS h FROM embeddings), b AS (SELECT * FROM a WHERE vec_id % 10 <> 3) SELECT CASE WHEN b.h IS NULL THEN 'only in first' WHEN a.h = b.h THEN 'same' ELSE 'differs' END AS state, count(*) AS n FROM a FULL JOIN b ON a.vec_id = b.vec_id GROUP BY 1")
def jn15(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "embeddings").select("vec_id", F.sha2(F.concat_ws(":", F.col("vec_id").cast("string"), F.concat_ws(",", F.col("embedding").cast("array<string>"))).cast("binary"), 256).alias("h"))
    two = one.where("vec_id % 10 <> 3").select("vec_id", F.col("h").alias("g"))
    state = F.when(F.col("g").isNull(), "only in first").when(F.col("h").isNull(), "only in second").when(F.col("h") == F.col("g"), "same").otherwise("differs")
    return one.join(two, "vec_id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("AG3_duplicates", "SELECT count(*) AS total, count(*) - count(DISTINCT sha256(text)) AS removed, count(DISTINCT sha256(text)) AS unique_texts FROM documents")
def ag3(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy(tx.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total"), (F.sum("n") - F.count("*")).alias("removed"), F.count("*").alias("unique_texts"))


@query("AG4_composition", "SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct FROM documents GROUP BY source")
def ag4(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.withColumn("pct", rounded(100 * F.col("n") / F.sum("n").over(every), 3))


@query("AG5_size_distribution", "SELECT round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.99), 6) AS p99, max(n_chars) AS largest FROM documents")
def ag5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(rounded(F.percentile("n_chars", 0.5)).alias("median"), rounded(F.percentile("n_chars", 0.99)).alias("p99"), F.max("n_chars").alias("largest"))


@query("AG16_one_hot", "SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS l0, CASE WHEN label = 1 THEN 1 ELSE 0 END AS l1, CASE WHEN label = 2 THEN 1 ELSE 0 END AS l2, CASE WHEN label > 2 THEN 1 ELSE 0 END AS others FROM embeddings")
def ag16(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select("vec_id", F.least("label", F.lit(3)).alias("l"))
    return own.select("vec_id", *[(F.col("l") == k).cast("int").alias(n) for k, n in enumerate(("l0", "l1", "l2", "others"))])


@query("AG17_centroid", f"WITH {MEANS} SELECT cluster, round(c[1], 6) AS head, round(c[64], 6) AS tail FROM me")
def ag17(spark: SparkSession, d: str) -> DataFrame:
    means = dense.elementwise(table(spark, d, "embeddings"), "label", "embedding")
    return means.select(F.col("label").alias("cluster"), rounded(F.col("centre")[0]).alias("head"), rounded(F.element_at("centre", -1)).alias("tail"))


@query("AG20_five_each", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) <> 5")
def ag20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).where("n <> 5")


@query("AG21_latency", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def ag21(spark: SparkSession, d: str) -> DataFrame:
    at = [rounded(F.percentile("value", p)).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return table(spark, d, "events").groupBy("event_type").agg(*at, rounded(F.avg("value")).alias("mean"))


@query("AG22_judge_means", "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def ag22(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), rounded(F.avg("quality")).alias("quality"), rounded(F.avg("toxic")).alias("toxic"))


@query("AG24_store_check", "SELECT label, count(*) AS n, count(CASE WHEN sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) BETWEEN 0.95 AND 1.05 THEN 1 END) AS unit FROM embeddings GROUP BY label")
def ag24(spark: SparkSession, d: str) -> DataFrame:
    size = vx.norm(F.col("embedding"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(size.between(0.95, 1.05)).alias("unit"))


@query("WN9_keep_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY sha256(text)")
def wn9(spark: SparkSession, d: str) -> DataFrame:
    return rank.first_per(table(spark, d, "documents").select(tx.content_hash(F.col("text")).alias("hash"), "doc_id"), "hash", "doc_id")


@query("WN11_sample_per_group", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= 5")
def wn11(spark: SparkSession, d: str) -> DataFrame:
    return rank.sampled(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5, 42)


@query("WN14_page_of_documents", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def wn14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").offset(100).limit(50)


@query("WN15_partition_ids", "SELECT doc_id % 8 AS part, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1")
def wn15(spark: SparkSession, d: str) -> DataFrame:
    pending = jn3(spark, d)
    return pending.groupBy(F.pmod("doc_id", F.lit(8)).alias("part")).agg(F.count("*").alias("n"))


@query("ST4_gold_cited", "SELECT conv_id, bool_or(turn = 1 AND role = 'assistant') AS cited FROM conversations GROUP BY conv_id")
def st4(spark: SparkSession, d: str) -> DataFrame:
    gold = F.array(F.lit("1:assistant"))
    cited = F.coalesce(F.array_contains(gold, F.concat_ws(":", "turn", "role")), F.lit(False))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or(cited).alias("cited"))


@query("ST5_move_members", "SELECT vec_id, CASE WHEN label = 1 AND vec_id % 3 = 0 THEN 2 ELSE label END AS cluster FROM embeddings")
def st5(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    moves = members.where("cluster = 1 and vec_id % 3 = 0").select("vec_id", F.lit(2).alias("cluster"))
    return members.join(moves.select("vec_id"), "vec_id", "left_anti").unionByName(moves)


@query("ST6_distinct_citations", "SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: len(list_filter(list_slice(l, 1, i - 1), lambda y: y = x)) = 0), ',') AS cited FROM (SELECT conv_id, turn, [conv_id % 5, turn % 3, conv_id % 5, turn % 2] AS l FROM conversations)")
def st6(spark: SparkSession, d: str) -> DataFrame:
    cited = F.array(F.col("conv_id") % 5, F.col("turn") % 3, F.col("conv_id") % 5, F.col("turn") % 2)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(cited).cast("array<string>"), ",").alias("cited"))


@query("JN8_overlapping_intervals", "SELECT a.conv_id, a.turn, b.turn AS other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn * 10 < b.turn * 10 + 15 AND b.turn * 10 < a.turn * 10 + 15 AND a.turn < b.turn")
def jn8(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 15).alias("end"))
    b = a.select("conv_id", F.col("turn").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"))
    return a.join(b, "conv_id").where((F.col("start") < F.col("e")) & (F.col("s") < F.col("end")) & (F.col("turn") < F.col("other"))).select("conv_id", "turn", "other")
