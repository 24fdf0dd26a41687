"""Clustering, the cluster tree and keywords (CL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cluster, dense, keywords
from lodestone.plans.base import query, rounded, stored, table
from lodestone.plans.relational import DIST, MEANS, VD
from lodestone.plans.retrieval import vectors
from lodestone.plans.scalars import STOPS


def centres(spark: SparkSession, d: str) -> DataFrame:
    return stored(dense.elementwise(table(spark, d, "embeddings"), "label", "embedding").withColumnRenamed("label", "cluster"), "centres")


SHARES = f"{MEANS}, {VD}, ds AS (SELECT doc_id, label, cluster, {DIST} AS distance FROM vd, me), cl AS (SELECT *, 1 - distance / (max(distance) OVER (PARTITION BY doc_id) + 1e-8) AS c FROM ds), sh AS (SELECT doc_id, label, cluster, distance, c / sum(c) OVER (PARTITION BY doc_id) AS p FROM cl)"


@query("CL1_reduce")
def cl1(spark: SparkSession, d: str) -> DataFrame:
    return cluster.reduced(vectors(spark, d).select("doc_id", "vector"), 32).select("doc_id", F.size("vector").alias("dims"))


@query("CL2_cluster")
def cl2(spark: SparkSession, d: str) -> DataFrame:
    return cluster.split_into(vectors(spark, d).select("doc_id", "vector"), 10).select("doc_id", "cluster")


@query("CL3_memberships", f"WITH {SHARES} SELECT doc_id, cluster, round(p, 6) AS probability FROM sh")
def cl3(spark: SparkSession, d: str) -> DataFrame:
    return cluster.memberships(vectors(spark, d), centres(spark, d)).select("doc_id", "cluster", rounded(F.col("probability")).alias("probability"))


@query(
    "CL4_secondary",
    f"WITH {SHARES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, cluster) AS place, max(p) OVER (PARTITION BY doc_id) AS first FROM sh) SELECT doc_id, cluster, place = 2 AS is_secondary FROM r WHERE place = 1 OR (place = 2 AND p > 0.1 AND p >= 0.8 * first)",
)
def cl4(spark: SparkSession, d: str) -> DataFrame:
    return cluster.secondary(cluster.memberships(vectors(spark, d), centres(spark, d)), 0.1)


@query(
    "CL5_noise_to_nearest",
    f"WITH {MEANS}, {VD}, m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE label END AS cluster, v FROM vd), n AS (SELECT doc_id, me.cluster, round({DIST}, 9) AS distance FROM m, me WHERE m.cluster = -1) SELECT doc_id, cluster FROM m WHERE cluster >= 0 UNION ALL SELECT doc_id, cluster FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, cluster) = 1",
)
def cl5(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("doc_id", "vector", F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("label")).alias("cluster"))
    return cluster.noise_to_nearest(rows, centres(spark, d))


@query("CL6_medoids", f"WITH {MEANS}, {VD}, n AS (SELECT cluster, doc_id, round({DIST}, 9) AS distance FROM vd JOIN me ON label = cluster) SELECT cluster, doc_id FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY distance, doc_id) = 1")
def cl6(spark: SparkSession, d: str) -> DataFrame:
    return cluster.medoids(vectors(spark, d).withColumnRenamed("label", "cluster"), centres(spark, d))


@query(
    "CL7_refine_borderline",
    f"WITH {SHARES}, b AS (SELECT doc_id, cluster, p FROM sh QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, cluster) = 1) SELECT doc_id, CASE WHEN abs(p - 0.15) <= 0.05 THEN (doc_id * 3 + 9) % 10 ELSE cluster END AS cluster FROM b",
)
def cl7(spark: SparkSession, d: str) -> DataFrame:
    shares = cluster.memberships(vectors(spark, d), centres(spark, d))
    judged = shares.select("doc_id", "cluster").withColumn("score", (F.col("cluster") == (F.col("doc_id") * 3 + 9) % 10).cast("double"))
    return cluster.refined(shares, judged, 0.15).withColumn("cluster", F.col("cluster").cast("long"))


def tree_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cluster.build_tree(vectors(spark, d), stored, leaf_size=50)


@query("CL8_cluster_tree", "SELECT count(*) AS docs, 1 AS trees FROM embeddings")
def cl8(spark: SparkSession, d: str) -> DataFrame:
    nodes, members = tree_of(spark, d)
    inside = members.join(nodes.where("is_leaf"), "node_id").agg(F.count_distinct("doc_id").alias("docs"))
    return inside.crossJoin(nodes.where("parent_id is null").agg(F.count("*").cast("int").alias("trees")))


@query("CL10_rebuild", "SELECT count(*) AS root_docs FROM embeddings")
def cl10(spark: SparkSession, d: str) -> DataFrame:
    return tree_of(spark, d)[0].where("depth = 0").select(F.col("doc_count").alias("root_docs"))


TERMS = rf"w AS (SELECT label AS g, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOPS})) AS w FROM embeddings JOIN documents ON vec_id = doc_id), t AS (SELECT g, unnest(w) AS term FROM w UNION ALL SELECT g, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w), c AS (SELECT g, term, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT term, sum(n) AS total, count(*) AS groups FROM c GROUP BY term ORDER BY total DESC, term LIMIT 10000), k AS (SELECT c.g, c.term, c.n, f.groups, sum(c.n) OVER (PARTITION BY c.g) AS size FROM c JOIN f USING (term)), s AS (SELECT g, term, round(n / size * ln(1 + (SELECT count(DISTINCT g) FROM w) / (1 + groups)), 9) AS score FROM k)"


@query("CL9_keywords", f"WITH {TERMS} SELECT g AS label, term, score, CAST(row_number() OVER (PARTITION BY g ORDER BY score DESC, term) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, term) <= 10")
def cl9(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("doc_id", F.col("label").alias("group")).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return keywords.ctfidf(rows).select(F.col("group").alias("label"), "term", "score", "rank")


@query("CL11_change_events", "SELECT CASE WHEN label < 2 THEN 'node_created' WHEN label > 7 THEN 'node_removed' WHEN label % 2 = 0 THEN 'node_updated' ELSE 'node_completed' END AS event, count(DISTINCT label) AS n FROM embeddings GROUP BY 1")
def cl11(spark: SparkSession, d: str) -> DataFrame:
    sizes = vectors(spark, d).groupBy(F.col("label").alias("node_id")).agg(F.count("*").alias("doc_count"))
    after = sizes.where("node_id <= 7").withColumn("doc_count", F.when(F.col("node_id") % 2 == 0, F.col("doc_count") + 1).otherwise(F.col("doc_count")))
    return cluster.change_events(sizes.where("node_id >= 2"), after).groupBy("event").agg(F.count("*").alias("n"))
