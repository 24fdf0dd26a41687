"""Sources, sinks, projections and filters (SRC, SNK, PRJ, FLT, CFG)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import sources
from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import models, rank
from lodestone.plans.base import query, rounded, shared_path, table

STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query("SRC1_walk_text_tree", "SELECT CAST(n_regionkey AS VARCHAR) AS source, n_name AS text, CAST(length(n_name) + 1 AS BIGINT) AS size FROM nation")
def src1(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "tree")
    sources.write_texts(table(spark, d, "nation"), path, "n_name", "n_regionkey")
    return sources.text_tree(spark, path).select(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).alias("source"), F.regexp_replace("text", "\n$", "").alias("text"), "size")


@query("SRC2_flat_texts", "SELECT r_name AS text FROM region WHERE trim(r_name) <> ''")
def src2(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "flat")
    sources.write_texts(table(spark, d, "region").selectExpr("concat('  ', r_name, ' ') as text").union(spark.createDataFrame([("  ",)], "text string")), path)
    return sources.flat_texts(spark, path).select("text")


@query("SRC3_over_200_chars", "SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) > 200")
def src3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length(F.trim("text")) > 200).select("doc_id", "n_chars")


@query("SRC4_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def src4(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "jsonl")
    rows = table(spark, d, "conversations")
    sources.write_json(rows, path)
    return sources.json_lines(spark, path, "conv_id long, turn long, role string, text string")


@query("SRC5_csv", "SELECT doc_id, quality, toxic FROM labels")
def src5(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "csv")
    sources.write_csv(table(spark, d, "labels"), path)
    return sources.csv_rows(spark, path, table(spark, d, "labels").schema)


@query("SRC6_parquet_subset", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def src6(spark: SparkSession, d: str) -> DataFrame:
    return sources.parquet_subset(spark, f"{d}/documents.parquet", ["doc_id", "source"], table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("SRC7_candidate_vectors", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def src7(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return sources.parquet_subset(spark, f"{d}/embeddings.parquet", ["vec_id", "label"], ids, "vec_id")


@query("SRC8_first_like", "SELECT page_id, url FROM pages WHERE url LIKE '%example.com/fr/%' ORDER BY page_id LIMIT 1")
def src8(spark: SparkSession, d: str) -> DataFrame:
    return sources.first_containing(table(spark, d, "pages").select("page_id", "url"), "url", "example.com/fr/", "page_id")


@query("SRC9_chunked_scan", "SELECT doc_id // 1000 AS chunk, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1")
def src9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.expr("doc_id div 1000").alias("chunk")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SRC11_vector_arrays", "SELECT vec_id, len(embedding) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def src11(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate(vx.doubles(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), rounded(total).alias("total"))


@query(
    "SRC12_fingerprint",
    "WITH s AS (SELECT count(*) AS n, coalesce(sum(CAST('0x' || substr(md5(url), 1, 15) AS BIGINT)), 0) AS t FROM pages) SELECT n, sha256(CAST(n AS VARCHAR) || ':' || CAST(t AS VARCHAR)) AS fingerprint FROM s",
)
def src12(spark: SparkSession, d: str) -> DataFrame:
    return sources.fingerprint(table(spark, d, "pages"), "url")


@query("SRC13_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def src13(spark: SparkSession, d: str) -> DataFrame:
    return sources.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SNK1_append", "SELECT role, count(*) * 2 AS n FROM conversations GROUP BY role")
def snk1(spark: SparkSession, d: str) -> DataFrame:
    path, rows = shared_path(spark, "store"), table(spark, d, "conversations")
    for _ in range(2):
        sources.append(rows, path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("role").agg(F.count("*").alias("n"))


@query("SNK3_csv_summary", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang, source")
def snk3(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "summary")
    sources.write_csv(table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), path)
    return sources.csv_rows(spark, path, "lang string, source string, n long, chars long")


@query("SNK4_json_records", "SELECT item_id, text FROM benchmark")
def snk4(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "records")
    sources.write_json(table(spark, d, "benchmark"), path)
    return sources.json_lines(spark, path, "item_id long, text string")


@query("SNK6_vector_store", "SELECT vec_id, label, len(embedding) AS dims FROM embeddings")
def snk6(spark: SparkSession, d: str) -> DataFrame:
    path, rows = shared_path(spark, "vectors"), table(spark, d, "embeddings")
    sources.append(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))


@query("PRJ1_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def prj1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


@query("PRJ2_node_id", "SELECT doc_id, substr(sha1(CAST(doc_id AS VARCHAR) || '|' || '0:0:' || CAST(n_chars AS VARCHAR)), 1, 16) AS node_id FROM documents")
def prj2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.node_id(F.col("doc_id"), F.lit(0), F.lit(0), F.col("n_chars")).alias("node_id"))


@query("PRJ3_snippet", "SELECT doc_id, substr(text, 1, 2000) AS kept, CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '…' ELSE text END AS snippet FROM documents")
def prj3(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.truncated(t).alias("kept"), tx.snippet(t).alias("snippet"))


@query("PRJ4_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def prj4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query(
    "PRJ5_collapsed_preview",
    r"SELECT doc_id, substr(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), 1, 500) || CASE WHEN length(text) > 500 THEN '...' ELSE '' END AS preview FROM documents",
)
def prj5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.collapsed_preview(F.col("text")).alias("preview"))


@query("PRJ6_title", "SELECT doc_id, CASE WHEN trim(substr(split_part(text, chr(10), 1), 1, 100)) = '' THEN source ELSE substr(split_part(text, chr(10), 1), 1, 100) END AS title FROM documents")
def prj6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.title(F.col("text"), F.col("source")).alias("title"))


@query("PRJ7_source_of_path", "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS source FROM pages")
def prj7(spark: SparkSession, d: str) -> DataFrame:
    path = F.split_part("url", F.lit("://"), F.lit(2))
    return table(spark, d, "pages").select("page_id", F.split_part(path, F.lit("/"), F.lit(1)).alias("source"))


@query("PRJ8_bare_id", "SELECT doc_id, 'dsid_' || md5(CAST(doc_id AS VARCHAR)) AS bare, source || '/dsid_' || md5(CAST(doc_id AS VARCHAR)) AS stem FROM documents")
def prj8(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.lit("/dsid_"), F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("__slug.txt"))
    return table(spark, d, "documents").select("doc_id", tx.bare_id(path).alias("bare"), tx.id_before_slug(path).alias("stem"))


@query("PRJ9_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def prj9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", tx.iso_time(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("iso"))


NORMED = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS s FROM v) "


@query("PRJ10_normalise", NORMED + "SELECT vec_id, round(s, 6) AS size, round(v[1] / s, 6) AS head, round(v[64] / s, 6) AS tail FROM n")
def prj10(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", rounded(vx.norm(v)).alias("size"), rounded(vx.normalised(v)[0]).alias("head"), rounded(F.element_at(vx.normalised(v), -1)).alias("tail"))


QUANT = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM v), q AS (SELECT vec_id, v, scale, list_transform(v, lambda x: CAST(greatest(least(round_even(x / scale, 0), 127), -128) AS INTEGER)) AS q FROM s) "


@query("PRJ11_quantise", QUANT + "SELECT vec_id, round(scale, 9) AS scale, q FROM q")
def prj11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", vx.quantise_scale(F.col("embedding")).alias("scale"))
    rows = rows.withColumn("q", vx.quantised(F.col("embedding"), F.col("scale")))  # beside the rounded scale, Spark would take that one within the lambda
    return rows.select("vec_id", rounded(F.col("scale"), 9).alias("scale"), "q")


@query("PRJ12_dequantise", QUANT + "SELECT vec_id, round(list_max(list_transform(range(1, 65), lambda i: abs(q[i] * scale - v[i]))), 6) AS worst FROM q")
def prj12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", vx.quantise_scale(F.col("embedding")).alias("scale"))
    rows = rows.withColumn("back", vx.dequantised(vx.quantised(F.col("embedding"), F.col("scale")), F.col("scale")))
    return rows.select("vec_id", rounded(F.array_max(F.zip_with("back", vx.doubles(F.col("embedding")), lambda a, b: F.abs(a - b)))).alias("worst"))


RAW_TERMS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')"
KEPT_TERMS = f"list_filter({RAW_TERMS}, lambda t: length(t) > 2 AND t NOT IN ({STOPS}))"
TERMS_SQL = f"CASE WHEN len({KEPT_TERMS}) > 0 THEN list_slice({KEPT_TERMS}, 1, 20) ELSE list_slice({RAW_TERMS}, 1, 10) END"


@query("PRJ13_query_terms", f"SELECT item_id, array_to_string({TERMS_SQL}, ' | ') AS or_query FROM benchmark")
def prj13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", tx.or_query(F.col("text")).alias("or_query"))


@query(
    "PRJ14_query_variants",
    "SELECT item_id, u.pos AS pos, u.v AS variant FROM benchmark, LATERAL (SELECT unnest(range(6)) AS pos, unnest([text, 'What is ' || text || '?', 'Explain ' || text, 'Details about ' || text, 'Represent this question for searching relevant passages: ' || text, 'Given a question, find the most relevant document: ' || text]) AS v) u",
)
def prj14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.posexplode(tx.variants(F.col("text"))).alias("pos", "variant")).withColumn("pos", F.col("pos").cast("long"))


@query(
    "PRJ15_hypothetical_passage",
    r"SELECT item_id, CASE WHEN len(w) = 0 THEN '' ELSE 'This document describes ' || array_to_string(list_slice(w, 1, 20), ' ') || '.' END AS passage FROM (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '') AS w FROM benchmark)",
)
def prj15(spark: SparkSession, d: str) -> DataFrame:
    return models.apply_text_model(table(spark, d, "benchmark"), "item_id", "text", "passage", models.MODELS["passage"])


@query("FLT1_prefilter", "SELECT vec_id FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.source = 'src1' AND d.n_chars >= 500")
def flt1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source = 'src1' and n_chars >= 500").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id").join(docs, "vec_id", "left_semi")


@query("FLT2_has_embedding", "SELECT count(*) AS total, count(e.vec_id) AS with_vector, count(*) - count(e.vec_id) AS without_vector FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def flt2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").isNotNull().alias("has")), "doc_id", "left")
    return rows.agg(F.count("*").alias("total"), F.count_if("has").alias("with_vector"), (F.count("*") - F.count_if("has")).alias("without_vector"))


@query("FLT3_not_blank", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def flt3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where(F.trim("text") != "").select("conv_id", "turn")


@query("FLT4_threshold_or_minimum", "SELECT source, doc_id FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE n_chars > 9000 OR r <= 15")
def flt4(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("score"))
    return rank.above_or_first(rows, "source", "score", "doc_id", 9000, 15).select("source", "doc_id")


@query("FLT5_clamp", "SELECT o_orderkey, greatest(1, least(25000, o_orderkey - 100)) AS top_k FROM orders")
def flt5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", tx.clamp(F.col("o_orderkey") - 100, 1, 25000).alias("top_k"))


@query("FLT6_point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def flt6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("doc_id") == 42).select("doc_id", "lang", "source", "n_chars")


@query(
    "CFG1_recall_default",
    "WITH g AS (SELECT b.item_id, count(d.doc_id) AS n_expected, count(CASE WHEN d.lang = 'en' THEN 1 END) AS n_found FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id) SELECT item_id, n_expected, n_found, CASE WHEN n_expected = 0 THEN 1.0::DOUBLE ELSE round(n_found / n_expected, 6) END AS recall FROM g",
)
def cfg1(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators import evaluate
    from lodestone.plans.retrieval import gold

    found = gold(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    per = found.groupBy("query_id").agg(F.count("*").alias("n_expected"), F.count_if(F.col("lang") == "en").alias("n_found"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(per, "query_id", "left").fillna(0, ["n_expected", "n_found"])
    return rows.select(F.col("query_id").alias("item_id"), "n_expected", "n_found", rounded(evaluate.recall(F.col("n_found"), F.col("n_expected"))).alias("recall"))
