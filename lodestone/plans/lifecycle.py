"""Chunks, ingest, training data, streams and the agent's tables (CH, IN, FT, SM, AGT, UD)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import chunk, ingest, mining, models, rank
from lodestone.plans.base import query, rounded, shared_path, stored, table
from lodestone.plans.retrieval import BOTH, RRF, fused, vectors
from lodestone.streaming import events as ev


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


# ---- chunks

@query("CH1_sentences", "SELECT doc_id, length(text) AS covered, CAST(0 AS BIGINT) AS gaps FROM documents WHERE text <> ''")
def ch1(spark: SparkSession, d: str) -> DataFrame:
    """Sentences cover every text without gaps."""
    rows = chunk.sentence_table(docs(spark, d))
    gap = F.col("start") - F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("n")), F.lit(0))
    return rows.withColumn("gap", gap).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.sum("gap").alias("gaps"))


@query("CH2_sentence_rows")
def ch2(spark: SparkSession, d: str) -> DataFrame:
    return chunk.sentence_table(docs(spark, d))


@query("CH3_masked_code", "SELECT conv_id, turn, CAST(1 AS BIGINT) AS pieces FROM conversations")
def ch3(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that hold any part of a fenced block around a turn's whole text: one, unless the block is over chunk.LONG + chunk.AHEAD, which CH5 bounds."""
    turns = table(spark, d, "conversations").withColumn("text", F.concat(F.lit("Before it. ```"), F.regexp_replace(F.coalesce("text", F.lit("")), "`", ""), F.lit("``` After it.")))

    def pieces(text: str) -> list[tuple[int]]:
        start, end = text.index("```"), len(text) - len(" After it.")
        return [(sum(a < end and b > start for a, b in chunk.sentences(text)),)]

    return chunk.apply(turns, pieces, "pieces long", ["pieces"], ("conv_id", "turn"))


@query("CH4_short_sentences", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 40 + 3 < 20 THEN 1 ELSE 2 END::BIGINT AS pieces FROM documents")
def ch4(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a first one, 3 to 42 characters long with its stop and blank, and a long one: a short first one takes the next in, unless it is a bullet."""
    bullet = F.when(F.col("doc_id") % 2 == 1, "- ").otherwise("")
    first = F.concat(bullet, F.repeat(F.lit("a"), (F.col("doc_id") % 40 + 1).cast("int")), F.lit(". "))
    made = table(spark, d, "documents").select("doc_id", F.concat(first, F.lit("This one is surely long enough to stand.")).alias("text"))
    return chunk.apply(made, lambda t: [(len(chunk.sentences(t)),)], "pieces long", ["pieces"])


@query("CH5_bounded_sentences", "SELECT doc_id, true AS bounded FROM documents WHERE text <> ''")
def ch5(spark: SparkSession, d: str) -> DataFrame:
    return chunk.sentence_table(docs(spark, d)).groupBy("doc_id").agg((F.max(F.col("end") - F.col("start")) <= chunk.LONG + chunk.AHEAD).alias("bounded"))


@query("CH6_window_similarities", r"SELECT doc_id, CAST(greatest(0, ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) / 32) - 1) AS BIGINT) AS n_windows FROM documents")
def ch6(spark: SparkSession, d: str) -> DataFrame:
    return chunk.apply(docs(spark, d), lambda t: [(len(chunk.window_similarities(chunk.token_vectors(t))),)], "n_windows long", ["n_windows"])


@query(
    "CH7_local_minima",
    "WITH s AS (SELECT user_id, event_id, value, lag(value) OVER w AS before, lead(value) OVER w AS after, max(value) OVER (PARTITION BY user_id) AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, value FROM s WHERE value < before AND value < after AND value < top - 0.1",
)
def ch7(spark: SparkSession, d: str) -> DataFrame:
    return chunk.local_minima(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("CH9_semantic_cuts")
def ch9(spark: SparkSession, d: str) -> DataFrame:
    return chunk.apply(docs(spark, d), lambda t: [(c,) for c in chunk.semantic_cuts(t, chunk.sentences(t))], "cut long", ["cut"])


@query("CH8_token_chunks")
def ch8(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_table(docs(spark, d), "token")


@query("CH10_semantic_chunks")
def ch10(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_table(docs(spark, d))


@query("CH11_root_chunks", "SELECT doc_id, CAST(0 AS BIGINT) AS start, length(text) AS \"end\" FROM documents WHERE text <> ''")
def ch11(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_table(docs(spark, d)).where("level = 0").select("doc_id", "start", "end")


@query("CH12_token_estimate", "SELECT doc_id, greatest(1, n_chars // 4) AS n_tokens FROM documents")
def ch12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("n_chars")).alias("n_tokens"))


@query("CH13_chunk_graph")
def ch13(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_graph(stored(chunk.chunk_table(docs(spark, d)), "chunks"), docs(spark, d))


@query("CH13_graph_invariants", "SELECT count(*) AS roots, CAST(0 AS BIGINT) AS orphans FROM documents WHERE text <> ''")
def ch13_check(spark: SparkSession, d: str) -> DataFrame:
    graph = chunk.chunk_graph(stored(chunk.chunk_table(docs(spark, d)), "chunks"), docs(spark, d))
    return graph.agg(F.count_if(F.col("level") == 0).alias("roots"), F.count_if((F.col("level") > 0) & F.col("parent_id").isNull()).alias("orphans"))


@query("CH14_truncate_and_end", "SELECT conv_id, array_to_string(list_slice(range(turn + 5), 1, 6) || [99], ',') AS ids FROM conversations")
def ch14(spark: SparkSession, d: str) -> DataFrame:
    ids = F.sequence(F.lit(0).cast("long"), F.col("turn") + 4)
    return table(spark, d, "conversations").select("conv_id", F.array_join(mining.with_end(ids, 6, 99).cast("array<string>"), ",").alias("ids"))


@query("AG19_chunker_quality")
def ag19(spark: SparkSession, d: str) -> DataFrame:
    both = [chunk.quality(stored(chunk.chunk_table(docs(spark, d), kind), "chunks"), docs(spark, d)).withColumn("chunker", F.lit(kind)) for kind in ("semantic", "token")]
    return both[0].unionByName(both[1])


# ---- ingest

@query(
    "IN1_classify",
    "WITH b AS (SELECT doc_id AS id, text, doc_id AS seq, sha256(text) AS h FROM documents), s AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN text || ' old' ELSE text END AS text FROM documents WHERE doc_id % 2 = 1), k AS (SELECT DISTINCT sha256(text) AS h FROM s), f AS (SELECT h, min(seq) AS first FROM b GROUP BY h) SELECT b.id, CASE WHEN k.h IS NOT NULL OR b.seq > f.first THEN 'duplicate' WHEN s.id IS NOT NULL THEN 'update' ELSE 'insert' END AS action FROM b JOIN f USING (h) LEFT JOIN k ON k.h = b.h LEFT JOIN s ON s.id = b.id",
)
def in1(spark: SparkSession, d: str) -> DataFrame:
    return ingest.classified(*_batch_and_store(spark, d)).select("id", "action")


def _batch_and_store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "documents")
    batch = rows.select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("seq"))
    old = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    store = rows.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), old.alias("text"), F.array(F.lit(1.0)).alias("embedding"))
    return batch, store


@query(
    "IN1_merged_store",
    "WITH b AS (SELECT doc_id AS id, text, doc_id AS seq, sha256(text) AS h FROM documents), s AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN text || ' old' ELSE text END AS text FROM documents WHERE doc_id % 2 = 1), k AS (SELECT DISTINCT sha256(text) AS h FROM s), f AS (SELECT h, min(seq) AS first FROM b GROUP BY h), n AS (SELECT b.id, b.text FROM b JOIN f USING (h) LEFT JOIN k ON k.h = b.h WHERE k.h IS NULL AND b.seq = f.first) SELECT id, sha256(text) AS hash, false AS has_embedding FROM n UNION ALL SELECT id, sha256(text), true FROM s WHERE id NOT IN (SELECT id FROM n)",
)
def in1_merged(spark: SparkSession, d: str) -> DataFrame:
    after = ingest.merged(*_batch_and_store(spark, d))
    return after.select("id", tx.content_hash(F.col("text")).alias("hash"), F.col("embedding").isNotNull().alias("has_embedding"))


@query("IN2_deduplicate", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def in2(spark: SparkSession, d: str) -> DataFrame:
    return ingest.deduplicated(docs(spark, d), "doc_id").select("doc_id")


@query("IN3_backfill", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS missing FROM documents")
def in3(spark: SparkSession, d: str) -> DataFrame:
    store = docs(spark, d).withColumnRenamed("doc_id", "id").join(vectors(spark, d).select(F.col("doc_id").alias("id"), F.col("vector").alias("embedding")), "id", "left")
    filled = ingest.backfilled(store, lambda rows: models.apply_text_model(rows, "id", "text", "made", models.MODELS["encoder"], "array<float>"))
    return filled.agg(F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("missing"))


@query(
    "IN4_job_states",
    "WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'pending' END AS status FROM events) SELECT job_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE max_by(status, seq) END AS status FROM e GROUP BY job_id",
)
def in4(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    rows = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("event_id").alias("processed"), F.col("props").alias("message"))
    return ingest.job_states(rows).select("job_id", "status")


# ---- training data

@query("FT1_split", "SELECT doc_id, CASE WHEN ('0x' || substr(sha1('42:' || doc_id), 1, 7))::BIGINT % 100 < 1 THEN 'validation' ELSE 'train' END AS part FROM documents")
def ft1(spark: SparkSession, d: str) -> DataFrame:
    return mining.split(table(spark, d, "documents").select("doc_id"), "doc_id", 42)


@query("FT2_draw_negatives", "SELECT vec_id AS doc_id, list_transform(list_slice(list_sort(list_transform(range(vec_id + 1, vec_id + 25), lambda x: {'h': md5('42:' || vec_id || ':' || x), 'x': x})), 1, 7), lambda s: s.x) AS drawn FROM embeddings")
def ft2(spark: SparkSession, d: str) -> DataFrame:
    near = vectors(spark, d).select("doc_id", F.sequence(F.col("doc_id") + 1, F.col("doc_id") + 24).alias("negatives"))
    return near.select("doc_id", mining.draw_negatives(F.col("negatives"), F.col("doc_id"), 7, 42).alias("drawn"))


@query("FT3_bounded_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 80000")
def ft3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id")
    return rows.orderBy(rank.seeded("doc_id", 42), "doc_id").limit(80_000)


@query(
    "FT4_contrastive_loss",
    "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id, list_dot_product(a.v, p.v) / 0.05 AS pos, [list_dot_product(a.v, p.v) / 0.05, list_dot_product(a.v, n1.v) / 0.05, list_dot_product(a.v, n2.v) / 0.05] AS l FROM v a JOIN v p ON p.vec_id = a.vec_id + 1 JOIN v n1 ON n1.vec_id = a.vec_id + 2 JOIN v n2 ON n2.vec_id = a.vec_id + 3) SELECT vec_id, round(ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) + list_max(l) - pos, 6) AS loss FROM s",
)
def ft4(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = own
    for k, name in enumerate(("p", "n1", "n2"), 1):
        rows = rows.join(own.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name)), "vec_id")
    sim = lambda name: vx.dot(F.col("embedding"), F.col(name))
    return rows.select("vec_id", rounded(mining.contrastive_loss(sim("p"), F.array(sim("n1"), sim("n2")))).alias("loss"))


@query("FT5_spread_negatives", "SELECT vec_id, vec_id + 1 AS negative_1, vec_id + 2 AS negative_2, CASE WHEN label > 4 THEN vec_id + 3 END AS negative_3 FROM embeddings")
def ft5(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    negatives = F.when(F.col("label") > 4, F.array(v + 1, v + 2, v + 3)).otherwise(F.array(v + 1, v + 2))
    return table(spark, d, "embeddings").select("vec_id", negatives.alias("n")).select("vec_id", *mining.spread("n", 3))


# ---- streams

@query("SM1_event_stream", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def sm1(spark: SparkSession, d: str) -> DataFrame:
    """All events through a file stream; a sink of batches, then totals."""
    schema, source, out = table(spark, d, "events").schema, shared_path(spark, "events"), shared_path(spark, "stream")
    table(spark, d, "events").write.parquet(source)
    ev.run_available(ev.file_stream(spark, source, schema), ev.append_to(out), shared_path(spark, "offsets"))
    rows = spark.read.schema(schema).parquet(out)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), rounded(F.sum("value")).alias("total"))


@query("SM1_windowed_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def sm1_windows(spark: SparkSession, d: str) -> DataFrame:
    schema, source, out = table(spark, d, "events").schema, shared_path(spark, "events"), shared_path(spark, "windows")
    table(spark, d, "events").write.parquet(source)
    counts = ev.windowed_counts(ev.file_stream(spark, source, schema)).select(F.col("window.start").alias("day"), "event_type", "n", "total")
    offsets = shared_path(spark, "offsets")
    ev.run_available(counts, ev.append_to(out), offsets)
    ev.flush(spark, source, schema)
    ev.run_available(counts, ev.append_to(out), offsets)  # with the windows that were still open
    return spark.read.schema(counts.schema).parquet(out).select("day", "event_type", "n", rounded(F.col("total")).alias("total"))


@query("SM2_incremental_ingest", "SELECT doc_id, sha256(text) AS hash FROM documents")
def sm2(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over one checkpoint: the second takes up only the files that came after the first."""
    rows = docs(spark, d)
    source, out, offsets = shared_path(spark, "inbox"), shared_path(spark, "store"), shared_path(spark, "offsets")
    for part in (0, 1):
        rows.where(F.pmod("doc_id", F.lit(2)) == part).write.mode("append").parquet(source)
        ev.run_available(ev.file_stream(spark, source, rows.schema), ev.append_to(out), offsets)
    return spark.read.schema(rows.schema).parquet(out).select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


# ---- the agent's tables

REFUSAL = "The answer could not be found in the provided documents."


@query("AGT1_retrieve_and_page", f"WITH {BOTH}, {RRF} SELECT query_id, doc_id, rank, substr(text, 1, 6000) AS text FROM fr JOIN documents USING (doc_id) WHERE rank <= 5")
def agt1(spark: SparkSession, d: str) -> DataFrame:
    """The data flow of an agent's turn: keyword and dense lists, fused, the first page with texts."""
    page = rank.page(fused(spark, d), "query_id", 0, 5)
    return page.join(table(spark, d, "documents").select("doc_id", F.substring("text", 1, 6000).alias("text")), "doc_id").select("query_id", "doc_id", "rank", "text")


@query(
    "AGT2_answers",
    f"SELECT conv_id, turn, CASE WHEN trim(CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END) = '' THEN '{REFUSAL}' ELSE text END AS answer, array_to_string(list_filter(list_transform(string_split(' d' || conv_id || ', ,d' || turn, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS cited FROM conversations WHERE role = 'assistant'",
)
def agt2(spark: SparkSession, d: str) -> DataFrame:
    """Blank answers become the refusal; citations are split at commas, blanks dropped."""
    given = F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text"))
    listed = F.concat(F.lit(" d"), "conv_id", F.lit(", ,d"), "turn")
    cited = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.when(F.trim(given) == "", REFUSAL).otherwise(given).alias("answer"), F.array_join(cited, "|").alias("cited"))


@query("AGT3_batch_metrics", "SELECT count(*) AS questions, count(CASE WHEN n >= 4 THEN 1 END) AS gave_up, round(avg(n), 6) AS mean_turns FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def agt3(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("questions"), F.count_if(F.col("n") >= 4).alias("gave_up"), rounded(F.avg("n")).alias("mean_turns"))


@query(
    "AGT4_grounding",
    r"WITH t AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations) SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, u.w)) / len(a.w), 6) AS overlap FROM t a JOIN t u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user' AND len(a.w) > 0",
)
def agt4(spark: SparkSession, d: str) -> DataFrame:
    """Share of an answer's distinct words that the question before it holds."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(tx.blank_tokens(F.col("text"))).alias("w"))
    before = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("q"))
    pairs = rows.where("role = 'assistant'").join(before, ["conv_id", "turn"]).where(F.size("w") > 0)
    return pairs.select("conv_id", "turn", rounded(F.size(F.array_intersect("w", "q")) / F.size("w")).alias("overlap"))


@query("UD1_encoder", "SELECT count(*) AS n FROM benchmark")
def ud1(spark: SparkSession, d: str) -> DataFrame:
    made = models.apply_text_model(table(spark, d, "benchmark"), "item_id", "text", "v", models.MODELS["encoder"], "array<float>")
    return made.where(F.size("v") == models.DIMS).agg(F.count("*").alias("n"))


@query("REST_stats", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT source) FROM documents) AS sources")
def rest_stats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))
    return n.crossJoin(table(spark, d, "embeddings").agg(F.count("*").alias("vectors")))
