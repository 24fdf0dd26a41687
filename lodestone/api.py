"""The engine's verbs over one store: health, ingest, dedup, embed, rebuild, query, tree, node, documents, stats.

A store is a folder that driver and executors share. Each change writes a new
version of a table beside the old one, so a reader is never disturbed and a
lost executor costs a task, not the store; a version counts once its write has
been committed. Verbs that answer with many rows return DataFrames; those that
answer with one row return a dictionary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import bm25, cluster, dense, fusion, ingest, models, rank, tree
from lodestone.session import prepare

SCHEMAS = {
    "documents": "id long, text string, embedding array<float>",
    "nodes": "node_id string, parent_id string, depth int, doc_count long, is_leaf boolean",
    "members": "node_id string, doc_id long",
    "jobs": "job_id long, seq long, status string, processed long, message string",
}
#: Most rows of a page of documents, and of an answer.
PAGE, MOST = 1000, 20_000


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")
        self._index: tuple[int, bm25.Index] | None = None

    # ---- versions of tables

    def _version(self, name: str) -> int:
        """The last committed version; 0 if there is none."""
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/v*/_SUCCESS")
        found = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(there)
        return max((int(f.getPath().getParent().getName()[1:]) for f in found or []), default=0)

    def table(self, name: str) -> DataFrame:
        n = self._version(name)
        if not n:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/v{n}")

    def _write(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        kinds = [c.split()[1] for c in SCHEMAS[name].split(", ")]
        rows.select(*[F.col(c).cast(k) for c, k in zip(columns, kinds, strict=True)]).write.parquet(f"{self.folder}/{name}/v{self._version(name) + 1}")

    # ---- verbs

    def health(self) -> dict:
        return {"status": "ok", "documents": self.table("documents").count(), "nodes": self.table("nodes").count()}

    def ingest(self, batch: DataFrame, order: str = "id") -> dict:
        """Take in (id, text): duplicates of a text go, a known id gets its new text and loses its embedding. The first by `order` of equal texts stays."""
        job = 1 + (self.table("jobs").agg(F.max("job_id")).first()[0] or 0)
        rows = batch.select("id", F.coalesce("text", F.lit("")).alias("text"), F.col(order).alias("seq"))
        store = self.table("documents")
        made = ingest.counts(ingest.classified(rows, store)).first().asDict()
        self._write("documents", ingest.merged(rows, store))
        state = [(job, 1, "processing", 0, None), (job, 2, "completed", made["inserted"] + made["updated"], None)]
        self._write("jobs", self.table("jobs").unionByName(self.spark.createDataFrame(state, SCHEMAS["jobs"])))
        return {"job_id": job, "status": "completed", **made}

    def ingest_status(self, job_id: int) -> dict:
        found = ingest.job_states(self.table("jobs").where(F.col("job_id") == job_id)).first()
        if found is None:
            raise LookupError(f"no job {job_id}")
        return found.asDict()

    def dedup(self) -> dict:
        """Remove later copies of a text; the smallest id stays."""
        rows = self.table("documents")
        kept = ingest.deduplicated(rows, "id")
        total, unique = rows.count(), kept.count()
        if unique < total:
            self._write("documents", kept)
        return {"total": total, "removed": total - unique, "unique": unique}

    def embed(self) -> int:
        """Fill in missing embeddings by the registered encoder; how many were missing."""
        rows = self.table("documents")
        missing = rows.where("embedding is null").count()
        if missing:
            self._write("documents", ingest.backfilled(rows, lambda part: models.apply_text_model(part, "id", "text", "made", models.MODELS["encoder"], "array<float>")))
        return missing

    def rebuild(self, leaf_size: int = 100) -> DataFrame:
        """Build the tree anew from all embeddings; (node_id, event) against the tree before."""
        self.embed()
        rows, before = self.table("documents").select(F.col("id").alias("doc_id"), F.col("embedding").alias("vector")), self.table("nodes")
        if rows.isEmpty():
            raise LookupError("the store is empty")
        levels = f"{self.folder}/levels-{self._version('nodes') + 1}"
        made = []

        def cut(df: DataFrame, name: str) -> DataFrame:
            made.append(f"{levels}/{len(made)}-{name}")
            df.write.mode("overwrite").parquet(made[-1])
            return self.spark.read.schema(df.schema).parquet(made[-1])

        nodes, members = cluster.build_tree(rows, cut, leaf_size)
        self._write("nodes", nodes)
        self._write("members", members)
        return cluster.change_events(before, self.table("nodes"))

    def _keyword_index(self) -> bm25.Index:
        version = self._version("documents")
        if self._index is None or self._index[0] != version:
            docs = self.table("documents").select(F.col("id").alias("doc_id"), "text")
            self._index = version, bm25.Index.build(bm25.tokenised(docs, bm25.full_tokens(F.col("text"))), f"{self.folder}/index/{version}-{self.spark.sparkContext.applicationId}")
        return self._index[1]

    def query(self, question: str, k: int = 10) -> DataFrame:
        """doc_id, score, rank, preview: keyword and dense lists fused by reciprocal rank; k is held to 1..MOST."""
        k = max(1, min(k, MOST))
        docs = self.table("documents")
        if docs.isEmpty():
            raise LookupError("the store is empty")
        asked = self.spark.createDataFrame([(0, question)], "query_id long, text string")
        terms = asked.select("query_id", F.explode(bm25.full_tokens(F.col("text"))).alias("term"))
        words = rank.top_k(bm25.score(self._keyword_index(), terms), "query_id", "score", "doc_id", k)
        vector = models.MODELS["encoder"]([question])[0].tolist()
        asking = self.spark.createDataFrame([(0, vector)], "query_id long, vector array<double>")
        near = dense.top_k(docs.where("embedding is not null").select(F.col("id").alias("doc_id"), F.col("embedding").alias("vector")), asking, k)
        best = fusion.rrf({"dense": near, "text": words}).where(F.col("rank") <= k)
        return best.join(docs.select(F.col("id").alias("doc_id"), tx.preview(F.col("text")).alias("preview")), "doc_id").select("doc_id", "score", "rank", "preview")

    def tree(self, deepest: int = 8, top: int = 1000) -> DataFrame:
        """Edges (source, target, depth) among the largest nodes."""
        return tree.view(self.table("nodes"), deepest, top, "doc_count")

    def node(self, node_id: str) -> dict:
        found = self.table("nodes").where(F.col("node_id") == node_id).first()
        if found is None:
            raise LookupError(f"no node {node_id}")
        return found.asDict()

    def node_documents(self, node_id: str) -> DataFrame:
        """doc_ids of the leaves at or below a node."""
        below = (F.col("node_id") == node_id) | F.startswith("node_id", F.lit(f"{node_id}."))
        return self.table("members").where(below).select("doc_id")

    def stats(self) -> dict:
        docs, nodes = self.table("documents"), self.table("nodes")
        one = docs.agg(F.count("*").alias("documents"), F.count("embedding").alias("embedded")).first().asDict()
        return one | nodes.agg(F.count("*").alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.max("depth").alias("depth")).first().asDict()

    def documents(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """A page by id: id, preview."""
        if not 1 <= limit <= PAGE or offset < 0:
            raise ValueError(f"limit must be in 1..{PAGE} and offset not negative")
        return self.table("documents").orderBy("id").offset(offset).limit(limit).select("id", tx.preview(F.col("text")).alias("preview"))

    def document(self, ident: int) -> dict:
        found = self.table("documents").where(F.col("id") == ident).select("id", "text").first()
        if found is None:
            raise LookupError(f"no document {ident}")
        return found.asDict()
