"""BM25 over an inverted index of (term, doc_id, tf) with document lengths.

An index is stored once, sorted by term, and read by every query after that.
Only postings of terms that some query asks for are kept before the
aggregation, so what is shuffled follows the queries, not the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import rank

#: Terms asked for, up to which their table is broadcast; a larger one is joined by shuffle.
BROADCAST_TERMS = 1_000_000
METHODS = ("lucene", "robertson", "atire", "bm25l", "bm25+")


def tokenised(docs: DataFrame, tokens: Column, ident: str = "doc_id") -> DataFrame:
    """doc_id, tokens, dl."""
    return docs.select(F.col(ident).alias("doc_id"), tokens.alias("tokens")).withColumn("dl", F.size("tokens"))


def full_tokens(text: Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Lower-cased words of two letters or more that are no stop words (the list of query cleaning, if none is given)."""
    stops = tx.is_stop_word if stop_words is None else lambda t: t.isin(*stop_words) if stop_words else F.lit(False)
    return F.filter(F.split(F.lower(text), tx.BETWEEN_WORDS), lambda t: (F.length(t) >= 2) & ~stops(t))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl) of tokenised documents."""
    return docs.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


@dataclass
class Index:
    """Stored postings (term, doc_id, tf, dl), number of documents and their mean length."""

    postings: DataFrame
    n_docs: int
    avgdl: float

    @classmethod
    def of(cls, docs: DataFrame) -> Index:
        """An index of tokenised documents that is not stored: each query of it makes it again."""
        n_docs, avgdl = docs.agg(F.count("*"), F.avg("dl")).first()
        return cls(postings(docs), n_docs, float(avgdl or 1.0))

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> Index:
        """Write the index of tokenised documents: one scan of the texts, whose lengths are kept beside the postings."""
        per = docs.select("doc_id", "dl", "tokens")
        rows = postings(per).unionByName(per.select(F.lit(None).cast("string").alias("term"), "doc_id", "dl", F.lit(0).cast("long").alias("tf")))
        rows.repartition("term", F.when(F.col("term").isNull(), F.col("doc_id"))).sortWithinPartitions("term", "doc_id").write.parquet(path)
        return cls.load(docs.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """A stored index; a row without a term stands for each document."""
        rows = spark.read.schema("term string, doc_id long, dl int, tf long").parquet(path)
        n_docs, avgdl = rows.where("term is null").agg(F.count("*"), F.avg("dl")).first()
        return cls(rows.where("term is not null"), n_docs, float(avgdl or 1.0))


def score(docs: DataFrame | Index, terms: DataFrame, k1: float = 1.5, b: float = 0.75, method: str = "lucene", delta: float | None = None, repeat_terms: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score) of an index, or of tokenised documents, for (query_id, term), scores above 0.

    A term that a query repeats counts once, or as often as it is there.
    """
    index = docs if isinstance(docs, Index) else Index.of(docs)
    n_docs, avgdl = index.n_docs, index.avgdl
    asked = terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    if isinstance(docs, Index):
        n = wanted.count()
        wanted = F.broadcast(wanted) if n <= BROADCAST_TERMS else wanted
    posts = index.postings.join(wanted, "term", "left_semi")
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    rows = posts.join(df, "term").join(asked, "term")
    delta = {"bm25l": 0.5, "bm25+": 1.0}.get(method, 0.0) if delta is None else delta
    n, f, length = F.col("df"), F.col("tf"), k1 * (1 - b + b * F.col("dl") / F.lit(avgdl))
    smooth = F.log(1 + (n_docs - n + 0.5) / (n + 0.5))
    parts = {
        "pool": F.greatest(F.lit(0.0), smooth) * f * (k1 + 1) / (f + length),
        "lucene": smooth * f / (f + length),
        "robertson": F.greatest(F.lit(0.0), F.log((n_docs - n + 0.5) / (n + 0.5))) * f * (k1 + 1) / (f + length),
        "atire": F.log(n_docs / n) * f * (k1 + 1) / (f + length),
        "bm25l": F.log((n_docs + 1) / (n + 0.5)) * (k1 + 1) * (f * k1 / length + delta) / (k1 + f * k1 / length + delta),
        "bm25+": F.log((n_docs + 1) / n) * (delta + f * (k1 + 1) / (f + length)),
    }
    value = parts[method] * (F.col("times") if repeat_terms else F.lit(1))
    total = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(value), digits).alias("score"))
    return total.where("score > 0")


def pool_score(pool: DataFrame, docs: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 whose statistics are those of each query's own candidate pool (query_id, doc_id): blank tokens of the first 2000 characters."""
    tokens = tx.blank_tokens(tx.truncated(F.col("text")))
    members = pool.select("query_id", "doc_id").distinct().join(docs.select("doc_id", tokens.alias("tokens")), "doc_id").withColumn("dl", F.size("tokens"))
    stats = members.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    asked = terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    tf = members.select("query_id", "doc_id", "dl", F.explode("tokens").alias("term")).join(asked, ["query_id", "term"]).groupBy("query_id", "doc_id", "dl", "term", "times").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    rows = tf.join(df, ["query_id", "term"]).join(stats, "query_id")
    idf = F.greatest(F.lit(0.0), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(part * F.col("times")), 6).alias("score")).where("score > 0")


def light_stem(term: Column) -> Column:
    """An approximation of English stemming: plural, -ing, -ed, -ly and -e endings."""
    return F.regexp_replace(term, "(?<=[a-z]{3})(?:ies|es|s|ing|ed|ly|e)$", "")


def full_text(docs: DataFrame, questions: DataFrame, limit: int = 3000) -> DataFrame:
    """Full-text search: any stemmed term matches; more terms close together rank higher (simplified cover density), scaled to rank/(rank+1)."""
    stems = F.transform(full_tokens(F.col("text")), light_stem)
    placed = docs.select("doc_id", F.posexplode(stems).alias("pos", "term"))
    asked = questions.select("query_id", F.explode(F.array_distinct(F.transform(tx.query_terms(F.col("text")), light_stem))).alias("term"))
    hits = placed.join(asked, "term").groupBy("query_id", "doc_id").agg(F.count_distinct("term").alias("terms"), F.count("*").alias("hits"), (F.max("pos") - F.min("pos") + 1).alias("cover"))
    density = F.col("terms") * F.col("hits") / F.sqrt(F.col("cover").cast("double"))
    return rank.top_k(hits.withColumn("score", F.round(density / (density + 1), 9)), "query_id", "score", "doc_id", limit).select("query_id", "doc_id", "score", "rank")
