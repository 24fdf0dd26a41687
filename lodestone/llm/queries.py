"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import archives
from lodestone.llm.common import table
from lodestone.llm.decontaminate import find_leaks
from lodestone.llm.hmm import score_documents
from lodestone.llm.language import predict_languages
from lodestone.llm.lexicon import digest_documents
from lodestone.llm.licenses import scan_licenses
from lodestone.llm.maxscore import top_k
from lodestone.llm.quality import score_quality
from lodestone.llm.simhash import component_table
from lodestone.llm.tokenfile import round_trip


def vocabulary_path() -> str:
    """Where the public tokenizer file of the token operators lies; a parameter of theirs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_table(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_maxscore": op2_maxscore,
        "op3_simhash": op3_simhash,
        "op4_license_scan": op4_license_scan,
        "op5_hmm": op5_hmm,
        "op6_quality": op6_quality,
        "op7_token_file": op7_token_file,
        "op8_decontaminate": op8_decontaminate,
        "op9_language": op9_language,
        "op10_bpe": op10_bpe,
    }


OP1_SQL = """
WITH p AS (
    SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (
    SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN k.keeper > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.keeper > p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000
"""

OP2_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """The contracts that SQL can state; the others are tested against brute force."""
    return {"op1_warc": OP1_SQL, "op2_maxscore": OP2_SQL}
