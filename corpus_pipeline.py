"""The corpus pipeline: five stages over whole documents, each reading what the one before it wrote.

Every stage but the last returns the columns of `documents` and drops rows;
the last returns the token ids of what is left. A stage learns from its own
input (and from `labels` or `benchmark`), so it behaves alike on any table.

Defined cases, of every stage: a null text counts as empty; rows with a null
doc_id stay or go like any other; repeated rows are judged each on their own
but by near_dedup, which leaves one; texts of any length are taken whole;
other columns are kept, whatever their names; an empty table gives no rows.
Texts without letters go at language_id. Without labels no document goes at
quality. The operators tell how they break ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, quality
from lodestone.llm.common import cut, table
from lodestone.llm.decontaminate import drop_leaks
from lodestone.llm.lexicon import tokenize_documents
from lodestone.llm.nearcopies import drop_near_duplicates
from lodestone.llm.queries import vocabulary_path

#: Least share of a document in its main language.
LEAST_SHARE = 0.4


def _positional(docs: DataFrame) -> DataFrame:
    """docs with names of our own, so that a column of the input is never taken for an operator's."""
    return docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those without a main language."""
    own = _positional(docs)
    named = language.identify(own, language.learn(docs), own.columns[docs.columns.index("text")])
    return named.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE)).select(*own.columns).toDF(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose neighbours are junk."""
    own = _positional(docs)
    scored = quality.classify(own, quality.fit(docs, table(spark, sf_dir, "labels")), own.columns[docs.columns.index("text")])
    return scored.where(F.col("quality_score") >= quality.THRESHOLD).select(*own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or similar documents one stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text they decode to."""
    return tokenize_documents(docs, vocabulary_path())


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]

#: No stage but the first's letters can be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
