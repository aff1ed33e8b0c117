"""From raw documents to packed training sequences: quality, deduplication, packing.

Every stage takes the documents that the stage before it kept, and all but the last return
documents with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignals.llm.line_dedup import line_dedup
from jobsignals.llm.minhash_dedup import near_duplicates
from jobsignals.llm.packing import pack
from jobsignals.llm.quality import quality_rules
from jobsignals.llm.scratch import Steps
from jobsignals.llm.suffix_dedup import suffix_dedup
from jobsignals.llm.token_counts import encoded_lengths
from jobsignals.queries.registry import Query, table


# Similarity from which two documents count as near copies.
NEAR = 0.8


def _once(docs: DataFrame) -> DataFrame:
    """Rows with an id, one for each: of several the one with the smallest text, null first."""
    docs = docs.filter("doc_id is not null")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs
    rest = F.struct(*[c for c in docs.columns if c != "doc_id"])
    order = F.struct(F.col("text").isNotNull(), F.col("text"), F.to_json(rest))
    return docs.groupBy("doc_id").agg(F.min_by(rest, order).alias("r")).select("doc_id", "r.*").select(*docs.columns)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return _once(docs).join(ids.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def _with_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The documents of ``texts`` (doc_id, kept) with that text and its length."""
    new = _once(docs).drop("text", "n_chars").join(texts.select("doc_id", F.col("kept").alias("text")), "doc_id")
    return new.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


# In every stage rows without id go, and of rows with one id that with the smallest text counts (null
# first); other columns go along with it. An empty table gives an empty one.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts don't."""
    return _only(docs, quality_rules(docs).filter("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier; those that lose their last word go.

    Null and empty texts stay as they are.
    """
    return _with_text(docs, line_dedup(docs).filter("not emptied"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null texts and those without words stay."""
    return _only(docs, near_duplicates(docs, NEAR).filter("kept"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that occur earlier; those left empty go.

    A cut may go through a character; what is left of it goes too. Null texts become empty.
    """
    return _with_text(docs, suffix_dedup(docs, as_text=True).filter("n_removed < n_bytes or n_bytes = 0"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token-budget batches; null and empty texts are a piece of one end mark."""
    return pack(encoded_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("passages", passages), ("packing", packing)]

# Edit distances, components and the choice of buckets are beyond SQL: tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    steps = Steps(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = steps.write(docs, name)
    return docs


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
