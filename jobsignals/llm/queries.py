"""Registered queries of this subpackage: each operator over its whole table, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsignals.queries.registry import Query, Run, table

from . import sql
from .bpe import round_trip
from .embedding_dedup import near_vectors
from .lexical_search import ranked_search
from .line_dedup import line_dedup
from .minhash_dedup import near_duplicates
from .packing import pack
from .quality import quality_rules
from .quality_model import score_quality
from .resampling import importance_resample
from .sharding import equal_text_links, shard
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import context_limits, encoded_lengths

QUERIES: dict[str, Query] = {}


def query(name: str, check: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name`` with its check in SQL, if it has one."""

    def add(run: Run) -> Run:
        QUERIES[name] = Query(run, check)
        return run

    return add


@query("op3_substring_dedup", sql.SUBSTRING_DEDUP)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_suffix_dedup", sql.SUFFIX_DEDUP)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    kept = suffix_dedup(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return pack(encoded_lengths(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")))


@query("op4_quality_rules", sql.QUALITY)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(table(spark, sf, "documents")).drop("longest_repeat")


@query("op5_token_counts")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return context_limits(encoded_lengths(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")))


@query("op6_sharding")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    placed = shard(docs, equal_text_links(docs))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_minhash_dedup", sql.NEAR_DUPLICATES)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query("op2_line_dedup", sql.LINE_DEDUP)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_embedding_dedup", sql.NEAR_VECTORS)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


@query("op10_bpe")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    back = round_trip(table(spark, sf, "documents"), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op11_ranked_search", sql.RANKED_SEARCH)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_quality_model")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op13_resampling", sql.RESAMPLING)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    drawn = importance_resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
