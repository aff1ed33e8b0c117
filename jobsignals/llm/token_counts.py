"""Token counts of a corpus for every context limit, from the exact histogram of lengths.

Documents are encoded and aggregated by their length in tokens; everything else comes from this
table of lengths. Suffix sums over it give, for each length, how many documents and tokens are at
least that long, and so totals, quantiles and the tokens left if every document is cut there. The
sums are made in two levels, bands of lengths and lengths in a band, so that no task sees all of
them.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import one_row_per_id, table

# How the tokenizer splits text (fixed).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Lengths in a band.
BAND = 1024


def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``length``, the number of tokens of the whole text.

    ``path`` is a file of merge ranks; executors read it too. Names of special tokens in a text count as
    ordinary text. A null text has no tokens. Rows without id are left out, and of rows with one
    id the smallest text counts.
    """

    def count(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("length", pa.int64())])
        encoding = _encoding(path)
        for batch in batches:
            lengths = [len(encoding.encode_to_numpy(t, disallowed_special=())) if t else 0 for t in batch.column("text").to_pylist()]
            yield table({"doc_id": batch.column("doc_id"), "length": np.array(lengths, np.int64)}, schema)

    return one_row_per_id(docs).mapInArrow(count, "doc_id long, length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``length`` and ``n_docs``."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs, taken as a context limit.

    ``n_docs`` have that length; ``docs_at_least`` and ``tokens_at_least`` are sums over this and
    greater lengths, ``docs_at_most`` and ``tokens_at_most`` over this and smaller ones.
    ``truncated_tokens`` is what stays of the corpus if documents are cut at the limit. An empty
    table gives an empty result.
    """
    rows = histogram(lengths).withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("band", F.floor(F.col("length") / BAND))
    later = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("band").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("sum"))
    # one row for each BAND lengths: the longest text sets how many there are
    above = bands.select("band", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_above") for c in ("docs", "sum")])
    all_ = bands.agg(F.struct(F.sum("docs").alias("total_docs"), F.sum("sum").alias("total_tokens")))
    inside = Window.partitionBy("band").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.join(above, "band").withColumn("all", all_.scalar()).select(
        "length", "n_docs", "tokens", "all.total_docs", "all.total_tokens",
        (F.sum("n_docs").over(inside) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("sum_above")).alias("tokens_at_least"),
    )
    return sums.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("tokens")).alias("tokens_at_most"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        "total_docs", "total_tokens",
    )


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """``truncated_tokens`` for any limit, from the smallest length at or above it."""
    at = limits.filter(F.col("length") >= limit).agg(F.min_by(F.struct("tokens_at_most", "docs_at_least", "length", "n_docs"), "length").alias("a"))
    everything = limits.agg(F.max("total_tokens"))
    shorter = F.col("a.tokens_at_most") - F.col("a.length") * F.col("a.n_docs")
    return at.select(F.coalesce(shorter + F.lit(limit) * F.col("a.docs_at_least"), everything.scalar(), F.lit(0)).alias("truncated_tokens"))


def quantiles(limits: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For each share the smallest length that at least this share of documents does not exceed."""
    picks = [F.min(F.when(F.col("docs_at_most") >= F.lit(float(q)) * F.col("total_docs"), F.col("length"))) for q in shares]
    return limits.agg(F.array(*picks).alias("l")).select(F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in shares]).alias("share"), F.col("l").alias("length"))).alias("x")).select("x.*")
