"""Token-budget batches from optimal length buckets.

Documents longer than the context are cut into pieces, so that the histogram of lengths has at
most ``context`` rows, whatever the number of documents. Dynamic programming over it chooses the
bucket boundaries with the least padding. A batch then holds as many pieces of one bucket as fit
the token budget when all are padded to the bucket's boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Steps

CONTEXT = 2048
BUCKETS = 16
BUDGET = 65_536
# Pieces that are numbered in one task, on average.
ROWS_PER_GROUP = 2_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` boundaries, the last one the greatest length, with the least padding."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(lengths)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    # cost[j] of the first j lengths in k buckets; came[k][j]: where the last bucket begins
    cost = np.concatenate([[0.0], np.full(n, np.inf)])
    came = []
    for _ in range(min(buckets, n)):
        step, begin = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            padding = cost[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            begin[j] = np.argmin(padding)
            step[j] = padding[begin[j]]
        came.append(begin)
        cost = step
    out, j = [], n
    for begin in reversed(came):
        if j:
            out.append(int(lengths[j - 1]))
            j = begin[j]
    return out[::-1]


def pack(lengths: DataFrame, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket_tokens, batch, slot.

    ``lengths`` has doc_id and ``length``, the tokens of a text. A mark that ends the document follows
    them, so that no document is empty; a null length counts as 0. Piece
    p of a document starts at token p * ``context``. ``batch`` numbers the batches of the bucket
    ``bucket_tokens`` from 0, ``slot`` the pieces in a batch; only the last batch of a bucket is not
    full. Every row of the input is packed, rows with equal or null ids like any others. An empty
    table gives an empty result. Other columns are not read.
    """
    if budget < context:
        raise ValueError("the token budget must hold one full context")
    # rows are numbered, so that those without id or with one id are dealt out like others
    size = (F.coalesce(F.col("length"), F.lit(0)) + 1).cast("long").alias("size")
    rows = Steps(lengths.sparkSession).write(lengths.select("doc_id", size, F.monotonically_increasing_id().alias("row")), "lengths")
    last = ((F.col("size") - 1) / context).cast("long")
    pieces = rows.select("doc_id", "row", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "doc_id", "row", "piece", (F.col("piece") * context).alias("start"), F.least(F.lit(context).cast("long"), F.col("size") - F.col("piece") * context).alias("n_tokens")
    )
    histogram = pieces.groupBy("n_tokens").count().collect()  # at most ``context`` rows
    lengths, counts = (np.array([r[k] for r in histogram], np.int64) for k in (0, 1))
    bounds = boundaries(lengths, counts, buckets) if histogram else [context]
    low, groups = 0, []
    for b in bounds:
        groups.append(max(1, int(counts[(lengths > low) & (lengths <= b)].sum()) // ROWS_PER_GROUP))
        low = b
    number = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("n_tokens")))  # of the bucket

    def of_bucket(values):
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)

    lot = F.xxhash64("row", "piece")
    dealt = pieces.withColumn("bucket", number).withColumn("part", F.pmod(lot, of_bucket(groups)))
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("bucket", "part").count().select("bucket", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "part").orderBy(lot, "row", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["bucket", "part"])
    rank = F.col("rank") + F.col("before")
    per_batch = of_bucket([budget // b for b in bounds])
    return ranked.select(
        "doc_id", "piece", "start", "n_tokens", of_bucket(bounds).alias("bucket_tokens"),
        F.floor(rank / per_batch).cast("long").alias("batch"), F.pmod(rank, per_batch).alias("slot"),
    )


def packed_tokens(packed: DataFrame, encoded: DataFrame, end: int) -> DataFrame:
    """``packed`` with ``tokens``, the ids of each piece; ``encoded`` has doc_id, once, and ``ids``.

    ``end`` is the id of the mark that ends a document. A document without ids has the mark only.
    """
    ids = encoded.select("doc_id", F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(end))).alias("ids"))
    joined = packed.join(ids, "doc_id")
    return joined.withColumn("tokens", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int"))).drop("ids")
