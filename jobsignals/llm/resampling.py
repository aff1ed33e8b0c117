"""Importance resampling towards a target: the documents that look most like a target collection.

Words and pairs of neighbouring words are features, hashed into a fixed number of buckets. A bucket's
gain compares how often the target and the collection have it; a document's weight is the mean gain of
its features, looked up in an array. Perturbed by a draw that depends on the id alone, the weight becomes
a score, and the highest scores are a sample without replacement.

The cut-off is found by bisection: jobs over the written scores count how many documents lie above each
of some thresholds, exactly, first among scores and then among the ids that tie at the last one. No
document is sorted that is not drawn; the drawn ones are range-partitioned for their ranks.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Steps
from .words import distinct_words, lower, one_row_per_id, table, texts, words

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
# Thresholds that one job counts.
WAYS = 16

# ASCII letters and digits, and any other character above ASCII, make words.
_SEPARATES = np.ones(256, bool)
_SEPARATES[128:] = False
_SEPARATES[[b for b in range(128) if chr(b).isalnum()]] = False

_COUNTS = pa.schema([("bucket", pa.int32()), ("count", pa.int64())])
_WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of every feature, and the number of words of each document."""
    low = lower(data)
    starts, stops, row = words(low, offsets, _SEPARATES)
    code, known = distinct_words(low, starts, stops)
    known = known.to_pylist()
    sums = [zlib.crc32(w) for w in known]
    opened = [zlib.crc32(b" ", s) for s in sums]
    inside = np.flatnonzero(row[1:] == row[:-1])
    pairs, which = np.unique(code[inside] * max(len(known), 1) + code[inside + 1], return_inverse=True)
    left, right = np.divmod(pairs, max(len(known), 1))
    of_pairs = np.array([zlib.crc32(known[b], opened[a]) for a, b in zip(left.tolist(), right.tolist())], np.int64)
    bucket = np.concatenate([np.array(sums, np.int64)[code], of_pairs[which]]) % buckets
    return np.concatenate([row, row[inside]]), bucket, np.bincount(row, minlength=len(offsets) - 1)


def _counted(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in texts(batch):
                total += np.bincount(features(data, offsets, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield table({"bucket": some, "count": total[some]}, _COUNTS)

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column ``text``) fall into each bucket."""
    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(buckets), "bucket int, count long")
    out = np.zeros(buckets, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("count").alias("count")).collect():  # one row per bucket
        out[r["bucket"]] = r["count"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored log ratio of the smoothed shares of each bucket, in thousandths."""
    n = len(source)
    all_source, all_target = int(source.sum()) + n, int(target.sum()) + n
    ratio = ((t + 1) * all_source / ((s + 1) * all_target) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weighed(gain: np.ndarray):
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in texts(batch):
                of, bucket, n_words = features(data, offsets, len(gain))
                n = np.bincount(of, minlength=j - i)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, of, gain[bucket])
                yield table({"doc_id": batch.column("doc_id").slice(i, j - i), "n_words": n_words, "n_features": n, "weight": total // np.maximum(n, 1)}, _WEIGHTS)

    return run


def perturbation(seed: int = SEED) -> Column:
    """A draw for each doc_id from the Gumbel distribution, floored in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _last_value(rows: DataFrame, column: str, wanted: int) -> int:
    """The least value v for which at least ``wanted`` rows have ``column`` <= v.

    Each job counts the rows up to each of ``WAYS`` values between the bounds; ``wanted`` is from 1 to
    the number of rows.
    """
    ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    low, high = ends.a, ends.b
    while low < high:
        points = sorted({low + (high - low) * k // WAYS for k in range(WAYS)})  # all below ``high``
        counts = rows.agg(*[F.count(F.when(F.col(column) <= p, 1)).alias(f"c{k}") for k, p in enumerate(points)]).first()
        enough = [p for p, c in zip(points, counts) if c >= wanted]
        short = [p for p, c in zip(points, counts) if c < wanted]
        high = enough[0] if enough else high
        low = short[-1] + 1 if short else low
    return low


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, and rank where it is drawn.

    Of the documents with at least ``min_words`` words, ``percent`` of a hundred (rounded down) with the
    highest scores are drawn; equal scores go by smaller doc_id. ``target`` is a table with a column
    ``text``. Null and empty texts have no features, weight 0 and are never drawn. Rows without
    doc_id are left out, and of rows with one id the smallest text counts; all rows of ``target``
    count. Other columns are not read. An empty table gives an empty result, an empty target one in
    which only the collection decides.
    """
    steps = Steps(docs.sparkSession)
    docs = one_row_per_id(docs)
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    weighed = docs.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = steps.write(weighed.withColumn("score", F.col("weight") + perturbation(seed)), "scores")
    able = scored.filter(F.col("n_words") >= min_words).select("doc_id", (-F.col("score")).alias("down"))
    draw = able.count() * percent // 100
    if not draw:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    cut = _last_value(able, "down", draw)
    tied = able.filter(F.col("down") == cut)
    left = draw - able.filter(F.col("down") < cut).count()
    last = _last_value(tied, "doc_id", left)
    drawn = able.filter((F.col("down") < cut) | ((F.col("down") == cut) & (F.col("doc_id") <= last)))
    # the number of a row in its range: ids count up from 0 in each partition
    ordered = drawn.repartitionByRange("down", "doc_id").sortWithinPartitions("down", "doc_id").select("doc_id", F.monotonically_increasing_id().alias("place"))
    ordered = steps.write(ordered, "drawn").select("doc_id", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at"))
    sizes = sorted(map(tuple, ordered.groupBy("part").count().collect()))  # one row per partition
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    offsets = docs.sparkSession.createDataFrame([(p, b + 1) for (p, _), b in zip(sizes, before)], "part long, first long")
    ranks = ordered.join(F.broadcast(offsets), "part").select("doc_id", (F.col("first") + F.col("at")).alias("rank"))
    return scored.join(ranks, "doc_id", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
