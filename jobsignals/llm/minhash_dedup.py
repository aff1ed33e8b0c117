"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function; a document's sketch is its ``SKETCH`` least shingle hashes. Two sketches
together hold the least hashes of the union, so the share of those found in both estimates the
Jaccard similarity. Documents linked at 0.85 have less than ``SHARED`` of the 48 in common once in
some 10**9 borderline pairs.

Only retained values that are rare enough need lists: of two sketches that share at least half of
their values, the rarer halves (plus one) have a value in common. Links are confirmed on the full
sets.

No list is expanded into pairs. The documents of a list are compared with pivots, the members that
have the fewest shingles of their own; what is linked to a pivot is one component, and only pairs
across components remain. For those, shingles that few documents have decide: a pair that shares
none of them has at most its other shingles in common, and if that is not enough, a link needs a
rare shingle among the rarest of both documents. So the large lists only give pairs that the bound
allows, and the rest comes from lists of at most ``RARE`` documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Steps
from .words import U, gram_hash, lower, mix, one_row_per_id, table, texts, word_hash, words

SHINGLE = 5
THRESHOLD = 0.85
SKETCH = 48
# Rounds with pivots, and pivots of each list in rounds after the first one.
ROUNDS = 2
PIVOTS = 4
# Documents that have a shingle which counts as rare, at most.
RARE = 32
# A document in a list; ``own`` counts its shingles that no other listed document has.
MEMBER = ("doc_id", "n_shingles", "own", "root")

_SKETCHES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("sketch", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the distinct shingles of each document, in order of both."""
    low = lower(data)
    starts, stops, row = words(data, offsets)
    hashes = word_hash(low, starts, stops)
    grams = gram_hash(hashes, n)
    inside = np.flatnonzero(row[: len(grams)] == row[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    of, values = row[inside], grams[inside]
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    for k in range(1, n):  # texts with fewer words are one shingle
        short = np.flatnonzero(counts == k)
        if len(short):
            whole = np.zeros(len(short), dtype=U)
            for i in range(k):
                whole = whole * U(31) + hashes[first[short] + i]
            of, values = np.append(of, short), np.append(values, mix(whole + U(k)))
    values = values.view(np.int64)
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
    return of[new], values[new]


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values))


def _sketches(batches):
    for batch in batches:
        for i, j, data, offsets in texts(batch):
            of, values = shingle_sets(data, offsets)
            n = np.bincount(of, minlength=j - i)
            first = np.concatenate([[0], np.cumsum(n)])
            rank = np.arange(len(of)) - first[of]
            sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(values.view(U) + U(s)))]) for s in (1, 2)]
            a, b = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
            yield table(
                {"doc_id": batch.column("doc_id").slice(i, j - i), "n_shingles": n, "set_a": a, "set_b": b,
                 "sketch": _lists(np.minimum(n, SKETCH), values[rank < SKETCH])},
                _SKETCHES,
            )


def _sets(batches):
    for batch in batches:
        for i, j, data, offsets in texts(batch):
            of, values = shingle_sets(data, offsets)
            yield table({"doc_id": batch.column("doc_id").slice(i, j - i), "shingles": _lists(np.bincount(of, minlength=j - i), values)}, _SETS)


def _shared(a: str, b: str) -> Column:
    """How many of the least values of both sketches are in both."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(least, F.array_intersect(a, b)))


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose similarity reaches the threshold."""
    left = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b"))
    likely = (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(_shared("sketch_a", "sketch_b") * 2 >= F.least(F.size("sketch_a"), F.size("sketch_b")))
        .select("a", "b")
    )
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    percent = round(threshold * 100)
    return (
        likely.join(right, "b")
        .join(left, "a")
        .select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
        .filter(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent)
        .select("a", "b")
    )


def _pivot_pairs(lists: DataFrame, number: int, threshold: float) -> DataFrame:
    """Documents of each list with pivots from the list's largest component.

    In the first round every document is a component of its own and any pivot will do.
    """
    lot = F.struct("own", F.xxhash64("doc_id", F.lit(number)))
    if number == 0:
        pivots = lists.groupBy("value").agg(F.min_by(F.struct(*MEMBER), lot).alias("pivot"))
    else:
        parts = lists.groupBy("value", "root").agg(F.count(F.lit(1)).alias("rows"))
        major = parts.groupBy("value").agg(F.max_by("root", F.struct("rows", "root")).alias("root"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        of_major = lists.join(major.select("value", "root"), ["value", "root"])
        # the least of each of PIVOTS shares, so that the aggregate stays small
        picked = of_major.groupBy("value", F.pmod(F.xxhash64("doc_id", F.lit(-number)), F.lit(PIVOTS)).alias("share"))
        pivots = picked.agg(F.min_by(F.struct(*MEMBER), lot).alias("pivot")).select("value", "pivot")
    return _across(lists.join(pivots, "value").select(F.struct(*MEMBER).alias("x"), F.col("pivot").alias("y")), threshold)


def _rest(lists: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs that are still in different components and may be linked."""
    percent = round(threshold * 100)
    live = lists.select("doc_id", "n_shingles", "root").distinct()
    tokens = sets.join(live, "doc_id").select("doc_id", "n_shingles", "root", F.explode("shingles").alias("value"))
    rare = tokens.groupBy("value").agg(F.count(F.lit(1)).alias("count"), (F.min("root") < F.max("root")).alias("parts")).filter(f"count <= {RARE}")
    mine = tokens.join(rare, "value").groupBy("doc_id", "n_shingles", "root").agg(F.sort_array(F.collect_list(F.struct("count", "value", "parts"))).alias("rare"))
    # two sets with enough in common share one of so many that are rarest
    first = F.slice("rare", 1, F.floor(F.col("n_shingles") * (100 - percent) / 100).cast("int") + 1)
    few = mine.select(F.lit(0).cast("long").alias("own"), "doc_id", "n_shingles", "root", F.explode(first).alias("r")).filter("r.parts")
    few = few.select(F.col("r.value").alias("value"), F.struct(*MEMBER).alias("x"))
    of_few = few.join(few.withColumnRenamed("x", "y"), "value").filter("x.doc_id < y.doc_id")
    # pairs that share nothing rare: documents outside a list's largest component with all others
    bounded = lists.drop("own").join(mine.select("doc_id", F.size("rare").cast("long").alias("own")), "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    bounded = bounded.filter((F.col("n_shingles") - F.col("own")) * 100 >= F.col("n_shingles") * percent)
    parts = bounded.groupBy("value", "root").agg(F.count(F.lit(1)).alias("rows"))
    major = parts.groupBy("value").agg(F.max_by("root", F.struct("rows", "root")).alias("major"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    many = bounded.join(major.select("value", "major"), "value").withColumn("x", F.struct(*MEMBER))
    minor = many.filter("root <> major").select("value", F.col("x").alias("y"))
    of_many = many.select("value", "x").join(minor, "value")
    return _across(of_few, threshold).union(_across(of_many, threshold)).distinct()


def _across(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components that can reach the threshold."""
    most = F.least(F.col("x.n_shingles") - F.col("x.own"), F.col("y.n_shingles") - F.col("y.own"))  # in both sets
    enough = most * 100 >= (F.col("x.n_shingles") + F.col("y.n_shingles") - most) * round(threshold * 100)
    possible = pairs.filter((F.col("x.root") != F.col("y.root")) & enough)
    return possible.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents whose shingle sets have a Jaccard similarity of ``threshold`` or more are linked;
    ``component_id`` is the smallest id reachable by links and ``kept`` marks that document. A
    text without words has no shingles and no links. Rows without id are left out, and of rows
    with one id the smallest text counts. Other columns are not read. An empty table gives an empty
    result.
    """
    steps = Steps(docs.sparkSession)
    docs = one_row_per_id(docs)
    all_sketches = steps.write(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>"), "sketches")
    same_set = ["n_shingles", "set_a", "set_b"]
    heads = all_sketches.filter("n_shingles > 0").groupBy(*same_set).agg(F.min("doc_id").alias("head"))
    heads = steps.write(heads, "heads")
    # one document for each set
    sketches = all_sketches.join(heads, same_set).filter("doc_id = head").select("doc_id", "n_shingles", "sketch")
    values = sketches.select("doc_id", "n_shingles", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").count().filter("count > 1")
    frequent = values.join(shared, "value", "left").withColumn("count", F.coalesce("count", F.lit(1)))
    ranked = frequent.groupBy("doc_id", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("ranked"))
    rarest = F.expr("slice(ranked, 1, cast(floor(size(ranked) / 2) + 1 as int))")
    lists = ranked.select("doc_id", "n_shingles", F.explode(rarest).alias("r")).select("doc_id", "n_shingles", "r.value", "r.count").filter("count > 1")
    occurs = lists.groupBy("value").count().filter("count > 1").select("value")
    lists = steps.write(lists.select("doc_id", "n_shingles", "value").join(occurs, "value"), "lists")
    involved = lists.select("doc_id").distinct()
    sets = steps.write(docs.join(involved, "doc_id").mapInArrow(_sets, "doc_id long, shingles array<long>"), "sets")
    sketches = steps.write(sketches.select("doc_id", "sketch").join(involved, "doc_id"), "involved")

    single = sets.select("doc_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("count"))
    own = single.filter("count = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    lists = lists.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    lists = lists.filter((F.col("n_shingles") - F.col("own")) * 100 >= F.col("n_shingles") * round(threshold * 100))
    lists = steps.write(lists, "bounded")

    links = roots = None
    rounds = []
    for number in range(ROUNDS + 1):
        if roots is None:
            now = lists.withColumn("root", F.col("doc_id"))
        else:  # lists with documents of several components
            now = lists.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
            live = now.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("value")
            rounds.append(f"round{number}")
            now = steps.write(now.join(live, "value"), rounds[-1])
            if now.isEmpty():
                break
            lists = now.drop("root")
        pairs = _pivot_pairs(now, number, threshold) if number < ROUNDS else _rest(now, sets, threshold)
        found = steps.write(_confirmed(pairs, sketches, sets, threshold), "links")
        if roots is None or not found.isEmpty():
            links = found if links is None else links.union(found)
            roots = components(links, steps)
    steps.remove(*rounds)
    steps.remove("lists", "bounded", "sets", "involved", "links")
    # members of a set follow its first document
    result = heads.join(roots.withColumnRenamed("id", "head"), "head", "left").select(*same_set, F.coalesce("root", "head").alias("component_id"))
    rows = all_sketches.select("doc_id", *same_set).join(result, same_set, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
