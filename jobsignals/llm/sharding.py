"""Shards of even size that keep linked documents together, by balanced label propagation.

Every document starts in a shard by a hash of its id. In each round half of the linked documents,
drawn anew, look where most of their neighbours are and ask to move there. Quotas admit as many
moves from s to t as there are from t to s, and more until the linked documents alone fill t's
even share. Rounds end when the quotas would admit few of the moves that all documents want.
At the end rows above a shard's share go to shards below it, those without links first: they can
go anywhere, so that evening out cuts no link. Everything is DataFrame code; what reaches the
driver are tables of shards, at most their number squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Steps

SHARDS = 24
# Rounds at most. They end before when at most one in SETTLED linked documents can still move.
ROUNDS = 20
SETTLED = 1_000
# Documents that are numbered in one task, on average.
ROWS_PER_GROUP = 2_000


def equal_text_links(docs: DataFrame) -> DataFrame:
    """Links (a, b) from each document to the first one with the same text."""
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", F.sha2("text", 256).alias("same"))
    first = rows.groupBy("same").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return rows.join(first.select("same", "a"), "same").filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))


def _start(shards: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")


def _accept(asked: dict[tuple[int, int], int], load: list[int], room: float) -> dict[tuple[int, int], float]:
    """Share of the moves from s to t that are admitted."""
    out = {}
    free = [max(0.0, room - x) for x in load]
    for (s, t), n in asked.items():
        swap = min(n, asked.get((t, s), 0))
        out[s, t] = float(swap)
    for (s, t), n in sorted(asked.items()):
        more = min(n - out[s, t], free[t])
        out[s, t] += more
        free[t] -= more
    return {k: v / asked[k] for k, v in out.items()}


def propagate(docs: DataFrame, links: DataFrame, steps: Steps, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shard of every linked document: doc_id, label."""
    both = links.select(F.col("a").alias("doc_id"), F.col("b").alias("other"))
    both = steps.write(both.union(both.select("other", "doc_id")), "links")
    labels = steps.write(both.select("doc_id").distinct().withColumn("label", _start(shards)), "labels")
    room = docs.count() / shards
    for number in range(rounds):
        now = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
        load = [now.get(s, 0) for s in range(shards)]
        neighbour = labels.select(F.col("doc_id").alias("other"), F.col("label").alias("wanted"))
        votes = both.join(neighbour, "other").groupBy("doc_id", "wanted").agg(F.count(F.lit(1)).alias("votes"))
        tally = votes.join(labels, "doc_id").groupBy("doc_id", "label").agg(
            F.max(F.struct("votes", "wanted")).alias("best"), F.sum(F.when(F.col("wanted") == F.col("label"), F.col("votes")).otherwise(0)).alias("here")
        )
        turn = F.pmod(F.xxhash64("doc_id", F.lit(number), F.lit(7)), F.lit(2)) == 0
        wanting = steps.write(tally.filter("best.votes > here").select("doc_id", "label", F.col("best.wanted").alias("wanted"), turn.alias("turn")), "wanting")
        counts = wanting.groupBy("label", "wanted").agg(F.count(F.lit(1)), F.count_if("turn")).collect()
        wanted = {(r[0], r[1]): r[2] for r in counts}
        if sum(n * wanted[k] for k, n in _accept(wanted, load, room).items()) * SETTLED <= sum(load):
            break
        asked = {(r[0], r[1]): r[3] for r in counts if r[3]}
        if not asked:
            continue
        share = _accept(asked, load, room)
        quota = F.create_map(*[x for (s, t), v in share.items() for x in (F.lit(s * shards + t), F.lit(v))])
        lot = F.pmod(F.xxhash64("doc_id", F.lit(number)), F.lit(1 << 30)) / float(1 << 30)
        moved = wanting.filter(F.col("turn") & (lot < quota[F.col("label") * shards + F.col("wanted")])).select("doc_id", F.col("wanted").alias("next"))
        labels = steps.write(labels.join(moved, "doc_id", "left").select("doc_id", F.coalesce("next", "label").alias("label")), "labels")
    return labels


def shard(docs: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``size`` and ``text_crc32`` with ``shard`` and ``slot``, numbered from 0.

    The numbers of rows of any two shards differ by one at most. Every row is placed, also
    rows with equal or null ids; a null text counts as empty. An empty table gives an empty result.
    ``links`` (a, b) names ids; other columns of ``docs`` than doc_id and text are not read.
    """
    steps = Steps(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = steps.write(rows, "rows")
    labels = propagate(rows, links, steps, shards, rounds)
    placed = rows.join(labels, "doc_id", "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("label", _start(shards)).alias("label"), F.col("label").isNull().alias("alone")
    )
    placed = steps.write(placed, "placed")
    load = [0] * shards
    for r in placed.groupBy("label").count().collect():
        load[r[0]] = r[1]
    total = sum(load)
    # the largest shards take the rows that remain when all have an equal share
    larger = set(sorted(range(shards), key=lambda s: (-load[s], s))[: total % shards])
    share = [total // shards + (s in larger) for s in range(shards)]
    surplus, before = 0, []
    for s in range(shards):
        before.append(surplus)
        surplus += max(0, load[s] - share[s])
    lack = [max(0, share[s] - load[s]) for s in range(shards)]
    ends = [sum(lack[: s + 1]) for s in range(shards)]

    def of_shard(values: list[int], index) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)

    parts = max(1, total // (shards * ROWS_PER_GROUP))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    group = ["label", "alone", "part"]
    earlier = Window.partitionBy("label").orderBy("alone", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*group).orderBy("doc_id", "text_crc32", "size")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(first, group).withColumn("rank", F.col("rank") + F.col("before"))
    over = F.col("rank") - of_shard(share, F.col("label"))
    # number of the row among all that move, and the shard whose free places hold that number
    number = over + of_shard(before, F.col("label"))
    target = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= number))
    moves = ranked.withColumn("moves", over >= 0).withColumn("to", F.when(over >= 0, target).otherwise(F.col("label")))
    place = number - of_shard([e - x for e, x in zip(ends, lack)], F.col("to")) + of_shard(load, F.col("to"))
    return moves.select(
        "doc_id", "size", "text_crc32", F.col("to").cast("int").alias("shard"), F.when(F.col("moves"), place).otherwise(F.col("rank")).cast("long").alias("slot")
    )
