"""Removal of lines that occur earlier, word for word or with one word changed.

Lines are compared as sequences of words. Two lines are within one edit (a word replaced, put in
or left out) if they agree after deleting a word from one or both. So every line emits the hash
of each of its deletion variants, and equal variants meet:

* both lines without the word at the same place: one word is replaced;
* a whole line and a variant of another: one word is put in.

Only the earliest line under a key can make the others go, so that a key's lines are never paired
with each other: its earliest line comes from an aggregate, and each later line is verified
against it. A line needs no variants if it shares neither half with another line of its length
or one word more or less, as one edit leaves one half as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Steps
from .words import U, as_hash, followed, joined, mix, one_row_per_id, prefix_hash_of, span, table, texts, word_hash, words

# Lines of fewer words always stay.
MIN_WORDS = 5
ROWS_AT_ONCE = 500_000

_LINES = pa.schema(
    [("line", pa.int64()), ("rest", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("n", pa.int32()), ("sure", pa.bool_()), ("halves", pa.list_(pa.int64()))]
)
_VARIANTS = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("words", pa.string()), ("whole", pa.int64()), ("variants", pa.list_(pa.int64()))])


class _Text:
    """The lines of a slice that have words: first and last word, document and number of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.stops, row = words(data, offsets)
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        number = breaks[self.starts] - breaks[offsets[row]]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(row))
        self.row, self.number, self.size = row[self.first], number[self.first], self.last - self.first
        self.data, self.prefix = data, prefix_hash_of(word_hash(data, self.starts, self.stops))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Residues of the words from a to b."""
        return span(self.prefix, a, b)

    def written(self, lines: np.ndarray) -> pa.Array:
        """The words of the given lines (flags), joined by one space."""
        word = np.repeat(lines, self.size)
        number = np.repeat(np.cumsum(lines) - 1, self.size)
        return joined(self.data, self.starts[word], self.stops[word], number[word], int(lines.sum()))

    def halves(self) -> np.ndarray:
        """Four keys for each line: halves as the shorter and as the longer line of a pair."""
        out = []
        for base in (self.size, self.size - 1):
            half = base // 2
            for tag, a, b in ((1, self.first, self.first + half), (2, self.last - (base - half), self.last)):
                out.append(mix(as_hash(self.span(a, b)) + base.astype(U) * U(4) + U(tag)))
        return np.stack(out, axis=1).view(np.int64)


def _lines(batches):
    held, rows = [], 0
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i, _, data, offsets in texts(batch):
            t = _Text(data, offsets)
            long = t.size >= MIN_WORDS
            # 128 bits of the words themselves: equal lines are not looked at again
            digests = b"".join(xxhash.xxh3_128_digest(x) for x in t.written(long).cast(pa.binary()).to_pylist())
            line, rest = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            held.append((line, rest, ids[i + t.row[long]], t.number[long], t.size[long], t.halves()[long]))
            rows += int(long.sum())
        if rows >= ROWS_AT_ONCE:
            yield _own_repeats(held)
            held, rows = [], 0
    if rows:
        yield _own_repeats(held)


def _own_repeats(held) -> pa.RecordBatch:
    line, rest, doc, number, size, halves = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((number, doc, rest, line))
    line, rest, doc, number, size, halves = line[order], rest[order], doc[order], number[order], size[order], halves[order]
    again = np.concatenate([[False], (line[1:] == line[:-1]) & (rest[1:] == rest[:-1])])
    need = ~again
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(4 * need)]).astype(np.int32), pa.array(halves[need].ravel()))
    return table({"line": line, "rest": rest, "doc_id": doc, "line_no": number, "n": size, "sure": again, "halves": lists}, _LINES)


def _variants(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        asked = batch.column("line_nos")
        for i, j, data, offsets in texts(batch):
            t = _Text(data, offsets)
            part = asked.slice(i, j - i)
            row = np.repeat(np.arange(j - i), part.value_lengths().to_numpy(zero_copy_only=False))
            number = part.flatten().to_numpy(zero_copy_only=False)
            wanted = np.isin((t.row << 32) + t.number, (row.astype(np.int64) << 32) + number)
            first, last, size = t.first[wanted], t.last[wanted], t.size[wanted].astype(np.int64)
            begin = np.repeat(first, size)
            gone = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin
            left = followed(t.span(begin, gone), gone - begin, t.span(gone + 1, np.repeat(last, size)))
            variants = mix(as_hash(left) + np.repeat(size, size).astype(U) - U(1)).view(np.int64)
            whole = mix(as_hash(t.span(first, last)) + size.astype(U)).view(np.int64)
            text = t.written(wanted)
            yield table(
                {"doc_id": ids[i + t.row[wanted]], "line_no": t.number[wanted], "words": text, "whole": whole,
                 "variants": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(variants))},
                _VARIANTS,
            )


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether one replaced, added or removed word at most leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _verified(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32())])
    for batch in batches:
        a, b = (batch.column(c).to_pylist() for c in ("words", "first_words"))
        good = pa.array([within_one_edit(x.split(" "), y.split(" ")) for x, y in zip(a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in schema.names], schema=schema)


def repeated_lines(docs: DataFrame, steps: Steps) -> DataFrame:
    """``doc_id`` and ``line_no`` (from 0) of the lines to remove; ``docs`` has unique ids."""
    lines = steps.write(docs.mapInArrow(_lines, "line long, rest long, doc_id long, line_no int, n int, sure boolean, halves array<long>"), "lines")
    at = F.struct("doc_id", "line_no")
    mine = lines.filter("not sure")
    first = steps.write(mine.groupBy("line", "rest").agg(F.min(F.struct("doc_id", "line_no", "halves")).alias("f")).select("line", "rest", "f.*"), "first")
    own = first.select("line", "rest", F.struct("doc_id", "line_no").alias("first"))
    equal = mine.select("line", "rest", "doc_id", "line_no").join(own, ["line", "rest"]).filter(at != F.col("first")).select("doc_id", "line_no")

    halves = first.select("doc_id", "line_no", F.explode("halves").alias("half"))
    several = halves.groupBy("half").count().filter("count > 1").select("half")
    asked = halves.join(several, "half").groupBy("doc_id").agg(F.collect_set("line_no").alias("line_nos"))
    known = "doc_id long, line_no int, words string, whole long, variants array<long>"
    near = steps.write(docs.join(asked, "doc_id").mapInArrow(_variants, known), "variants")

    place = near.select("doc_id", "line_no", F.posexplode("variants").alias("p", "key"))
    replaced = place.groupBy("key", "p").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    pairs = place.join(replaced.select("key", "p", "first"), ["key", "p"]).filter(at > F.col("first")).select("doc_id", "line_no", "first")
    whole = near.select(F.col("whole").alias("key"), at.alias("line"))
    put_in = place.select("key", at.alias("variant")).join(whole, "key")
    pairs = pairs.union(put_in.filter("variant > line").select("variant.doc_id", "variant.line_no", "line"))
    shortest = place.join(whole.select("key"), "key", "left_semi").groupBy("key").agg(F.min(at).alias("first"))
    pairs = pairs.union(whole.join(shortest, "key").filter("line > first").select("line.doc_id", "line.line_no", "first")).distinct()
    text = near.select("doc_id", "line_no", "words")
    other = near.select(F.struct("doc_id", "line_no").alias("first"), F.col("words").alias("first_words"))
    close = pairs.join(text, ["doc_id", "line_no"]).join(other, "first").select("doc_id", "line_no", "words", "first_words").mapInArrow(_verified, "doc_id long, line_no int")
    gone = lines.filter("sure").select("doc_id", "line_no").union(equal).union(close.distinct())
    gone = steps.write(gone, "gone")
    steps.remove("lines", "first", "variants")
    return gone


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("emptied", pa.bool_()), ("kept", pa.string())])


def _kept(batches):
    for batch in batches:
        out = []
        for doc, text, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "gone"))):
            lines = (text or "").split("\n") if text is not None else []
            if not gone:
                out.append((doc, len(lines), 0, False, text))
                continue
            drop = set(gone)
            stay = [x for k, x in enumerate(lines) if k not in drop]
            out.append((doc, len(lines), len(drop), not any(x.encode().split() for x in stay), "\n".join(stay)))
        yield table(dict(zip(_KEPT.names, zip(*out))) if out else dict.fromkeys(_KEPT.names, []), _KEPT)


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, emptied, kept (the text that stays).

    A line goes if an earlier one (smaller doc_id, or above it in the same document) has the same
    words or differs in one word. Earlier lines count even if they go themselves. Lines of fewer than
    ``MIN_WORDS`` words stay and make no other line go. ``emptied`` marks texts that lost lines and have
    no word left. A null text stays null with no
    lines. Rows without id are left out, and of rows with one id the smallest text counts. Other
    columns are not read. An empty table gives an empty result.
    """
    steps = Steps(docs.sparkSession)
    docs = one_row_per_id(docs)
    gone = repeated_lines(docs, steps).groupBy("doc_id").agg(F.collect_list("line_no").alias("gone"))
    return docs.join(gone, "doc_id", "left").mapInArrow(_kept, "doc_id long, n_lines long, n_removed long, emptied boolean, kept string")
