"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Every text becomes a row of small whole numbers, its statistics on a logarithmic scale. These are the bins
of the histograms, so no pass is needed to find bin edges. A tree grows level by level; for each level one job
over the labelled rows adds up gradients by (node, statistic, bin) inside the tasks, and only those sums, whose
number does not depend on the rows, reach the driver, which picks the splits. Gradients are added as whole
numbers, so that the same rows give the same model however they are partitioned.

The finished trees are complete ones, flattened into arrays (statistic and limit of each inner node, value of
each leaf); tasks walk all rows of a batch through them at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Steps
from .words import distinct_words, one_row_per_id, table, texts, words

TREES = 24
DEPTH = 3
RATE = 0.3
# Least sum of second derivatives in a leaf, and what is added to it.
LEAST_WEIGHT = 1.0
SMOOTHING = 1.0
BINS = 64
# Gradients are rounded to so many parts of one.
PARTS = 1 << 20
# Rows with this remainder of the id's checksum are held out of the fit.
FOLDS, HELD_OUT = 3, 1

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bracket": b"()[]{}",
    "markup": b"<>|\\/",
    "symbol": b"#*$%&@^~_=+",
    "quote": b"\"'`",
    "break": b"\n",
    "space": b" \t\r\v\f",
}
STATISTICS = (
    "chars", "words", "lines", "mean_word", "longest_word", *_CLASSES, "wide", "words_end_odd", "words_upper", "words_short", "words_digit",
    "words_distinct", "words_twice_running", "commonest_word", "triples_repeated", "lines_repeated", "words_per_line", "lines_end_stop",
)

_MASKS = {name: np.isin(np.arange(256), list(chars)) for name, chars in _CLASSES.items()}
_LETTER = np.isin(np.arange(256), [b for b in range(128) if chr(b).isalpha()]) | (np.arange(256) >= 128)
_IS_BREAK = np.arange(256) == 10

_ROWS = pa.schema([("doc_id", pa.int64()), ("bins", pa.binary())])
_CELLS = pa.schema([("cell", pa.int32()), ("g", pa.int64()), ("h", pa.int64())])


def _again(row: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of distinct codes, and how often the commonest one occurs."""
    if not len(code):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    pairs, count = np.unique(row * (code.max() + 1) + code, return_counts=True)
    of, most = pairs // (code.max() + 1), np.zeros(rows, np.int64)
    np.maximum.at(most, of, count)
    return np.bincount(of, minlength=rows), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of bins for each text, in the order of ``STATISTICS``."""
    rows = len(offsets) - 1

    def within(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    def counted(of, mask):
        return np.bincount(of[mask], minlength=rows)

    starts, stops, row = words(data, offsets)
    code, _ = distinct_words(data, starts, stops)
    n = np.bincount(row, minlength=rows)
    chars = within((data & 0xC0) != 0x80)
    length = stops - starts
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, length)
    begin, end, of_line = words(data, offsets, _IS_BREAK)
    line_code, _ = distinct_words(data, begin, end)
    n_lines = np.bincount(of_line, minlength=rows)
    distinct, commonest = _again(row, code, rows)
    pair = np.flatnonzero(row[1:] == row[:-1])
    upper = np.concatenate([[0], np.cumsum(_MASKS["upper"][data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    capital = (upper[stops] - upper[starts] == letters[stops] - letters[starts]) & (letters[stops] - letters[starts] > 1)
    last = data[stops - 1]
    odd = ~_LETTER[last] & ~_MASKS["digit"][last] & ~_MASKS["stop"][last] & ~_MASKS["comma"][last]
    triple = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    size = int(code.max()) + 1 if len(code) else 1
    _, two = np.unique(code[triple] * size + code[triple + 1], return_inverse=True)
    n_triples = np.bincount(row[triple], minlength=rows)
    different, _ = _again(row[triple], two * size + code[triple + 2], rows)
    different_lines, _ = _again(of_line, line_code, rows)

    def share(count, of):
        return np.log2(1 + 1000 * count / np.maximum(of, 1)) * 6

    out = {
        "chars": np.log2(1 + chars) * 3,
        "words": np.log2(1 + n) * 3,
        "lines": np.log2(1 + n_lines) * 3,
        "mean_word": np.bincount(row, weights=length, minlength=rows) / np.maximum(n, 1) * 3,
        "longest_word": np.log2(1 + longest) * 4,
        **{name: share(within(mask[data]), chars) for name, mask in _MASKS.items()},
        "wide": share(within(data >= 0xC0), chars),
        "words_end_odd": share(counted(row, odd), n),
        "words_upper": share(counted(row, capital), n),
        "words_short": share(counted(row, length == 1), n),
        "words_digit": share(counted(row, _MASKS["digit"][data[starts]]), n),
        "words_distinct": share(distinct, n),
        "words_twice_running": share(np.bincount(row[pair[code[pair] == code[pair + 1]]], minlength=rows), n),
        "commonest_word": share(commonest, n),
        "triples_repeated": share(n_triples - different, n_triples),
        "lines_repeated": share(n_lines - different_lines, n_lines),
        "words_per_line": np.log2(1 + n / np.maximum(n_lines, 1)) * 4,
        "lines_end_stop": share(counted(of_line, _MASKS["stop"][data[end - 1]]), n_lines),
    }
    return np.clip(np.stack([out[s] for s in STATISTICS], axis=1), 0, BINS - 1).astype(np.uint8)


def _measured(batches):
    for batch in batches:
        for i, j, data, offsets in texts(batch):
            bins = statistics(data, offsets)
            yield table({"doc_id": batch.column("doc_id").slice(i, j - i), "bins": pa.array([b.tobytes() for b in bins], pa.binary())}, _ROWS)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``bins``, one byte for each of ``STATISTICS``; nothing but the text is read."""
    return one_row_per_id(docs).mapInArrow(_measured, "doc_id long, bins binary")


@dataclass
class Forest:
    """Trees in arrays: statistic and limit of inner nodes in breadth-first order, values of leaves.

    A row goes to the right where its bin is above the limit.
    """

    base: float
    statistic: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def node(self, tree: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches at ``depth``, counted from the left."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            at = 2 * at + 1 + (bins[rows, self.statistic[tree, at]] > self.limit[tree, at])
        return at - (2**depth - 1)

    def raw(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        out = np.full(len(bins), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for t in range(len(self.leaf) if trees is None else trees):
            out += self.leaf[t, self.node(t, bins, depth)]
        return out

    def score(self, bins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(bins)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def _histograms(shared, tree: int, depth: int):
    """Sums of first and second derivatives by (node, statistic, bin) over a task's rows."""

    def run(batches):
        forest, width = shared.value, len(STATISTICS) * BINS
        g, h = np.zeros(2**depth * width, np.int64), np.zeros(2**depth * width, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch)
            p = 1 / (1 + np.exp(-forest.raw(bins, tree)))
            first = np.rint((batch.column("label").to_numpy() - p) * PARTS)
            second = np.rint(p * (1 - p) * PARTS)
            cells = (forest.node(tree, bins, depth) * width)[:, None] + np.arange(len(STATISTICS)) * BINS + bins
            for sums, values in ((g, first), (h, second)):
                sums += np.bincount(cells.ravel(), weights=np.repeat(values, len(STATISTICS)), minlength=len(sums)).astype(np.int64)
        some = np.flatnonzero(h)
        yield table({"cell": some, "g": g[some], "h": h[some]}, _CELLS)

    return run


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Trees for ``rows`` (bins binary, label 0 or 1), which is read once for each level of each tree.

    A node that no split improves sends all rows to the left. Without rows the forest says 0.5.
    """
    spark, inner = rows.sparkSession, 2**depth - 1
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    share = min(max(ones / n, 1e-3), 1 - 1e-3) if n else 0.5
    forest = Forest(
        float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.int64), np.zeros((trees, inner + 1))
    )
    if not n or ones in (0, n):
        return forest
    for tree in range(trees):
        for level in range(depth):
            shared = spark.sparkContext.broadcast(forest)
            partial = rows.mapInArrow(_histograms(shared, tree, level), "cell int, g long, h long")
            sums = np.zeros((2, 2**level * len(STATISTICS) * BINS))
            for r in partial.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # at most one row per cell
                sums[:, r.cell] = r.g / PARTS, r.h / PARTS
            shared.unpersist()
            _split(forest, tree, level, depth, rate, *sums.reshape(2, 2**level, len(STATISTICS), BINS))
    return forest


def _split(forest: Forest, tree: int, level: int, depth: int, rate: float, g: np.ndarray, h: np.ndarray) -> None:
    """Best statistic and limit of each node of a level, and at the last level the leaves' values."""
    left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + SMOOTHING) + right_g**2 / (right_h + SMOOTHING) - all_g**2 / (all_h + SMOOTHING)
    gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
    for node in range(2**level):
        at = 2**level - 1 + node
        best = int(gain[node].argmax())
        statistic, limit = divmod(best, BINS)
        if gain[node, statistic, limit] > 1e-9:
            forest.statistic[tree, at], forest.limit[tree, at] = statistic, limit
        else:
            statistic, limit = 0, BINS - 1
        if level == depth - 1:
            for side, (x, y) in enumerate(((left_g, left_h), (right_g, right_h))):
                forest.leaf[tree, 2 * node + side] = rate * x[node, statistic, limit] / (y[node, statistic, limit] + SMOOTHING)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row is left out of the fit."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", trees: int = TREES) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    The model is fitted to the labelled rows that are not held out, all of them; a score comes from the
    text alone. Null and empty texts have all statistics 0 and are scored like others. Rows without id
    are left out, and of rows with one id the smallest text counts. Labels without id, other than 0
    and 1, or of ids without document are not used; where an id has several, the smallest counts. Other
    columns are not read. Without usable labels all scores are 0.5, with labels of one kind they are all
    equal. An empty table gives an empty result.
    """
    steps = Steps(docs.sparkSession)
    rows = steps.write(document_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    labelled = steps.write(rows.join(known, "doc_id").select("bins", "label"), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled, trees))
    steps.remove("labelled")

    def scored(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            if batch.num_rows:
                yield table({"doc_id": batch.column("doc_id"), "score": shared.value.score(_matrix(batch))}, schema)

    score = rows.mapInArrow(scored, "doc_id long, score double")
    return score.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
