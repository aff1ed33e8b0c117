"""Quality rules: simple measures of a text, and how much it repeats itself.

Repetition is read off a suffix array over the words of each document. Neighbours in suffix order
have the longest common prefixes; the intervals of equal prefixes are the maximal repeated
substrings. Their spans are united, and a document is rejected if they cover too much of it or
if one of them is too long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import distinct_words, one_row_per_id, table, texts, words

# Fixed by the rules: too short, and too many words in repeated windows.
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
# Repeats of so many words count as covered; limits of their share and of the longest one.
MIN_REPEAT = 10
MAX_COVERED_PERCENT = 20
MAX_REPEAT = 100

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

_OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def longest_repeats(symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each position the longest string there that also starts elsewhere in its row.

    Prefix doubling sorts the suffixes of all rows at once; a suffix that is alone in its class
    needs no further rounds. The ranks of each round then give the common prefix of neighbours in
    suffix order, from the longest step to the shortest.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.lexsort((symbols, row))
    rank = np.empty(n, np.int64)
    same = np.concatenate([[False], (symbols[order][1:] == symbols[order][:-1]) & (row[order][1:] == row[order][:-1])])
    rank[order] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    levels, h = [rank], 1
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(open_):
        after = np.minimum(open_ + h, n - 1)
        inside = (open_ + h < n) & (row[after] == row[open_])
        second = np.where(inside, rank[after] + 1, 0)
        order = np.lexsort((second, rank[open_]))
        first, second = rank[open_][order], second[order]
        k = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], first[1:] != first[:-1]]), k, 0))
        part = np.maximum.accumulate(np.where(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]), k, 0))
        rank = rank.copy()
        rank[open_[order]] = first + part - start
        levels.append(rank)
        h *= 2
        open_ = open_[np.bincount(rank[open_], minlength=n)[rank[open_]] > 1]
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(row[left] == row[right])
    for level in range(len(levels) - 1, -1, -1):
        a, b = left[live] + common[live], right[live] + common[live]
        top = np.maximum(a, b)
        inside = top < n
        inside[inside] = row[top[inside]] == row[left[live][inside]]
        equal = np.zeros(len(live), bool)
        equal[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        common[live[equal]] += 1 << level
    out = np.zeros(n, np.int64)
    out[order[:-1]] = common
    np.maximum.at(out, order[1:], common)
    return out


def _united(longest: np.ndarray, least: int, cut: int | None = None) -> np.ndarray:
    """Positions in a repeat of at least ``least``, or in its first ``cut`` places."""
    at = np.flatnonzero(longest >= least)
    stop = at + (longest[at] if cut is None else cut)
    edge = np.bincount(at, minlength=len(longest) + 1) - np.bincount(stop, minlength=len(longest) + 1)
    return np.cumsum(edge)[: len(longest)] > 0


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
    """Number of lines with a word that equal an earlier line of their row."""
    breaks = np.flatnonzero(data == 10)
    begins = np.union1d(offsets[:-1][offsets[1:] > offsets[:-1]], breaks + 1)
    begins = begins[begins < len(data)]
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begins, "left")], offsets[1:][np.searchsorted(offsets, begins, "right") - 1])
    has_word = np.searchsorted(starts, ends, "left") > np.searchsorted(starts, begins, "left")
    begins, ends = begins[has_word], ends[has_word]
    row = np.searchsorted(offsets, begins, "right") - 1
    line, _ = distinct_words(data, begins, ends)
    order = np.lexsort((line, row))
    a, b = order[1:], order[:-1]
    return np.bincount(row[a[(row[a] == row[b]) & (line[a] == line[b])]], minlength=rows)


def _measure(batches):
    for batch in batches:
        for i, j, data, offsets in texts(batch):
            rows = j - i
            starts, stops, row = words(data, offsets)
            longest = longest_repeats(distinct_words(data, starts, stops)[0], row)
            n = np.bincount(row, minlength=rows)
            letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            chars = np.bincount(row, weights=letters[stops] - letters[starts], minlength=rows).astype(np.int64)
            symbols = np.diff(np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])[offsets])
            repeated = np.bincount(row[_united(longest, REPEAT_WINDOW, REPEAT_WINDOW)], minlength=rows)
            covered = np.bincount(row[_united(longest, MIN_REPEAT)], minlength=rows)
            most = np.zeros(rows, np.int64)
            np.maximum.at(most, row, longest)
            failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
            kept = ~failed & (100 * covered <= MAX_COVERED_PERCENT * n) & (most <= MAX_REPEAT)
            yield table(
                {"doc_id": batch.column("doc_id").slice(i, rows), "n_words": n, "word_chars": chars, "n_symbols": symbols,
                 "n_dup_lines": _duplicate_lines(data, offsets, starts, rows), "n_repeat_words": repeated,
                 "n_covered_words": covered, "longest_repeat": most, "base_failed": failed, "kept": kept},
                _OUT,
            )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``.

    Null and empty texts have no words, fail the base rules and are not kept. Rows without id
    are left out, and of rows with one id the smallest text counts. Other columns are not read. An
    empty table gives an empty result.
    """
    return one_row_per_id(docs).mapInArrow(_measure, ", ".join(f"{f.name} {'boolean' if pa.types.is_boolean(f.type) else 'long'}" for f in _OUT))
