"""Removal of word passages that an earlier document has, by recompression.

Words are compressed in rounds: a run of one symbol becomes one symbol, then neighbours (a, b)
become one symbol where a coin puts a on the left and b on the right side. A name is a 64-bit
hash of what it stands for, and a coin is a bit of the hash of a name and the round: so all tasks
give one name to equal content without exchanging a table of names. What becomes of a word
depends on few neighbours, so that equal passages are compressed alike but for their margins.

A symbol of round 2 covers up to four words and depends on three more on either side. A window of
13 words therefore has at least one symbol whose name follows from the window alone. The window is
keyed by the one with the least name, taken with the words on which it depends. Windows under one
key are then compared word by word (``passages`` has these steps). Runs could hide such a symbol:
a window with two equal neighbouring words, or two equal neighbouring pairs, is keyed by the hash
of the whole window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import passages
from .passages import Method
from .scratch import Steps
from .words import U, first_of_groups, gram_hash, gram_hash_at, joined, mix, one_row_per_id, prefix_hash, prefix_hash_of, span_hash, table, texts, word_hash, words

WINDOW = 13
ROUNDS = 2
# Words on each side of a symbol of the last round that it depends on.
MARGIN = 3


def compress(symbols: np.ndarray, sizes: np.ndarray, row: np.ndarray, number: int):
    """One round: names, numbers of words and documents of the new symbols."""
    # runs
    same = np.concatenate([[False], (symbols[1:] == symbols[:-1]) & (row[1:] == row[:-1])])
    first = np.flatnonzero(~same)
    times = np.diff(np.append(first, len(symbols)))
    roots, row = symbols[first], row[first]
    sizes = np.add.reduceat(sizes, first)
    names = np.where(times > 1, mix(roots * U(3) + times.astype(U)), roots)
    # pairs: a coin of the root decides, so that it doesn't depend on how long a run is
    right = (mix(roots + U(number)) & U(1)).astype(bool)
    joined = np.zeros(len(names), bool)
    joined[1:] = right[1:] & ~right[:-1] & (row[1:] == row[:-1])
    names[:-1] = np.where(joined[1:], mix(mix(names[:-1] + U(number)) * U(5) + names[1:]), names[:-1])
    first = np.flatnonzero(~joined)
    return names[first], np.add.reduceat(sizes, first), row[first]


def _windows(data: np.ndarray, offsets: np.ndarray):
    starts, stops, row = words(data, offsets)
    if len(starts) < WINDOW:
        return
    hashes = word_hash(data, starts, stops)
    names, sizes, rows = hashes, np.ones(len(hashes), np.int64), row
    for number in range(1, ROUNDS + 1):
        names, sizes, rows = compress(names, sizes, rows, number)
    order = mix(names + U(ROUNDS + 1))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    symbol = np.repeat(np.arange(len(names)), sizes)  # of each word

    at = np.arange(len(hashes) - WINDOW + 1)
    at = at[row[at] == row[at + WINDOW - 1]]
    low, high = at + MARGIN, at + WINDOW - MARGIN
    first = symbol[low] + (begins[symbol[low]] < low)
    last = symbol[high - 1] + (ends[symbol[high - 1]] <= high)
    key, anchor = np.full(len(at), ~U(0)), np.full(len(at), -1)
    for k in range(WINDOW - 2 * MARGIN):
        there = first + k < last
        value = order[np.minimum(first + k, len(order) - 1)]
        less = there & ((anchor < 0) | (value < key))
        key, anchor = np.where(less, value, key), np.where(less, first + k, anchor)

    def among(flags: np.ndarray, width: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[np.minimum(at + width, len(flags))] > sums[np.minimum(at, len(flags))]

    twice = hashes[1:] == hashes[:-1]
    pairs = (hashes[2:-1] == hashes[:-3]) & (hashes[3:] == hashes[1:-2])
    whole = among(twice, WINDOW - 1) | among(pairs, WINDOW - 3) | (anchor < 0)
    around = gram_hash(hashes, 2 * MARGIN + 1)[np.where(whole, at, begins[np.maximum(anchor, 0)] - MARGIN)]
    key = around
    if whole.any():
        rare = at[whole]
        key[whole] = mix(gram_hash_at(hashes, rare, WINDOW) + U(1))
    anchor = np.where(whole, -1 - at, anchor)
    first_word = np.searchsorted(row, np.arange(len(offsets) - 1), "left")
    prefix = prefix_hash_of(hashes)

    def units(first: np.ndarray, n: np.ndarray) -> np.ndarray:
        return span_hash(prefix, at[first], at[first] + n + WINDOW - 1)

    yield row[at], at - first_word[row[at]], key, anchor, units


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, row = words(data, offsets)
    return word_hash(data, starts, stops).view(np.uint8), np.searchsorted(row, np.arange(len(offsets) - 1), "left")


def _repeats(data: np.ndarray, starts: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows that a document with a smaller id also has; given in order of document."""
    size = WINDOW * 8
    units = np.lib.stride_tricks.sliding_window_view(data, size)[starts]
    hashes = span_hash(prefix_hash(data), starts, starts + size)
    order = np.argsort(hashes, kind="stable")
    group = first_of_groups(np.concatenate([[False], hashes[order][1:] == hashes[order][:-1]]))
    first = order[np.searchsorted(group, group, "left")]
    if not (units[order] == units[first]).all():  # two windows with one hash
        _, exact = np.unique(units.view(f"V{size}").ravel(), return_inverse=True)
        order = np.argsort(exact, kind="stable")
        first = order[np.searchsorted(exact[order], exact[order], "left")]
    out = np.zeros(len(starts), bool)
    out[order] = doc[order] > doc[first]
    return out


METHOD = Method(window=WINDOW, unit_bytes=8, within_document=False, keys=_windows, units=_units, repeats=_repeats)

_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (words that stay, joined by a space).

    A word goes if a window of 13 words over it also starts in a document with a smaller id.
    Null text has no words; texts of fewer than 13 words stay whole; of repeated texts the one
    with the smallest id stays. Rows without id are left out, and of rows with one id the
    smallest text counts. Other columns are not read. An empty table gives an empty result.
    """
    steps = Steps(docs.sparkSession)
    docs = one_row_per_id(docs)
    return passages.spans_by_document(docs, METHOD, steps).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def _kept(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, data, offsets in texts(batch):
            starts, stops, row = words(data, offsets)
            begins = np.searchsorted(row, np.arange(j - i), "left")
            gone = passages.covered(batch, i, j, begins, len(starts))
            n = np.bincount(row, minlength=j - i)
            removed = np.bincount(row[gone], minlength=j - i)
            kept = joined(data, starts[~gone], stops[~gone], row[~gone], j - i)
            yield table({"doc_id": ids.slice(i, j - i), "n_words": n, "n_removed": removed, "kept": kept}, _KEPT)
