"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a window of ``length`` bytes that covers it also starts earlier: in a document
with a smaller id, or earlier in the same document. That is: the longest previous factor at the
window's start, the longest prefix of the rest of the text that also begins at an earlier
position, has at least ``length`` bytes. It is found from the suffix order: the earlier position
that shares most is the previous or the next smaller position in it.

Suffixes can matter only where some ``ANCHOR`` bytes inside the window occur twice. So each
window is keyed by its least anchor hash, and only windows under a shared key are put into
suffix order, key by key (``passages`` has the steps).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import passages
from .passages import Method
from .scratch import Steps
from .words import SLICE_BYTES, U, buffers, one_row_per_id, prefix_hash, span_hash, table, texts

LENGTH = 100
# Bytes of the anchors by which windows are keyed.
ANCHOR = 40


def least_in_window(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of each ``width`` neighbouring values, and where it is first."""
    least, place, k = values, np.arange(len(values), dtype=np.int32), 1
    while k < width:
        step = min(k, width - k)
        left, right = least[:-step], least[step:]
        before = left <= right
        least, place = np.where(before, left, right), np.where(before, place[:-step], place[step:])
        k += step
    return least, place


def _keys(length: int, anchor: int):
    def keys(data: np.ndarray, offsets: np.ndarray):
        long = len(offsets) == 2 and len(data) > 2 * SLICE_BYTES
        for a in range(0, len(data), SLICE_BYTES if long else max(1, len(data))):
            part = data[a : a + SLICE_BYTES + length - 1] if long else data
            here = np.array([0, len(part)]) if long else offsets
            if len(part) < length:
                continue
            p = prefix_hash(part)
            at = np.arange(len(part) - anchor + 1)
            least, anchors = least_in_window(span_hash(p, at, at + anchor), length - anchor + 1)
            count = np.maximum(np.diff(here) - length + 1, 0)
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = here[row] + place

            def units(first: np.ndarray, n: np.ndarray, p=p, begin=begin) -> np.ndarray:
                return span_hash(p, begin[first], begin[first] + n + length - 1)

            yield row, place + a, least[begin], anchors[begin], units

    return keys


def longest_previous(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor, up to ``length``, at each of the given window starts.

    ``starts`` are in order of position and have ``length`` bytes each.
    """
    # no byte of UTF-8 is 255, so that none becomes the 0 at which fixed strings end
    windows = np.lib.stride_tricks.sliding_window_view(data, length)[starts] + np.uint8(1)
    order = np.argsort(windows.view(f"S{length}").ravel(), kind="stable")
    ranked = windows[order]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    above, below = _smaller_neighbours(order, common)
    factor = np.empty(len(starts), np.int64)
    factor[order] = np.maximum(above, below)
    return factor


def _smaller_neighbours(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix with the previous and the next smaller position, by rank; 0 without one.

    Links jump over ranks whose position is not smaller and keep the least common prefix passed.
    All ranks jump together; a rank stops at the first smaller position.
    """
    out = []
    for step in (-1, 1):
        rank = np.arange(len(order))
        link = rank + step
        shared = np.concatenate([[0], common]) if step < 0 else np.append(common, 0)
        open_ = np.flatnonzero((link >= 0) & (link < len(order)))
        open_ = open_[order[link[open_]] > order[open_]]
        while len(open_):
            # beyond a larger position lies nothing smaller than it before its own link
            at = link[open_]
            shared[open_] = np.minimum(shared[open_], shared[at])
            link[open_] = link[at]
            inside = (link[open_] >= 0) & (link[open_] < len(order)) & (shared[open_] > 0)
            shared[open_[~inside]] = 0
            open_ = open_[inside]
            open_ = open_[order[link[open_]] > order[open_]]
        out.append(shared)
    return out[0], out[1]


def method(length: int = LENGTH, anchor: int = ANCHOR) -> Method:
    return Method(
        window=length,
        unit_bytes=1,
        within_document=True,
        keys=_keys(length, anchor),
        units=lambda data, offsets: (data, offsets),
        repeats=lambda data, starts, doc, at: longest_previous(data, starts, length) >= length,
    )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, as_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    With ``as_text`` the bytes are read as text; a character that was cut into goes.

    Null text is empty; texts shorter than ``length`` stay whole; of repeated texts the one with
    the smallest id stays. Rows without id are left out, and of rows with one id the smallest text
    counts. Other columns are not read. An empty table gives an empty result.
    """
    steps = Steps(docs.sparkSession)
    docs = one_row_per_id(docs)
    kept = passages.spans_by_document(docs, method(length, anchor), steps).mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return kept.mapInArrow(_as_text, "doc_id long, n_bytes long, n_removed long, n_spans long, kept string") if as_text else kept


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _as_text(batches):
    for batch in batches:
        text = pa.array([b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=batch.schema.names)


def _kept(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, data, offsets in texts(batch):
            gone = passages.covered(batch, i, j, offsets, len(data))
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            begins = offsets[:-1][offsets[1:] > offsets[:-1]]
            first[begins] = gone[begins]
            removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, first))
            kept = data[~gone]
            ends = np.cumsum(np.diff(offsets) - removed)
            bytes_kept = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
            yield table({"doc_id": ids.slice(i, j - i), "n_bytes": np.diff(offsets), "n_removed": removed, "n_spans": spans, "kept": bytes_kept}, _KEPT)
