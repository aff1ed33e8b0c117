"""Passages that occur more than once: from local keys to the windows that have an earlier copy.

A text is a row of units (bytes or words), a window is a fixed number of them. Two operators
share these steps; they differ in how they find keys and how they compare windows.

1. ``shared_runs``: every window gets a key that depends on nothing but the window, so that equal
   windows have equal keys wherever they are. Neighbours mostly have the same key; such runs are
   the rows that are shuffled. Runs whose key occurs once can't hold a repeated window, and runs
   with all units equal to an earlier run's are known to be repeats.
2. ``earlier_windows``: runs whose key also has other units are cut out of the texts, meet by key
   and are compared unit by unit.
3. ``spans_by_document``: spans to remove, gathered per document.

A key may hold any share of all rows. Before each shuffle a task therefore looks for repeats
among its own rows: of equal rows only the first one goes to the key's partition, the others are
known to be repeats and are dealt out evenly. A key whose surroundings all differ would stay
large even so; beyond ``CROWD`` occurrences its runs are sent window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Steps
from .words import U, buffers, first_of_groups, mix, prefix_hash, span_hash, table, texts

# Occurrences of a key above which its windows are compared under keys of their own.
CROWD = 20_000
# Rows a task keeps to look for repeats among them, and bytes compared at once.
ROWS_AT_ONCE = 300_000
BYTES_AT_ONCE = 1 << 20
SALTS = 30_000

# Rows of the first shuffle are packed, as there are many: ``place`` is the first window of a run and
# the number of its windows, ``tag`` the salt, the key's occurrences in the task, and two flags.
# A salt changes the high bits of the key, so that it can be taken out again.
_N_BITS, _SALT_BIT, _KEY_BIT = 20, 40, 40
_OPEN, _DONE = 1, 2
_RUNS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("units", pa.int64()), ("tag", pa.int64())])
_CUT = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("units", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


@dataclass(frozen=True)
class Method:
    """How texts become windows.

    ``keys(data, offsets)`` yields (row, position, key, anchor) arrays of windows, in order, where
    windows of one anchor are neighbours and never equal, and a function that gives a hash of all
    units of the runs that begin at given windows and have given numbers of them;
    ``units(data, offsets)`` gives the bytes of all units and where each document's begin;
    ``repeats(data, starts, doc, position)`` flags the windows (their first bytes in ``data``)
    that have an earlier copy among those given.
    """

    window: int
    unit_bytes: int
    within_document: bool
    keys: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    repeats: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]

    @property
    def window_bytes(self) -> int:
        return self.window * self.unit_bytes


def shared_runs(docs: DataFrame, method: Method) -> DataFrame:
    """Runs of windows whose key occurs with several units, and runs that repeat an earlier one.

    Columns key, salt, doc_id, lo, n, total, done. ``done`` marks repeats. ``total`` counts the
    occurrences of the key; it is right in rows with salt 0, of which each key has one for each
    task at most.
    """

    def runs(batches):
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, data, offsets in texts(batch):
                for row, at, key, anchor, units in method.keys(data, offsets):
                    if not len(key):
                        continue
                    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
                    n = np.diff(np.append(new, len(key)))
                    held.append((key[new], ids[i + row[new]], at[new], n, units(new, n)))
                    rows += len(new)
            if rows >= ROWS_AT_ONCE:
                yield _own_repeats(held, method.within_document)
                held, rows = [], 0
        if rows:
            yield _own_repeats(held, method.within_document)

    found = docs.mapInArrow(runs, "key long, doc_id long, place long, units long, tag long")
    same_key, same_units = Window.partitionBy("key"), Window.partitionBy("key", "units")
    place = F.struct("doc_id", "place")
    first = F.min(place).over(same_units)
    later = place > first if method.within_document else F.col("doc_id") > first["doc_id"]
    salt = F.shiftright("tag", _SALT_BIT)
    copies = F.shiftright("tag", 2).bitwiseAND(F.lit((1 << (_SALT_BIT - 2)) - 1))
    marked = found.withColumns(
        {
            "total": F.sum(copies).over(same_key),
            "several": F.min("units").over(same_key) < F.max("units").over(same_key),
            "open": F.max(F.col("tag").bitwiseAND(F.lit(_OPEN))).over(same_key) > 0,
            "done": (F.col("tag").bitwiseAND(F.lit(_DONE)) > 0) | later,
        }
    )
    # runs of an open key in other partitions may be compared with any run that isn't done
    return marked.filter(F.col("done") | F.col("several") | F.col("open")).select(
        F.col("key").bitwiseXOR(F.shiftleft(salt, _KEY_BIT)).alias("key"), salt.alias("salt"), "doc_id",
        F.shiftright("place", _N_BITS).cast("int").alias("lo"),
        F.col("place").bitwiseAND(F.lit((1 << _N_BITS) - 1)).cast("int").alias("n"), "total", "done",
    )


def _sorted(key: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The order by all columns. Most keys occur once, so that only the others need the other columns."""
    order = np.argsort(key)
    same = np.concatenate([[False], key[order[1:]] == key[order[:-1]], [False]])
    several = np.flatnonzero(same[1:] | same[:-1])
    some = order[several]
    order[several] = some[np.lexsort((*[c[some] for c in reversed(more)], key[some]))]
    return order


def _own_repeats(held: list[tuple[np.ndarray, ...]], within_document: bool) -> pa.RecordBatch:
    """The runs of a task. Of those with one key only the first goes to the key's partition; others
    are dealt out by their units, and repeats evenly. ``open`` marks keys that have several units
    or repeats that aren't done."""
    key, doc, lo, n, units = (np.concatenate(x) for x in zip(*held))
    order = _sorted(key, units, doc, lo)
    key, doc, lo, n, units = key[order], doc[order], lo[order], n[order], units[order]
    same_key = np.concatenate([[False], key[1:] == key[:-1]])
    again = same_key & np.concatenate([[False], units[1:] == units[:-1]])
    group, same = first_of_groups(same_key), first_of_groups(again)
    first = np.searchsorted(same, same, "left")
    later = doc > doc[first]
    if within_document:
        later |= (doc == doc[first]) & (lo > lo[first])
    copies = np.bincount(group)[group]
    undone = np.bincount(group, weights=~again | ~later)[group] > 1
    lot = np.where(again, mix(doc.astype(U) * U(2654435761) + lo.astype(U)), mix(units))
    salt = np.where(same_key, lot % U(SALTS) + U(1), U(0))
    tag = (salt.astype(np.int64) << _SALT_BIT) | (np.where(same_key, 0, copies) << 2) | ((undone | again) * _OPEN) | ((later & again) * _DONE)
    columns = {
        "key": (key ^ (salt << U(_KEY_BIT))).view(np.int64), "doc_id": doc, "place": (lo.astype(np.int64) << _N_BITS) | n, "units": units.view(np.int64), "tag": tag,
    }
    # in the order of the texts, in which neighbours have their document in common
    order = np.argsort(order, kind="stable")
    return table({name: values[order] for name, values in columns.items()}, _RUNS)


def earlier_windows(docs: DataFrame, shared: DataFrame, method: Method) -> DataFrame:
    """Spans (doc_id, start, stop) in units, of windows that have an earlier copy."""
    crowd = shared.filter(f"salt = 0 and total > {CROWD}").select("key").distinct().withColumn("crowd", F.lit(True))
    runs = (
        shared.filter("not done").select("key", "doc_id", "lo", "n")
        .join(crowd, "key", "left")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("key", "lo", "n", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("runs"))
    )

    def cut(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lists = batch.column("runs")
            for i, j, data, offsets in texts(batch):
                units, begins = method.units(data, offsets)
                part = lists.slice(i, j - i)
                flat = part.flatten()
                key, lo, n, crowded = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
                row = np.repeat(np.arange(j - i), part.value_lengths().to_numpy(zero_copy_only=False))
                for piece in _pieces(units, begins[row] + lo, ids[i + row], key, lo, n, crowded, method):
                    held.append(piece)
                    size += len(piece[-1])
                    if size >= BYTES_AT_ONCE:
                        yield _first_copies(held, method)
                        held, size = [], 0
        if size:
            yield _first_copies(held, method)

    def compare(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BYTES_AT_ONCE:
                rows = pa.Table.from_batches(held).combine_chunks()
                key = rows.column("key").to_numpy()
                end = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
                if end:
                    yield _compared(rows.slice(0, end), method)
                    rows = rows.slice(end)
                held, size = rows.to_batches(), rows.nbytes
        if held:
            yield _compared(pa.Table.from_batches(held).combine_chunks(), method)

    pieces = docs.join(runs, "doc_id").mapInArrow(cut, "key long, doc_id long, lo int, n int, units binary")
    found = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "doc_id long, start int, stop int")
    known = shared.filter("done").select("doc_id", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (method.window - 1)).alias("stop"))
    return found.union(known)


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after another, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[index], offsets


def _pieces(units, first, doc, key, lo, n, crowded, method: Method):
    """Rows (key, doc, lo, n, lengths, bytes): whole runs, and single windows of crowded keys."""
    u, w = method.unit_bytes, method.window
    whole = ~crowded.astype(bool)
    if whole.any():
        lengths = (n[whole].astype(np.int64) + w - 1) * u
        data, offsets = _gather(units, first[whole].astype(np.int64) * u, lengths)
        yield key[whole], doc[whole], lo[whole], n[whole], np.diff(offsets), data
    if not whole.all():
        one = ~whole
        times = n[one].astype(np.int64)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts = (np.repeat(first[one], times) + step).astype(np.int64) * u
        data, offsets = _gather(units, starts, np.full(len(starts), w * u))
        own = span_hash(prefix_hash(data), offsets[:-1], offsets[1:]).view(np.int64)
        yield own, np.repeat(doc[one], times), np.repeat(lo[one], times) + step, np.ones(len(starts), np.int64), np.diff(offsets), data


def _first_copies(held, method: Method) -> pa.RecordBatch:
    """Of rows with equal units, those that may be the first; later ones as repeats, without units."""
    key, doc, lo, n, lengths = (np.concatenate([h[k] for h in held]) for k in range(5))
    data = np.concatenate([h[5] for h in held])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    whole = span_hash(prefix_hash(data), offsets[:-1], offsets[1:]) ^ mix(key.view(U))
    order = np.lexsort((lo, doc, whole))
    group = first_of_groups(np.concatenate([[False], whole[order][1:] == whole[order][:-1]]))
    first = order[np.searchsorted(group, group, "left")]
    copy = np.zeros(len(key), bool)
    copy[order] = (doc[order] > doc[first]) | (method.within_document & (doc[order] == doc[first]) & (lo[order] > lo[first]))
    copy[order] &= _equal_spans(data, offsets, order, first)
    stay = np.flatnonzero(~copy)
    units = [data[offsets[k] : offsets[k + 1]].tobytes() for k in stay]
    # repeats that follow each other become one row
    copy = np.flatnonzero(copy)
    copy = copy[np.lexsort((lo[copy], doc[copy]))]
    stop = lo[copy] + n[copy]
    new = np.ones(len(copy), bool)
    new[1:] = (doc[copy][1:] != doc[copy][:-1]) | (lo[copy][1:] != stop[:-1])
    first = copy[new]
    ends = stop[np.append(np.flatnonzero(new)[1:] - 1, len(copy) - 1)] if len(copy) else stop
    dealt = mix(doc[first].astype(U) + lo[first].astype(U)).view(np.int64)
    return table(
        {"key": np.append(key[stay], dealt), "doc_id": np.append(doc[stay], doc[first]), "lo": np.append(lo[stay], lo[first]),
         "n": np.append(n[stay], ends - lo[first]), "units": pa.array(units + [None] * len(first), pa.binary())},
        _CUT,
    )


def _equal_spans(data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether span a[i] has the bytes of span b[i]."""
    lengths = np.diff(offsets)
    same = lengths[a] == lengths[b]
    a, b = a[same], b[same]
    left, at = _gather(data, offsets[a], lengths[a])
    right, _ = _gather(data, offsets[b], lengths[b])
    differ = np.concatenate([[0], np.cumsum(left != right)])
    out = same.copy()
    out[same] = differ[at[1:]] == differ[at[:-1]]
    return out


def _compared(rows: pa.Table, method: Method) -> pa.RecordBatch:
    doc, lo, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "lo", "n"))
    known = rows.column("units").is_null().to_numpy()
    data, offsets = buffers(rows.column("units"))
    out = [(doc[known], lo[known], lo[known] + n[known] - 1 + method.window)]
    times, begins = n[~known], offsets[:-1][~known]
    if len(times):
        row = np.repeat(np.flatnonzero(~known), times)
        step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        starts = np.repeat(begins, times) + step * method.unit_bytes
        at = lo[row] + step
        # a window that is alone under its hash has no copy
        hashes = span_hash(prefix_hash(data), starts, starts + method.window_bytes)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        several = np.zeros(len(row), bool)
        several[order[1:][same]] = True
        several[order[:-1][same]] = True
        some = np.flatnonzero(several)
        some = some[np.lexsort((at[some], doc[row[some]]))]
        repeated = np.zeros(len(row), bool)
        most = max(1, 4 * BYTES_AT_ONCE // method.window_bytes)
        if len(some) <= most:
            parts = [some]
        else:  # by hash, so that copies stay together
            part = hashes[some] % U(len(some) // most + 1)
            parts = [some[part == p] for p in range(len(some) // most + 1)]
        for some in parts:
            if len(some):
                repeated[some] = method.repeats(data, starts[some], doc[row[some]], at[some])
        # neighbouring windows of one run make one span
        flags = np.flatnonzero(repeated)
        if len(flags):
            new = np.concatenate([[True], (flags[1:] != flags[:-1] + 1) | (row[flags[1:]] != row[flags[:-1]])])
            first = flags[new]
            last = flags[np.append(np.flatnonzero(new)[1:] - 1, len(flags) - 1)]
            out.append((doc[row[first]], at[first], at[last] + method.window))
    doc, start, stop = (np.concatenate(x) for x in zip(*out))
    return table({"doc_id": doc, "start": start, "stop": stop}, _SPANS)


def spans_by_document(docs: DataFrame, method: Method, steps: Steps) -> DataFrame:
    """``docs`` with a list ``spans`` of (start, stop) to remove; null where there are none."""
    shared = steps.write(shared_runs(docs, method), "shared")
    spans = steps.write(earlier_windows(docs, shared, method), "spans")
    steps.remove("shared")
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(lists, "doc_id", "left")


def covered(batch: pa.RecordBatch, i: int, j: int, begins: np.ndarray, size: int) -> np.ndarray:
    """Which units of rows i to j are in one of their spans; ``begins``: first unit of each row."""
    part = batch.column("spans").slice(i, j - i)
    counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = part.flatten()
    start, stop = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
    first = np.repeat(begins[: j - i], counts)
    edge = np.bincount(first + start, minlength=size + 1) - np.bincount(first + stop, minlength=size + 1)
    return np.cumsum(edge)[:size] > 0
