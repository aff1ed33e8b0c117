"""Words of Arrow text columns as numpy arrays: where they are and 64-bit hashes of them.

All helpers work on a slice of a batch: the UTF-8 bytes of several documents one after another,
with the offsets where each begins. Separators are ASCII, so bytes can be tested one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A word is a longest run of bytes other than these (space and \t \n \v \f \r).
SEPARATORS = (32, 9, 10, 11, 12, 13)
# Bytes of text worked on at once; the arrays made of them take some 100 bytes for each.
SLICE_BYTES = 1 << 19

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True

# Hashes of spans are polynomials modulo two primes. (Modulo a power of two, different texts of a regular
# build have equal polynomials whatever the base.)
PRIMES = np.array([[2147483647], [2147483629]])
_ROOTS = (1270463909, 894102917)
_powers: dict[tuple[int, ...], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (a bijection)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _residues(hashes: np.ndarray) -> np.ndarray:
    return np.stack([hashes & U(0xFFFFFFFF), hashes >> U(32)]).view(np.int64) % PRIMES


_BYTE = _residues(mix(np.arange(1, 257, dtype=U) * _BASE))


def _power(roots: tuple[int, ...], n: int) -> np.ndarray:
    """The powers 0 to n of each root; kept for the next call."""
    p = _powers.get(roots)
    if p is None:
        p = np.ones((2, 1), np.int64)
    while p.shape[1] <= n:
        step = np.array([[pow(r, p.shape[1], int(q))] for r, q in zip(roots, PRIMES[:, 0])])
        p = np.concatenate([p, p * step % PRIMES], axis=1)
    _powers[roots] = p
    return p


_INVERSE = tuple(pow(r, -1, int(q)) for r, q in zip(_ROOTS, PRIMES[:, 0]))


def _sums(values: np.ndarray) -> np.ndarray:
    n = values.shape[1]
    out = np.zeros((2, n + 1), np.int64)
    np.cumsum(values * _power(_ROOTS, n)[:, :n] % PRIMES, axis=1, out=out[:, 1:])
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span of bytes."""
    return _sums(_BYTE[:, data])


def prefix_hash_of(hashes: np.ndarray) -> np.ndarray:
    """The same for spans of units that have 64-bit hashes."""
    return _sums(_residues(hashes))


def span(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Residues of spans; those of neighbours are put together by ``followed``."""
    return (prefix[:, stops] - prefix[:, starts]) % PRIMES * _power(_INVERSE, prefix.shape[1])[:, starts] % PRIMES


def followed(first: np.ndarray, size: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Residues of a span of ``size`` units and another one after it."""
    return (first + second * _power(_ROOTS, int(size.max(initial=0)))[:, size]) % PRIMES


def as_hash(residues: np.ndarray) -> np.ndarray:
    return mix((residues[0].view(U) << U(32)) | residues[1].view(U))


def span_hash(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Equal spans have equal hashes, wherever they are."""
    return as_hash(span(prefix, starts, stops))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first and last row, bytes, and offsets within these bytes."""
    data, offsets = buffers(batch.column(name))
    for i, j in slices(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and document of every word, in order; no word crosses documents."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    begins, ends = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begins] = inside[begins]
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def distinct_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """Number of each word in the list of distinct words, and that list."""
    ends = np.concatenate([[0], np.cumsum(stops - starts)])
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts] += 1
    edges[stops] -= 1
    flat = data[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    coded = found.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_hash(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each word; each distinct word is hashed once."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    code, known = distinct_words(data, starts, stops)
    # made into objects by Arrow itself: a list by way of its scalars takes longer than the hashes
    found = known.to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), U, len(found))[code]


def gram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each word, as far as there are ``n``."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, dtype=U)
    for k in range(n):
        out = out * _BASE + hashes[k : k + m]
    return mix(out)


def gram_hash_at(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """As ``gram_hash``, for the words at the given places alone."""
    out = np.zeros(len(at), dtype=U)
    for k in range(n):
        out = out * _BASE + hashes[at + k]
    return mix(out)


def first_of_groups(same_as_before: np.ndarray) -> np.ndarray:
    """Number of the group of each row, from flags that say: same as the row before."""
    return np.cumsum(~same_as_before) - 1


def joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The given words of each row joined by one space."""
    # each word but the first of its row has a space before it, taken from beyond the text
    spaced = np.append(data, np.uint8(32))
    later = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
    lengths = stops - starts + later
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(offsets[-1]) + np.repeat(starts - later - offsets[:-1], lengths)
    index[offsets[:-1][later]] = len(data)
    per_row = np.concatenate([[0], np.cumsum(np.bincount(row, weights=lengths, minlength=rows).astype(np.int64))])
    return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(per_row.astype(np.int32).tobytes()), pa.py_buffer(spaced[index].tobytes())])


def table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    arrays = (columns[f.name] for f in schema)
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, with each id once.

    Rows without id are left out. Where an id repeats, the row with the smallest text counts (a
    null text is smaller than any other). Ids are counted first; without repeats the texts are
    not moved.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    repeated = docs.groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNotNull(), F.col("text"))).alias("first")).select("doc_id", F.col("first.text").alias("text"))
