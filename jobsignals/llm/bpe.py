"""Byte-level BPE encoding of each distinct word once, and decoding by a join with the pieces.

Texts are split into words as the tokenizer's own pattern does; merges never cross words. A task splits
each text once and keeps, for a batch of some megabytes of documents, the list of its distinct words and
the texts as positions in this list. Words are dealt out by hash; a task sees all lists of one share of the
words one after another, and encodes every distinct word once. The ids are joined back to the batches that have the
word, and take its places there. A word comes at most once in a batch, so that none is too frequent.

Decoding joins the distinct ids of a batch of documents with their pieces. The table of pieces is the vocabulary,
whose size is fixed; it is sent to all tasks, so that the rows of a batch stay in their order and next to each
other, and the pieces take the places of their ids.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from .scratch import Steps
from .words import buffers, one_row_per_id, table

# How the tokenizer splits text (fixed); \s is the white space of Unicode in both engines.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
ROWS_AT_ONCE = 500
# Characters that a batch of documents has, about; one longer text is a batch of its own. The more, the fewer
# words come in several batches; a task holds the distinct words of one batch.
BATCH_CHARS = 16 << 20
# Words in a row of documents, about.
ROW_WORDS = 200_000
# Shares of the words; a task holds the distinct words of one of them.
SHARES = 512
# How hard whole numbers are compressed.
LEVEL = 6
# Kinds of rows of the split texts.
WORDS, COUNTS, TEXTS = range(3)
# A byte that UTF-8 has not stands between words.
BETWEEN = b"\xff"
# Documents that are decoded together, at most.
DECODED_AT_ONCE = 1_000
_SPLIT = regex.compile(PATTERN)
# The same pattern for texts of ASCII alone, which most are; it is twice as fast.
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)

# Rows without share are a batch's documents, the others its words of one share, from number ``first`` on; the row of
# share -1 tells how often each word comes. Places name words by their rank in this count, which takes the fewest bytes.
_BATCHES = pa.schema(
    [("share", pa.int32()), ("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.binary()),
     ("first", pa.int32()), ("words", pa.binary())]
)
_KNOWN = pa.schema([("batch", pa.int64()), ("first", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_BATCH_COLUMNS = "share int, batch long, doc_ids array<long>, sizes array<int>, places binary, first int, words binary"


def _tokenizer(path: str) -> tuple[Tokenizer, dict[str, int]]:
    """The tokenizer, and the special tokens that it finds in a text, with their ids."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
    return t, special


def _sections(special: dict[str, int]):
    """Splits a text at special tokens, longest first where several begin at one place."""
    if not special:
        return lambda text: [text]
    at = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    return at.split


def _parts(batches, rows: int = ROWS_AT_ONCE):
    """The same rows in smaller batches: Python objects made of a batch take many times its size."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _ids(t: Tokenizer, words: list[str]) -> list[bytes]:
    return [np.array(e.ids, "<i4").tobytes() for e in t.encode_batch(words, add_special_tokens=False)]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on: how many bytes the greatest one has, then the lowest bytes of all, the next ones
    and so on, compressed; the higher bytes are mostly equal."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), LEVEL)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), "u1").reshape(data[0], -1)
    out = np.zeros(planes.shape[1], np.int64)
    for k, plane in enumerate(planes):
        out += plane.astype(np.int64) << (8 * k)
    return out


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Numbers of words, the most frequent first."""
    return np.argsort(-counts, kind="stable")


class _Numbers(dict):
    """Numbers words from 0 as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _batched(special: dict[str, int]):
    """Batches of documents with their distinct words; the smallest doc_id names a batch."""

    def run(batches):
        cut, numbers, ids, sizes, places, size = _sections(special), _Numbers(), [], [], [], 0

        def full():
            words = [w.encode() for w in numbers]
            share = [xxhash.xxh3_64_intdigest(w) % SHARES for w in words]
            order = np.array(sorted(range(len(words)), key=lambda k: (share[k], words[k])), np.int64)  # in order they compress well
            number = np.empty(len(words), np.int32)
            number[order] = np.arange(len(words))
            at = np.concatenate(places)
            counts = np.zeros(len(words), np.int64)
            counts[number] = np.bincount(at, minlength=len(words))
            rank = np.empty(len(words), np.int32)
            rank[_by_count(counts)] = np.arange(len(words))
            at = rank[number][at]
            words, share = [words[k] for k in order.tolist()], np.array(share, np.int64)[order]
            first = np.flatnonzero(np.diff(share, prepend=-1))
            cuts, n = [*first.tolist(), len(words)], len(first)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            row = ends[:-1] // ROW_WORDS  # documents that begin in one stretch of words are a row
            docs = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(ids)]
            spans = list(zip(docs[:-1], docs[1:]))
            none = [None] * len(spans)
            columns = {
                "share": none + [-1] + share[first].tolist(), "batch": [min(ids)] * (n + 1 + len(spans)), "doc_ids": [ids[a:b] for a, b in spans] + [None] * (n + 1),
                "sizes": [sizes[a:b] for a, b in spans] + [None] * (n + 1), "places": [_packed(at[ends[a] : ends[b]]) for a, b in spans] + [None] * (n + 1),
                "first": none + [-1] + cuts[:-1], "words": none + [_packed(counts)] + [BETWEEN.join(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:])],
            }
            return table(columns, _BATCHES)

        for batch in _parts(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                findall = (_SPLIT_ASCII if text is None or text.isascii() else _SPLIT).findall
                found = [w for s in cut(text) for w in ([s] if s in special else findall(s))] if text else []
                places.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(doc)
                sizes.append(len(found))
                size += len(text or "")
                if size >= BATCH_CHARS:
                    yield full()
                    numbers, ids, sizes, places, size = _Numbers(), [], [], [], 0
        if ids:
            yield full()

    return run


def _encoded(path: str):
    """The ids of the words of each row; rows of one share come together, and its words are encoded once."""

    def run(batches):
        t, known, share = _tokenizer(path)[0], {}, None
        for batch in batches:
            shares = batch.column("share").to_numpy()
            words = [row.split(BETWEEN) for row in batch.column("words").to_pylist()]
            sizes, ids = [], []
            cuts = [*np.flatnonzero(np.diff(shares, prepend=-1)).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if shares[a] != share:
                    known, share = {}, shares[a]
                new = list(dict.fromkeys(w for row in words[a:b] for w in row if w not in known))
                known.update(zip(new, _ids(t, [w.decode() for w in new])))
                for row in words[a:b]:
                    found = [known[w] for w in row]
                    sizes.append(_packed(np.array([len(x) // 4 for x in found])))
                    ids.append(_packed(np.frombuffer(b"".join(found), "<i4")))
            del words
            yield table({"batch": batch.column("batch"), "first": batch.column("first"), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())}, _KNOWN)

    return run


def _put_in(batches):
    """The ids of each word in its places; of each batch the words come first."""
    current, known, each = None, [], None
    for batch in batches:
        number, kinds = (batch.column(c).to_pylist() for c in ("batch", "kind"))
        for k in range(batch.num_rows):
            if number[k] != current:
                current, known, each = number[k], [], None
            if kinds[k] == 0:
                first, *row = (batch.column(c)[k].as_py() for c in ("first", "lengths", "ids"))
                if first < 0:
                    number_of = _by_count(_unpacked(row[1]))
                else:
                    known.append((first, *row))
                continue
            if each is None:
                known.sort()
                each, data = (np.concatenate([np.zeros(0, np.int64), *(_unpacked(x[c]) for x in known)]) for c in (1, 2))
                begins, known = np.cumsum(each) - each, []
            sizes, places = batch.column("sizes")[k].values.to_numpy().astype(np.int64), number_of[_unpacked(batch.column("places")[k].as_py())]
            ends = np.concatenate([[0], np.cumsum(each[places])]).astype(np.int64)
            index = np.arange(ends[-1]) + np.repeat(begins[places] - ends[:-1], each[places])
            offsets = np.concatenate([[0], ends[np.cumsum(sizes)]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(data[index], pa.int32()))
            yield table({"doc_id": batch.column("doc_ids")[k].values, "ids": lists}, _IDS)


def _words_and_places(docs: DataFrame, path: str) -> DataFrame:
    """Rows for ``_put_in``: of each batch the ids of its words, then its documents."""
    steps = Steps(docs.sparkSession)
    special = _tokenizer(path)[1]
    what = F.when(F.col("share").isNull(), TEXTS).when(F.col("share") < 0, COUNTS).otherwise(WORDS)
    batched = one_row_per_id(docs).mapInArrow(_batched(special), _BATCH_COLUMNS).withColumn("what", what)
    split = steps.write(batched, "split", "zstd", "what")
    words = split.filter(F.col("what") == WORDS).select("share", "batch", "first", "words").repartition("share").sortWithinPartitions("share")
    known = steps.write(words.mapInArrow(_encoded(path), "batch long, first int, sizes binary, ids binary"), "known", "zstd")
    steps.remove_part("split", "what", WORDS)
    known = known.select("batch", "first", F.col("sizes").alias("lengths"), "ids")
    counts = split.filter(F.col("what") == COUNTS).select("batch", "first", F.lit(None).cast("binary").alias("lengths"), F.col("words").alias("ids"))
    known = known.union(counts).withColumn("kind", F.lit(0))
    texts = split.filter(F.col("what") == TEXTS).select("batch", F.lit(1).alias("kind"), "doc_ids", "sizes", "places")
    return known.unionByName(texts, allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", "kind")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of the whole text without added special tokens.

    ``path`` is the file of a byte-level tokenizer; executors read it too. Special tokens that
    stand in a text get their ids. Null and empty texts have no ids. Rows without id are left
    out, and of rows with one id the smallest text counts. Other columns are not read. An empty
    table gives an empty result.
    """
    return _words_and_places(docs, path).mapInArrow(_put_in, "doc_id long, ids array<int>")


def pieces(path: str) -> list[tuple[int, bytes]]:
    """Every id with its bytes; as many rows as the tokenizer has pieces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the fixed letters that stand for bytes: printable ones for themselves, the rest from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    by_id = {i: bytes(letter[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    by_id |= {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    return sorted(by_id.items())


_ROWS = pa.schema([("id", pa.int32()), ("own", pa.binary())])


def _unrolled(batches):
    """A row for each distinct id of some documents; the first one carries the documents, as the bytes of a batch
    that has the places of the ids as one more column."""
    for batch in _parts(batches, DECODED_AT_ONCE):
        if not batch.num_rows:
            continue
        lists = batch.column("ids")
        known, places = np.unique(pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False), return_inverse=True)
        known = known if len(known) else np.array([-1])  # no piece has this id
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        places = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(places.astype(np.int32)))
        rows = pa.RecordBatch.from_arrays([*batch.columns, places], names=[*batch.schema.names, ""])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_batch(rows)
        yield table({"id": known, "own": pa.array([sink.getvalue().to_pybytes()] + [None] * (len(known) - 1), pa.binary())}, _ROWS)


def _texts(schema: pa.Schema):
    """Documents and their texts, from the rows of their pieces."""

    def run(batches):
        own, pieces = None, []

        def closed():
            rows = pa.ipc.open_stream(own).read_next_batch()
            places = rows.columns[-1]
            at, ends = places.values.to_numpy().tolist(), places.offsets.to_numpy().tolist()
            texts = [b"".join([pieces[k] for k in at[a:b]]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            return pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string())], schema=schema)

        for batch in batches:
            column, found = batch.column("own"), [x or b"" for x in batch.column("piece").to_pylist()]
            before = 0
            for k in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)).tolist():
                pieces += found[before:k]
                if own is not None:
                    yield closed()
                own, pieces, before = column[k].as_py(), [], k
            pieces += found[before:]
        if own is not None:
            yield closed()

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` but one named ``text``, and ``text``, the pieces of its ``ids`` together.

    Bytes that are not UTF-8 become U+FFFD; null ids give an empty text, ids outside the vocabulary
    nothing. Each row is decoded for itself, with or without id. An empty table gives an empty result.
    """
    columns = [c for c in encoded.columns if c != "text"]
    rows = encoded.select(*columns)
    return _with_texts(rows.mapInArrow(_unrolled, "id int, own binary"), rows, path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``text``: what ``decode`` makes of ``encode``, without ids on the way between them."""
    rows = _words_and_places(docs, path).mapInArrow(lambda batches: _unrolled(_put_in(batches)), "id int, own binary")
    return _with_texts(rows, docs.sparkSession.createDataFrame([], "doc_id long, ids array<int>"), path)


def _with_texts(rows: DataFrame, like: DataFrame, path: str) -> DataFrame:
    """Documents with the columns of ``like`` and their texts, from the rows of their ids."""
    steps = Steps(rows.sparkSession)
    vocabulary = steps.write(rows.sparkSession.createDataFrame(pieces(path), "id int, piece binary").coalesce(1), "pieces")
    joined = rows.join(F.broadcast(vocabulary), "id", "left").select("own", "piece")
    out = like.withColumn("text", F.lit("x")).schema
    return joined.mapInArrow(_texts(to_arrow_schema(out)), out)
