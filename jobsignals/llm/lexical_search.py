"""Ranked lexical search over an index that is stratified by document length.

The weight of a term in a document depends on its occurrences tf and on the document's normaliser m
alone, and m on the document's length. Documents of equal m are a stratum. A stratum is indexed in
pieces of bounded size: for each term its occurrences tf, and for each tf the documents. So the impact of
a posting list is computed once per (m, tf), never per document.

The largest tf of a term in a piece bounds what any of its documents can score for a query. A query
visits the pieces with its highest bounds first; the k-th best score found there is a floor, and
all further pieces whose bound is below it are left out. Scores are whole numbers, so results are exact.

Queries are a stated set that goes against all documents, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Steps
from .words import distinct_words, lower, one_row_per_id, table, texts, words

TOP = 10
# Fixed by the score: unit of an impact, share of the length in the normaliser.
UNIT = 1_000_000_000
LENGTH_PERCENT = 90
# Postings in a piece of a stratum (one document may have more), terms of all queries in a block.
PIECE = 1 << 15
BLOCK = 1 << 17
# Pieces each query visits first.
FIRST = 4
# Scores of (query, document) held at once.
CELLS = 1 << 20

# Every ASCII character but letters and digits separates terms.
_SEPARATES = np.ones(256, bool)
_SEPARATES[128:] = False
_SEPARATES[[b for b in range(128) if chr(b).isalnum()]] = False

_TERMS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))])
_PIECES = pa.schema(
    [("m", pa.int64()), ("piece", pa.int64()), ("n_docs", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32())),
     ("sizes", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64()))]
)
_BOUNDS = pa.schema([("item_id", pa.int64()), ("m", pa.int64()), ("piece", pa.int64()), ("bound", pa.int64())])
_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return ", ".join(f"{f.name} {f'array<{names[f.type.value_type]}>' if pa.types.is_list(f.type) else names[f.type]}" for f in schema)


def _lists(counts: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), values)


def _counted(batches):
    for batch in batches:
        for i, j, data, offsets in texts(batch):
            low = lower(data)
            starts, stops, row = words(low, offsets, _SEPARATES)
            code, known = distinct_words(low, starts, stops)
            pairs, tf = np.unique(row * max(len(known), 1) + code, return_counts=True)
            of, code = np.divmod(pairs, max(len(known), 1))
            per = np.bincount(of, minlength=j - i)
            terms = known.take(pa.array(code)).cast(pa.binary()).cast(pa.string())
            yield table(
                {"doc_id": batch.column("doc_id").slice(i, j - i), "n": np.bincount(row, minlength=j - i), "terms": _lists(per, terms),
                 "tfs": _lists(per, pa.array(tf.astype(np.int32)))},
                _TERMS,
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n (all terms), its distinct terms and how often each occurs.

    Terms are runs of ASCII letters, digits and any other character above ASCII, A-Z in lower case.
    """
    return one_row_per_id(docs).mapInArrow(_counted, _ddl(_TERMS))


def _pieces(most: int):
    """Pieces of strata from postings in order of m and document."""

    def pack(x) -> pa.RecordBatch:
        m, docs = int(x["m"][0]), x["doc_id"]
        code = x["term"].dictionary_encode()
        order = np.lexsort((docs, x["tf"], code.indices.to_numpy(zero_copy_only=False)))
        at, tf, docs = code.indices.to_numpy(zero_copy_only=False)[order], x["tf"][order], docs[order]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (tf[1:] != tf[:-1])])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        return table(
            {"m": [m], "piece": [int(docs.min())], "n_docs": [len(np.unique(docs))], "terms": _lists([len(first)], code.dictionary.take(pa.array(at[first]))),
             "tfs": _lists([len(first)], pa.array(tf[first].astype(np.int32))), "sizes": _lists([len(first)], pa.array(sizes.astype(np.int32))),
             "docs": _lists([len(docs)], pa.array(docs))},
            _PIECES,
        )

    def cut(x, a, b):
        return {"m": x["m"][a:b], "doc_id": x["doc_id"][a:b], "tf": x["tf"][a:b], "term": x["term"].slice(a, b - a)}

    def run(batches):
        held = None
        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "doc_id", "tf")} | {"term": batch.column("term")}
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in ("m", "doc_id", "tf")} | {"term": pa.concat_arrays([held["term"], x["term"]])}
            n = len(x["m"])
            if not n:
                continue
            # a piece ends with its stratum, or with the document that fills it
            last = np.flatnonzero((x["m"][1:] != x["m"][:-1]) | (x["doc_id"][1:] != x["doc_id"][:-1])) + 1
            begin = 0
            for end in last:
                if end - begin >= most or x["m"][end] != x["m"][end - 1]:
                    yield pack(cut(x, begin, end))
                    begin = int(end)
            held = cut(x, begin, n)
        if held is not None:
            yield pack(held)

    return run


def length_index(docs: DataFrame, steps: Steps, wanted: DataFrame | None = None, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The index (one row per piece of a stratum), and ``term``, ``w``: the weight of each term.

    ``wanted`` (column ``term``, without repeats) leaves other terms out of the index. Counts of
    documents and terms are those of the whole collection in any case.
    """
    counted = term_counts(docs).filter("n > 0")
    # the row of the empty term stands for the document itself
    all_ = counted.select(
        "doc_id", "n", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "terms").alias("term"), F.concat(F.array(F.lit(0)), "tfs").alias("tf"))).alias("p")
    ).select("doc_id", "n", "p.term", "p.tf")
    if wanted is not None:
        all_ = all_.join(wanted.select("term").union(wanted.sparkSession.range(1).select(F.lit("").alias("term"))), "term", "left_semi")
    postings = steps.write(all_.select("doc_id", "n", "term", "tf"), "postings")
    total = postings.filter("term = ''").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total.docs, max(total.terms or 0, 1)
    rest = f"{100 - LENGTH_PERCENT} + ({LENGTH_PERCENT} * n * {n_docs}L) div {n_terms}L"
    found = postings.filter("term <> ''")
    placed = found.select(F.expr(rest).alias("m"), "doc_id", "term", "tf").repartitionByRange("m", "doc_id").sortWithinPartitions("m", "doc_id")
    index = steps.write(placed.mapInArrow(_pieces(piece), _ddl(_PIECES)), "index")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = steps.write(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight.alias("w")), "weights")
    steps.remove("postings")
    return index, weights


class _Block:
    """The terms of a block of queries: for each term its weight and the queries that hold it."""

    def __init__(self, rows):
        rows = sorted((r.term, r.w, r.item_id) for r in rows)
        self.items = np.array(sorted({r[2] for r in rows}), np.int64)
        terms = sorted({r[0] for r in rows})
        self.number = {t: k for k, t in enumerate(terms)}
        of = np.array([self.number[r[0]] for r in rows], np.int64)
        self.weight = np.zeros(len(terms), np.int64)
        self.weight[of] = [r[1] for r in rows]
        self.item = np.searchsorted(self.items, np.array([r[2] for r in rows], np.int64))
        self.first = np.searchsorted(of, np.arange(len(terms) + 1))


class _Piece:
    """The posting lists of one piece that some query of the block asks for."""

    def __init__(self, block: _Block, m: int, terms: pa.Array, tfs: np.ndarray):
        coded = terms.dictionary_encode()
        number = np.array([block.number.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
        term = number[coded.indices.to_numpy(zero_copy_only=False)]
        self.asked = np.flatnonzero(term >= 0)
        self.term = term[self.asked]
        tf = tfs[self.asked].astype(np.int64)
        self.value = block.weight[self.term] * (UNIT * tf // (1000 * tf + 8 * m))

    def bounds(self, block: _Block) -> np.ndarray:
        """The most that a document of this piece can score, for each query."""
        best = np.zeros(len(block.weight), np.int64)
        np.maximum.at(best, self.term, self.value)
        per = np.repeat(best, np.diff(block.first))
        out = np.zeros(len(block.items), np.int64)
        np.add.at(out, block.item, per)
        return out


def _bounds(shared, visits: int):
    def run(batches):
        block, best = shared.value, None
        for batch in batches:
            for k in range(batch.num_rows):
                m, piece = batch.column("m")[k].as_py(), batch.column("piece")[k].as_py()
                bound = _Piece(block, m, batch.column("terms")[k].values, batch.column("tfs")[k].values.to_numpy()).bounds(block)
                new = np.stack([bound, np.full(len(bound), m), np.full(len(bound), piece)])[:, :, None]
                best = new if best is None else np.concatenate([best, new], axis=2)
                if best.shape[2] > 8 * visits:
                    best = _largest(best, visits)
        if best is not None and best.shape[1]:
            best = _largest(best, visits)
            items = np.repeat(block.items, best.shape[2])
            bound, m, piece = best.reshape(3, -1)
            some = bound > 0
            yield table({"item_id": items[some], "m": m[some], "piece": piece[some], "bound": bound[some]}, _BOUNDS)

    return run


def _largest(best: np.ndarray, visits: int) -> np.ndarray:
    order = np.argsort(-best[0], axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(best, order[None], axis=2)


def _scored(shared, floors, top: int):
    """The best documents of a task for each query, from pieces whose bound reaches the floor."""

    def run(batches):
        block, floor = shared.value, np.maximum(floors.value, 1)
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for k in range(batch.num_rows):
                m, docs = batch.column("m")[k].as_py(), batch.column("docs")[k].values.to_numpy()
                piece = _Piece(block, m, batch.column("terms")[k].values, batch.column("tfs")[k].values.to_numpy())
                live = np.flatnonzero(piece.bounds(block) >= floor)
                if not len(live):
                    continue
                sizes = batch.column("sizes")[k].values.to_numpy().astype(np.int64)
                begins = (np.cumsum(sizes) - sizes)[piece.asked]
                ids, place = np.unique(docs, return_inverse=True)
                step = max(1, CELLS // len(ids))
                for a in range(0, len(live), step):
                    new = _documents(block, piece, begins, sizes[piece.asked], place, ids, live[a : a + step], floor)
                    held = [np.concatenate(x) for x in zip(held, new)]
                    if len(held[0]) > 4 * top * len(block.items):
                        held = _best(held, top)
                        full = np.bincount(held[0], minlength=len(floor)) == top
                        least = np.full(len(floor), np.iinfo(np.int64).max)
                        np.minimum.at(least, held[0], held[2])
                        floor = np.where(full, np.maximum(floor, least), floor)
        item, doc, score = _best(held, top)
        yield table({"item_id": block.items[item], "doc_id": doc, "score": score}, _FOUND)

    return run


def _documents(block, piece, begins, sizes, place, ids, live, floor):
    """Query number, document and score of all documents of a piece that reach the floor."""
    number = np.full(len(block.items), -1)
    number[live] = np.arange(len(live))
    mine = number[block.item]
    first = np.concatenate([[0], np.cumsum(mine >= 0)])[block.first]
    mine = mine[mine >= 0]
    scores = np.zeros(len(live) * len(ids), np.int64)
    queries = np.diff(first)[piece.term]
    # a list for each query that asks for it, then a place for each of its documents
    of = np.repeat(np.arange(len(piece.term)), queries)
    query = mine[np.arange(len(of)) - np.repeat(np.cumsum(queries) - queries, queries) + first[piece.term][of]]
    ends = np.cumsum(sizes[of])
    i = 0
    while i < len(of):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CELLS, "right")))
        n, lists = sizes[of[i:j]], of[i:j]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[lists], n)
        cell, value = np.repeat(query[i:j], n) * len(ids) + place[entry], np.repeat(piece.value[lists], n)
        if len(value) * int(piece.value.max()) < 1 << 53:  # then sums of doubles are exact
            scores += np.bincount(cell, weights=value, minlength=len(scores)).astype(np.int64)
        else:
            np.add.at(scores, cell, value)
        i = j
    good = np.flatnonzero(scores >= np.repeat(floor[live], len(ids)))
    return live[good // len(ids)], ids[good % len(ids)], scores[good]


def _best(held, top: int):
    item, doc, score = held
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    first = np.searchsorted(item, item, "left")
    keep = np.arange(len(item)) - first < top
    return [item[keep], doc[keep], score[keep]]


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP, piece: int = PIECE, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """The ``top`` best documents of each query: item_id, rank (from 1), doc_id, score.

    ``queries`` has item_id and text. Equal scores are ranked by doc_id, and only scores above 0
    count, so a query may have fewer rows or none. Null and empty texts have no terms and are neither
    found nor find anything. Rows without id are left out, and of rows with one id the smallest text
    counts, on both sides. Other columns are not read. If either table is empty, so is the result.
    A task holds the terms of one block of queries, some ``block`` or those of one longer query, and one
    piece of the index at a time. ``piece``, ``block`` and ``first`` do not change the result.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    asked = term_counts(queries.select(F.col("item_id").alias("doc_id"), "text"))
    asked = steps.write(asked.select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")), "queries")
    index, weights = length_index(docs, steps, asked.select("term").distinct(), piece)
    asked = steps.write(asked.join(weights, "term").filter("w > 0"), "asked")
    blocks = -(-asked.count() // block)
    parts = []
    for number in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        if rows:
            parts.append(_search_block(spark, steps, index, _Block(rows), top, first))
    steps.remove("index", "queries", "weights", "asked")
    found = parts[0] if parts else spark.createDataFrame([], _ddl(_FOUND))
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _search_block(spark, steps: Steps, index: DataFrame, block: _Block, top: int, visits: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)
    none = spark.sparkContext.broadcast(np.zeros(len(block.items), np.int64))
    order = Window.partitionBy("item_id").orderBy(F.desc("bound"), "m", "piece")
    bounds = index.select("m", "piece", "terms", "tfs").mapInArrow(_bounds(shared, visits), _ddl(_BOUNDS))
    first = bounds.withColumn("visit", F.row_number().over(order)).filter(F.col("visit") <= visits).select("m", "piece").distinct()
    seen = index.join(first, ["m", "piece"], "left_semi").mapInArrow(_scored(shared, none, top), _ddl(_FOUND))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    floor = seen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == top).select("item_id", "score").collect()
    floors = np.zeros(len(block.items), np.int64)
    floors[np.searchsorted(block.items, [r.item_id for r in floor])] = [r.score for r in floor]
    return steps.write(index.mapInArrow(_scored(shared, spark.sparkContext.broadcast(floors), top), _ddl(_FOUND)), "found")
