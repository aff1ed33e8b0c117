"""Empty tables, clashing columns, missing and repeated ids, and the pipeline."""

import brute
import public_tokenizers
import numpy as np
import pytest
import texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from jobsignals.llm import queries
from jobsignals.llm.bpe import encode
from jobsignals.llm.embedding_dedup import near_vectors
from jobsignals.llm.line_dedup import line_dedup
from jobsignals.llm.minhash_dedup import near_duplicates
from jobsignals.llm.packing import boundaries, pack
from jobsignals.llm.quality import quality_rules
from jobsignals.llm.quality_model import score_quality
from jobsignals.llm.resampling import importance_resample
from jobsignals.llm.sharding import equal_text_links, shard
from jobsignals.llm.substring_dedup import substring_dedup
from jobsignals.llm.suffix_dedup import suffix_dedup
from jobsignals.llm.token_counts import context_limits, encoded_lengths, quantiles
from test_others import BPE

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

CLASH = ("key", "salt", "n", "lo", "units", "spans", "runs", "rows", "total", "count", "value", "root", "size", "shard", "label", "part", "kept", "ids", "own", "word", "gone", "line")

OPERATORS = {
    "substring": substring_dedup,
    "suffix": suffix_dedup,
    "near": near_duplicates,
    "lines": line_dedup,
    "quality": quality_rules,
    "encode": lambda d: encode(d, BPE),
    "pack": lambda d: pack(encoded_lengths(d, RANKS)),
    "lengths": lambda d: encoded_lengths(d, RANKS),
    "score": lambda d: score_quality(d, d.sparkSession.createDataFrame([(1, 0), (2, 1), (3, 0), (5, 1)], "doc_id long, quality int")),
    "resample": lambda d: importance_resample(d, d.sparkSession.createDataFrame([("a b",)], "text string")),
    "shard": lambda d: shard(d, equal_text_links(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_texts_of_null(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], texts.SCHEMA)).collect() == []
    nulls = OPERATORS[name](spark.createDataFrame([(1, None), (2, None)], texts.SCHEMA))
    assert sorted(r.doc_id for r in nulls.collect()) == [1, 2]


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_and_their_names_do_not_matter(spark, name):
    df = spark.createDataFrame(texts.edited(11, 25), texts.SCHEMA)
    more = df.select(*[F.lit(None).cast("string").alias(c) for c in CLASH], "text", "doc_id")
    left, right = (sorted(map(str, OPERATORS[name](d).collect())) for d in (df, more))
    assert left == right


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "shard"])
def test_rows_without_id_go_and_repeated_ids_count_once(spark, name):
    rows = [(1, "a b c d e f g h i j k l m n o p"), (1, "a a"), (2, None), (2, "z"), (None, "q"), (3, "x"), (3, "x")]
    got = OPERATORS[name](spark.createDataFrame(rows, texts.SCHEMA)).collect()
    want = OPERATORS[name](spark.createDataFrame([(1, "a a"), (2, None), (3, "x")], texts.SCHEMA)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_vectors_edges(spark):
    schema = "vec_id long, embedding array<float>, root long, n long"
    assert near_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 2.0], 1, 1), (1, [1.0, 2.0], 1, 1), (None, [1.0, 2.0], 1, 1), (2, [1.0, 2.0], 1, 1), (3, None, 1, 1)]
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.edited(21, 40)]
    rows += [(100 + i, t, None, "s", None) for i, t in texts.lines(5, 30)]
    rows += [(200 + i, t, None, None, 0) for i, (_, t) in enumerate(texts.passages(9, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = {r[0]: r[1] for r in rows if brute.quality(r[1])[-1]}
    docs = {i: x[3] for i, x in brute.line_dedup(docs.items()).items() if not x[2]}
    docs = {i: docs[i] for i, x in brute.near_duplicates(list(docs.items()), 80).items() if x[2]}
    seen = brute.suffix_dedup(docs.items())
    left = [i for i, x in seen.items() if x[1] < x[0] or x[0] == 0]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(left)
    untouched = {i for i in left if seen[i][1] == 0}
    size = {i: sum(r.n_tokens for r in got if r.doc_id == i) for i in left}
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    assert untouched and all(size[i] == len(t.encode(docs[i], add_special_tokens=False).ids) + 1 for i in untouched)
    lengths = {}
    for r in got:
        lengths[r.n_tokens] = lengths.get(r.n_tokens, 0) + 1
    assert {r.bucket_tokens for r in got} == set(boundaries(list(lengths), list(lengths.values()), 16))
    stage = corpus_pipeline.STAGES[3][1](spark, df, str(tmp_path))
    assert stage.columns == df.columns


def test_a_repeated_line_above_short_ones_costs_no_document(spark):
    unique = [[f"w{i}x{k}" for k in range(40)] for i in range(3)]
    rows = [(i, "the same long sentence here\n" + "\n".join(u)) for i, u in enumerate(unique)]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, texts.SCHEMA).withColumn("n_chars", F.lit(1).cast("long")), "").collect()}
    assert got == {0: rows[0][1]} | {i: "\n".join(unique[i]) for i in (1, 2)}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_repeated_ids_nulls_more_columns_and_no_rows(spark, name, stage):
    schema = "kept string, text string, doc_id long, n_chars long, source string, gone map<string,int>"
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text + " b", 1, 1, "late", None), ("k", text + " a", 1, 1, "first", {"x": 1}), (None, "z", None, 1, "s", None), ("k", None, 2, 1, "null", None), (None, "x", 2, 1, "s", None),
            (None, " ".join(f"q{k}" for k in range(60)), 3, 1, "s", None), (None, "", 4, 0, "s", None)]
    df = spark.createDataFrame(rows, schema)
    got = stage(spark, df, "")
    found = {r.doc_id: r for r in got.collect()}
    assert stage(spark, df.limit(0), "").collect() == []
    if name != "packing":
        assert got.columns == df.columns and got.count() == len(found)
        assert (found[1].source, found[1].kept, found[1].gone) == ("first", "k", {"x": 1}) and found[1].text == text + " a"
    assert set(found) == ({1, 3} if name == "quality" else {1, 2, 3, 4})


def test_limits_of_other_columns_repeated_lengths_and_no_rows(spark):
    lengths = spark.createDataFrame([(7, "x", 4), (8, "x", 4), (9, "x", 2)], "band long, docs string, length long")
    plain = context_limits(lengths.select("length"))
    assert sorted(map(tuple, context_limits(lengths).collect())) == sorted(map(tuple, plain.collect())) and plain.count() == 2
    nothing = quantiles(context_limits(lengths.limit(0)), [0.5, 1.0]).collect()
    assert [tuple(r) for r in nothing] == [(0.5, None), (1.0, None)]


def test_sorting_and_hashing_less_gives_the_same():
    """Only rows whose key repeats are sorted by the other columns; only the windows asked for are hashed."""
    from jobsignals.llm import passages, words

    draw = np.random.default_rng(3)
    key, units, doc, lo = (draw.integers(0, n, 5_000).astype(np.uint64) for n in (2_500, 2, 3, 10**9))
    assert (passages._sorted(key, units, doc, lo) == np.lexsort((lo, doc, units, key))).all()
    assert len(passages._sorted(*[np.zeros(0, np.uint64)] * 4)) == 0
    at = np.array([0, 7, 4_000])
    assert (words.gram_hash_at(units, at, 13) == words.gram_hash(units, 13)[at]).all()
    data = np.frombuffer(b"aa b aa \xc3\xa9 b", np.uint8)
    starts, stops, _ = words.words(data, np.array([0, len(data)]))
    assert words.word_hash(data, starts, stops).tolist() == [words.xxhash.xxh3_64_intdigest(w) for w in data.tobytes().split()]
