"""Deduplication of lines, passages, documents and vectors against brute force."""

import random

import brute
import numpy as np
import pytest
import texts
from pyspark.sql import functions as F

from jobsignals.llm import embedding_dedup, minhash_dedup, passages, suffix_dedup
from jobsignals.llm.components import components
from jobsignals.llm.embedding_dedup import near_vectors
from jobsignals.llm.line_dedup import line_dedup, within_one_edit
from jobsignals.llm.minhash_dedup import near_duplicates
from jobsignals.llm.quality import quality_rules
from jobsignals.llm.scratch import Steps
from jobsignals.llm.substring_dedup import substring_dedup
from jobsignals.llm.suffix_dedup import longest_previous


def by_id(df):
    rows = df.collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def hashed(df):
    return by_id(df.withColumn("kept", F.sha2("kept", 256)))


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_passages_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(passages, "CROWD", crowd)
    rows = texts.passages(crowd)
    df = spark.createDataFrame(rows, texts.SCHEMA)
    assert hashed(substring_dedup(df)) == brute.substring_dedup(rows)
    assert hashed(suffix_dedup.suffix_dedup(df)) == brute.suffix_dedup(rows)


def test_an_earlier_copy_in_another_partition_meets_exact_and_edited_copies(spark):
    r = random.Random(6)
    first, others = [], []
    for k in range(40):
        w = [f"w{r.randrange(10**6)}" for _ in range(60)]
        first.append((k, " ".join(w)))
        others.append((100 + 2 * k, " ".join(w)))
        w[r.randrange(60)] = "edited"
        others.append((101 + 2 * k, " ".join(w)))
    df = texts.in_parts(spark, first, others)
    assert hashed(substring_dedup(df)) == brute.substring_dedup(first + others)
    assert hashed(suffix_dedup.suffix_dedup(df)) == brute.suffix_dedup(first + others)


def test_a_passage_twice_in_one_document_meets_an_earlier_one_in_another_partition(spark):
    r = random.Random(7)
    first, others = [], []
    for k in range(40):
        passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
        first.append((k, passage))
        others.append((100 + k, f"{passage} x{k} {passage}"))
    df = texts.in_parts(spark, first, others)
    assert hashed(substring_dedup(df)) == brute.substring_dedup(first + others)
    assert hashed(suffix_dedup.suffix_dedup(df)) == brute.suffix_dedup(first + others)


def test_suffix_dedup_reads_long_texts_in_parts(spark, monkeypatch):
    r = random.Random(1)
    block = "".join(r.choice("abcd") for _ in range(700))
    rows = [(1, "".join(r.choice("abcd ") for _ in range(4000)) + block), (2, block[50:] + "".join(r.choice("ef") for _ in range(3000)) + block)]
    keys = suffix_dedup._keys(100, 40)
    data = np.frombuffer(rows[1][1].encode(), np.uint8)
    whole = [np.concatenate(x) for x in zip(*[y[:3] for y in keys(data, np.array([0, len(data)]))])]
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 500)
    parts = [np.concatenate(x) for x in zip(*[y[:3] for y in keys(data, np.array([0, len(data)]))])]
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_longest_previous_factor_equals_definition():
    r = np.random.default_rng(0)
    for _ in range(60):
        n, length = r.integers(1, 50), 6
        data = r.integers(97, 99, n + length - 1).astype(np.uint8)

        def common(i, j):
            return next((k for k in range(length) if data[i + k] != data[j + k]), length)

        want = [max((common(i, j) for j in range(i)), default=0) for i in range(n)]
        assert list(longest_previous(data, np.arange(n), length)) == want


@pytest.mark.parametrize("rounds", [3, 0])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash_dedup, "ROUNDS", rounds)
    rows = texts.edited(7 + rounds, 150)
    got = by_id(near_duplicates(spark.createDataFrame(rows, texts.SCHEMA)))
    assert got == brute.near_duplicates(rows)
    assert sum(not x[2] for x in got.values()) > 30


def test_a_crowd_of_near_copies_is_one_group_without_all_pairs(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(120):
        w = list(base)
        w[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join(f"q{r.randrange(10**6)}" for _ in range(100)) + " " + " ".join(base[:60])) for i in range(30)]
    got = by_id(near_duplicates(spark.createDataFrame(rows, texts.SCHEMA)))
    assert got == brute.near_duplicates(rows)


def test_lines_equal_brute_force(spark):
    rows = texts.lines(3)
    assert by_id(line_dedup(spark.createDataFrame(rows, texts.SCHEMA))) == brute.line_dedup(rows)


def test_within_one_edit_equals_edit_distance():
    r = random.Random(2)
    for _ in range(2000):
        a, b = ([r.choice("ab") for _ in range(r.randrange(6))] for _ in range(2))
        assert within_one_edit(a, b) == (brute.edits(a, b) <= 1)


@pytest.mark.parametrize("tile", [4000, 8])
def test_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    r = np.random.default_rng(tile)
    rows = [(0, None), (1, [0.0, 0.0]), (2, [1.0, None]), (3, [1.0, float("nan")]), (4, []), (5, [float("inf"), 1.0])]
    for k in range(6, 150):
        old = [v for _, v in rows[6:] if len(v) == 16]
        v = r.standard_normal(r.choice([1, 2, 16], p=[0.1, 0.1, 0.8])) * 10.0 ** r.integers(-30, 30)
        if old and r.random() < 0.5:
            v = np.array(old[r.integers(len(old))])
            v = v * r.choice([1.0, 2.0]) + r.choice([0.0, 0.02, 0.3]) * np.linalg.norm(v) * r.standard_normal(16) / 4
        rows.append((k, [float(x) for x in v]))
    got = by_id(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == brute.near_vectors(rows)


def test_vectors_are_sent_in_rounds_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 8)
    monkeypatch.setattr(embedding_dedup, "LARGEST", 8)
    monkeypatch.setattr(embedding_dedup, "SENT", 1)
    written, write = [], Steps.write
    monkeypatch.setattr(Steps, "write", lambda self, df, name, *a, **b: written.append(name) or write(self, df, name, *a, **b))
    r = np.random.default_rng(1)
    v = r.standard_normal((40, 8)).astype(np.float32)
    v[20:] = v[:20] + 0.1 * v[r.integers(20, size=20)]
    rows = [(k, [float(x) for x in v[k]]) for k in range(40)]
    assert by_id(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == brute.near_vectors(rows)
    assert written.count("found") > 4


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_different_words_of_regular_build_stay_different(spark, size):
    a, b = texts.regular_words(size)
    w = [f"w{k}" for k in range(13)]
    rows = [(1, f"{a} {a} {a} {a}"), (2, f"{b} {b} {b} {b}"), (3, " ".join([*w[:6], a, *w[6:]])), (4, " ".join([*w[:6], b, *w[6:]])), (5, " ".join([*w[:7], *w[6:], a])),
            (6, f"{a} x y z t u\n{b} x y z t u\n{' '.join(w)} {a} {a} q {b} {b}")]
    # and sentences of regular build out of two words
    rows += [(10 + k, " ".join(x)) for k, x in enumerate(texts.regular_words(size))]
    df = spark.createDataFrame(rows, texts.SCHEMA)
    assert hashed(substring_dedup(df)) == brute.substring_dedup(rows)
    assert by_id(near_duplicates(df)) == brute.near_duplicates(rows)
    assert by_id(line_dedup(df)) == brute.line_dedup(rows)
    assert hashed(suffix_dedup.suffix_dedup(df)) == brute.suffix_dedup(rows)
    assert by_id(quality_rules(df)) == {i: brute.quality(t) for i, t in rows}


def test_vectors_at_the_threshold_are_linked(spark):
    near = [19.0, 6.0, 1.0, 1.0, 1.0]
    rows = []
    for k in range(5):
        place = np.roll(np.arange(5), k)
        rows += [(10 * k, [float(x) for x in np.eye(5)[0][place]]), (10 * k + 1, [near[p] for p in place])]
    got = by_id(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == brute.near_vectors(rows) and all(x[0] == 1 for x in got.values())


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 7)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    groups = brute.Groups({x for p in links for x in p})
    for a, b in links:
        groups.join(a, b)
    got = by_id(components(spark.createDataFrame(links, "a long, b long"), Steps(spark)))
    real = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: (groups.find(x),) for x in real}
    assert components(spark.createDataFrame([], "a long, b long"), Steps(spark)).count() == 0
