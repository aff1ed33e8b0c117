"""Quality, encoding, packing and sharding against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import brute
import numpy as np
import public_tokenizers
import pytest
import texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobsignals.llm import bpe, packing, quality, scratch, sharding
from jobsignals.llm.packing import boundaries, pack, packed_tokens
from jobsignals.llm.quality import quality_rules
from jobsignals.llm.sharding import equal_text_links, shard
from jobsignals.llm.token_counts import BAND, context_limits, encoded_lengths, quantiles, truncated_total

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_quality_equals_brute_force(spark):
    rows = texts.passages(2) + [(5000 + i, t) for i, t in texts.lines(1)] + [(9000, "a b #c\n\n a b #c\na b #c"), (9001, "w " * 400)]
    got = {r[0]: tuple(r[1:]) for r in quality_rules(spark.createDataFrame(rows, texts.SCHEMA)).collect()}
    assert got == {i: brute.quality(t) for i, t in rows}


def test_longest_repeats_equal_definition():
    r = np.random.default_rng(1)
    for _ in range(60):
        n = r.integers(0, 30)
        s, row = r.integers(0, 3, n).astype(np.uint64), np.sort(r.integers(0, 3, n))

        def common(i, j):
            k = 0
            while max(i, j) + k < n and row[i + k] == row[j + k] == row[i] == row[j] and s[i + k] == s[j + k]:
                k += 1
            return k

        want = [max((common(i, j) for j in range(n) if i != j), default=0) for i in range(n)]
        assert list(quality.longest_repeats(s, row)) == want


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 7)])
def test_encoding_equals_the_tokenizer_and_decodes_back(spark, seed, parts):
    r = random.Random(seed)
    bits = ["a", "B", " ", "  ", "\n", "'s", "'ll", "é", "日本", "1", "２", "!", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|endo", "😀", "é", "\x00"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(15)))) for i in range(300)] + [(900, None), (901, ""), (902, "the word " * 5000)]
    df = spark.createDataFrame(rows, texts.SCHEMA).repartition(parts)
    encoded = bpe.encode(df, BPE)
    assert sorted(bpe.round_trip(df, BPE).collect()) == sorted(bpe.decode(encoded, BPE).collect())
    got = {x.doc_id: (list(x.ids), x.text) for x in bpe.decode(encoded, BPE).collect()}
    t = Tokenizer.from_file(BPE)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in rows}
    assert got == {i: (ids[i], t.decode(ids[i], skip_special_tokens=False)) for i, _ in rows}


def test_decoding_odd_ids(spark):
    rows = [(1, [50256, -1, 99999], "a"), (2, None, "b"), (3, [], None), (None, [None, 64], "d"), (None, [64] * 25_000, "e"), (4, [159, 246], "f")]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, text string").withColumn("id", F.lit(7)).withColumn("piece", F.lit("p")).withColumn("own", F.col("ids"))
    got = bpe.decode(df, BPE)
    assert got.columns == ["doc_id", "ids", "id", "piece", "own", "text"] and got.filter("id = 7 and piece = 'p' and ids <=> own").count() == len(rows)
    found = [(r.doc_id, r.text) for r in got.collect()]
    one = Tokenizer.from_file(BPE).decode([64], skip_special_tokens=False)
    assert sorted(found, key=str) == sorted([(1, "<|endoftext|>"), (2, ""), (3, ""), (None, one), (None, one * 25_000), (4, Tokenizer.from_file(BPE).decode([159, 246]))], key=str)
    assert bpe.decode(df.limit(0), BPE).collect() == []


def test_batches_of_many_words(spark):
    rows = [(i, " ".join(f"{chr(0x4E00 + (i * 7919 + k) % 20000)}{chr(0x4E00 + k % 211)}" for k in range(3000))) for i in range(60)]
    t = Tokenizer.from_file(BPE)
    got = {r.doc_id: list(r.ids) for r in bpe.encode(spark.createDataFrame(rows, texts.SCHEMA).coalesce(1), BPE).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}


def test_places_name_words_by_their_count_and_written_words_go(spark, tmp_path, monkeypatch):
    """What stands between the steps is small: no order of the words, and no words once they have ids."""
    monkeypatch.setattr(scratch, "fresh_path", lambda _, name: str(tmp_path / name))
    rows = [(k, "".join(f" {chr(97 + n % 26)}{n}" for n in range(k, 40_000, 3)) + " common" * 30_000) for k in range(3)]
    df = bpe._words_and_places(spark.createDataFrame(rows, texts.SCHEMA).coalesce(1), BPE)
    assert list(tmp_path.glob(f"split/what={bpe.TEXTS}/*.parquet")) and not list(tmp_path.glob(f"split/what={bpe.WORDS}"))
    counts = [bpe._unpacked(r.ids) for r in df.filter("kind = 0 and first < 0").collect()]
    assert len(counts) == 1 and counts[0].max() == 90_000


def test_boundaries_are_the_best_ones():
    r = random.Random(1)
    for _ in range(40):
        n, k = r.randrange(1, 8), r.randrange(1, 5)
        lengths = sorted(r.sample(range(1, 40), n))
        counts = [r.randrange(1, 9) for _ in lengths]

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))

        got = boundaries(np.array(lengths), np.array(counts), k)
        best = min(padding([*some, lengths[-1]]) for m in range(min(k, n)) for some in combinations(lengths[:-1], m))
        assert len(got) <= k and padding(got) == best


def test_packing_holds_every_token_once(spark):
    rows = texts.passages(4) + [(None, "a b c"), (7, "a"), (7, "a")]
    lengths = spark.createDataFrame([(i, len(brute.words(t)) if t else None) for i, t in rows], "doc_id long, length long")
    got = pack(lengths, context=50, buckets=4, budget=200).collect()
    want = Counter()
    for i, t in rows:
        n = len(brute.words(t)) + 1
        want += Counter((i, p, p * 50, min(50, n - p * 50)) for p in range(-(-n // 50)))
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in got) == want
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_tokens
        batches[r.bucket_tokens, r.batch].append(r.slot)
    for (size, number), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) == 200 // size or number == max(n for s, n in batches if s == size)
    assert {s for s, _ in batches} == set(boundaries(*map(np.array, zip(*Counter(r.n_tokens for r in got).items())), 4))


def test_pieces_of_tokens_make_the_documents_again(spark):
    df = spark.createDataFrame(texts.passages(5), texts.SCHEMA)
    encoded = bpe.encode(df, BPE)
    packed = pack(encoded_lengths(df, public_tokenizers.path("byte_bpe_50k.tiktoken")), context=40, budget=200)
    found = defaultdict(list)
    for r in packed_tokens(packed, encoded, 50256).orderBy("doc_id", "piece").collect():
        assert r.n_tokens == len(r.tokens) <= r.bucket_tokens
        found[r.doc_id] += r.tokens
    t = Tokenizer.from_file(BPE)
    assert found == {i: [*t.encode(x or "", add_special_tokens=False).ids, 50256] for i, x in texts.passages(5)}


def test_rows_without_id_are_dealt_out_over_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_GROUP", 50)
    lengths = spark.createDataFrame([(None, 5)] * 2000, "doc_id long, length long")
    plan = pack(lengths, context=8, budget=16)
    assert sorted((r.batch, r.slot) for r in plan.collect()) == [(k // 2, k % 2) for k in range(2000)]


def test_shards_are_even_and_links_stay(spark):
    rows = [(i, f"text {i % 400}" if i % 3 else f"own {i}") for i in range(2000)] + [(3000, None), (3001, ""), (None, "x"), (None, "x"), (5, "again")]
    df = spark.createDataFrame(rows, texts.SCHEMA)
    links = equal_text_links(df)
    got = shard(df, links).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    at = {r.doc_id: r.shard for r in got}
    pairs = links.collect()
    assert len(pairs) > 800 and sum(at[a] != at[b] for a, b in pairs) < 0.25 * len(pairs)


@pytest.mark.parametrize("copies", [2, 5])
def test_groups_of_copies_stay_together(spark, copies):
    rows = [(i, f"text {i % (1200 // copies)}" if i < 1200 else f"own {i}") for i in range(2400)]
    df = spark.createDataFrame(rows, texts.SCHEMA)
    links = equal_text_links(df)
    at = {r.doc_id: r.shard for r in shard(df, links).collect()}
    pairs = links.collect()
    cut = sum(at[a] != at[b] for a, b in pairs)
    assert len(pairs) == 1200 - 1200 // copies and cut <= 0.02 * len(pairs), cut


def test_a_hot_text_is_spread_over_shards(spark):
    rows = [(i, "same" if i % 2 else f"own {i}") for i in range(2400)]
    df = spark.createDataFrame(rows, texts.SCHEMA)
    sizes = Counter(r.shard for r in shard(df, equal_text_links(df)).collect())
    assert set(sizes.values()) == {100}


def test_sharding_runs_no_python(spark):
    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(50)], texts.SCHEMA).withColumn("x", F.lit(1))
    plan = shard(df, equal_text_links(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and sharding.SHARDS == 24


def test_token_counts_equal_brute_force(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = texts.passages(6) + [(9000, None), (9001, "<|endoftext|> x"), (9002, "long word " * 3 * BAND)]
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    lengths = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows]
    limits = context_limits(encoded_lengths(spark.createDataFrame(rows, texts.SCHEMA), ranks)).cache()
    got = {r.length: r for r in limits.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.docs_at_most == sum(x <= n for x in lengths) and r.tokens_at_most == sum(x for x in lengths if x <= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    for n in (0, 1, 17, 1000, 10**6):
        assert truncated_total(limits, n).first()[0] == sum(min(x, n) for x in lengths)
    for q, n in quantiles(limits, [0.1, 0.5, 1.0]).collect():
        assert n == min(x for x in lengths if sum(y <= x for y in lengths) >= q * len(lengths))
    empty = context_limits(encoded_lengths(spark.createDataFrame([], texts.SCHEMA), ranks))
    assert empty.count() == 0 and truncated_total(empty, 5).first()[0] == 0
