import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jobsignals.functions.ids import label_of, pad_id, parse_id_ranges
from jobsignals.functions.numbers import duration_seconds, ratio, to_mib, to_number, to_watts
from jobsignals.functions.text import (
    addresses,
    bigrams,
    kv_text,
    normalize_text,
    parse_answer,
    prompt_text,
    tokens,
)


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers_that_are_none(spark):
    assert apply(spark, to_number, ["12", "12.0", "1e3", "NaN", "<error: X>", "", None]) == [
        12.0, 12.0, 1000.0, None, None, None, None,
    ]


def test_units_round_half_even(spark):
    assert apply(spark, to_watts, [123456, 500], "int") == [123.456, 0.5]
    assert apply(spark, to_mib, [1048576, 507_000_000], "long") == [1.0, 483.513]


def test_duration_and_ratio(spark):
    row = spark.sql(
        "select timestamp'2026-01-01 00:00:00.0005' a, timestamp'2026-01-01 00:00:15.1239' b, 0 z"
    ).select(
        duration_seconds("a", "b"), ratio(F.lit(1), F.col("z")), ratio(F.lit(1), F.col("z"), None)
    ).first()
    assert tuple(row) == (15.123, 0.0, None)


def test_ids_keep_their_zeros_and_long_ones_their_digits(spark):
    assert apply(spark, pad_id, [7, 61, 999, 1000, 12345], "int") == ["007", "061", "999", "1000", "12345"]


@pytest.mark.parametrize(
    "spec, ranges",
    [
        (None, None), ("", None), (",", []), ("090-060", []), ("5", [(5, 5)]),
        ("060-090,100, 080-099", [(60, 100)]), ("3-4,1", [(1, 1), (3, 4)]),
    ],
)
def test_id_ranges(spec, ranges):
    assert parse_id_ranges(spec) == ranges


def test_malformed_range_is_an_error():
    with pytest.raises(ValueError):
        parse_id_ranges("5-x")


def test_label_follows_family_and_unknown_family_stops(spark):
    assert apply(spark, label_of, ["ordinary_training", "adversarial_x"]) == ["ordinary", "adversarial"]
    for bad in ("benign_x", None):
        with pytest.raises(PySparkException):
            apply(spark, label_of, [bad])


CLEANED = [
    ("at 2031-02-03T04:05:06.789+00:00 and 2031-02-03T04:05:06Z", "at <TIME> and <TIME>"),
    ("1234567890.123456 or 12345678901.23", "<TIME> or 12345678901.23"),
    ("GPU-01234567-89ab-cdef-0123-456789abcdef 01234567-89AB-cdef-0123-456789abcdef", "<UUID> <UUID>"),
    ("/tmp/run_007/work/ /one a/b/c", "<PATH> /one a<PATH>"),
    ("/été/çà/x", "<PATH>"),
    ("--seed=12 --seed 7 --episode-id 061 run_001 cc_12 xrun_001 épisode_123", "--seed=<SEED> --seed <SEED> --episode-id <ID> <ID> cc_12 xrun_001 épisode_123"),
    (None, None),
]


def test_text_clean_up_in_rule_order(spark):
    assert apply(spark, normalize_text, [a for a, _ in CLEANED]) == [b for _, b in CLEANED]


def test_key_value_text_prints_none(spark):
    df = spark.sql("select '10000000.0' a, cast(null as string) b, 3 c")
    assert df.select(kv_text(["a", "b", "c"])).first()[0] == "a=10000000.0 b=None c=3"


def test_words_and_pairs(spark):
    assert apply(spark, tokens, ["A bc Été_9 x2! gpu=0.5", "", "a"]) == [["bc", "été_9", "x2", "gpu"], [], []]
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(bigrams(F.col("w"))).collect()] == [["a b", "b c"], [], []]


def test_address_lists(spark):
    assert apply(spark, addresses, ["a:1;b:2", "a:1;;", "", None]) == [["a:1", "b:2"], ["a:1"], [], []]


def test_prompt_caps_only_the_text(spark):
    assert apply(spark, lambda c: prompt_text(c, "<{text}>", 3), ["abcdef", None]) == ["<abc>", "<>"]


def test_answers(spark):
    assert apply(spark, parse_answer, [" Ordinary.", "ordinary? ADVERSARIAL", "Dunno \n", None]) == [
        "ordinary", "adversarial", "<unparsed: 'dunno'>", "<unparsed: ''>",
    ]
