"""Words, word pairs and their TF-IDF weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, tokens


def with_grams(df: DataFrame, text: str = "text", name: str = "grams") -> DataFrame:
    """Add all words followed by all pairs of neighbouring words, as an array."""
    return (
        df.withColumn("_words", tokens(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(name, F.concat("_words", bigrams(F.col("_words"))))
        .drop("_words")
    )


def ngrams(df: DataFrame, key: str = "episode_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """How often each word and word pair occurs in each document; rows of one key are one document.

    The texts are dealt out by key, so that their terms, many times as many bytes, are counted where they
    are made, without a shuffle of their own. A task counts one document after the other, so that it
    holds the terms of one document, not those of all its rows.
    """
    return counted_in_rows(with_all_grams(by_key(df, key, text, keep), key, *keep), "grams", key, *keep)


def by_key(df: DataFrame, key: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per key with the texts of its rows as the array ``_texts``, which a task holds as it holds one text."""
    return df.groupBy(key, *keep).agg(F.collect_list(text).alias("_texts"))


def with_all_grams(df: DataFrame, *keep: str) -> DataFrame:
    """The terms of all ``_texts`` of a row as the array ``grams``; no pair spans two texts."""
    words = df.select(*keep, F.transform("_texts", tokens).alias("_words"))
    return words.select(*keep, F.flatten(F.transform("_words", lambda w: F.concat(w, bigrams(w)))).alias("grams"))


def counted_in_rows(df: DataFrame, grams: str, *keep: str) -> DataFrame:
    """How often each element of the array ``grams`` occurs in each row: runs of the sorted array."""
    ordered = df.select(*keep, F.sort_array(grams).alias("_grams"))
    last = F.greatest(F.size("_grams") - 1, F.lit(0))
    starts = F.filter(
        F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("_grams", i) != F.get("_grams", i - 1))
    )
    runs = ordered.withColumn("_starts", starts).withColumn(
        "_runs", F.arrays_zip(F.col("_starts").alias("at"), F.slice("_starts", 2, F.size("_starts")).alias("to"))
    )
    rows = runs.select(*keep, "_grams", F.explode_outer("_runs").alias("_run"))
    tf = F.coalesce("_run.to", F.size("_grams")) - F.col("_run.at")
    return rows.select(*keep, F.get("_grams", F.col("_run.at")).alias("term"), tf.cast("long").alias("tf")).filter("term is not null")


def counted(df: DataFrame, grams: str, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """How often each element of the array ``grams`` occurs in the rows of each key."""
    return exploded(df, grams, "term", key, *keep).groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def exploded(df: DataFrame, array: str, name: str, *keep: str) -> DataFrame:
    """One row per element of a computed array.

    A plain explode makes the optimizer test the array for emptiness further down, which
    computes it a second time; the outer form followed by a null filter does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def inverse_frequency(n_documents: Column, n_with_term: Column) -> Column:
    """Smoothed inverse document frequency, as if one more document held every term."""
    return F.log((n_documents + 1.0) / (n_with_term + 1.0)) + 1.0


def _normalised(weighted: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Divide by the length of the document's vector."""
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, *names, "term", "tf", (F.col("_w") / length).alias("weight"))


def tfidf(
    df: DataFrame, key: str = "episode_id", text: str = "text", fold: str | None = None, folds: int = 5
) -> DataFrame:
    """TF-IDF weight of every term of every document, each document scaled to length 1.

    With ``fold`` (0 .. ``folds`` - 1) a document is weighted as the model of its own fold sees
    it: document frequencies come from the other folds only, and terms that occur nowhere else
    are unknown and leave before scaling. All folds are served by one count, since what is
    outside a fold is the total minus what is inside.

    Frequencies are partial sums that are joined back by term; Spark can split that join where a
    term is in most documents. Rows of terms move twice, for this join and by document for the
    length, and the texts once. The number of documents is a scalar subquery.
    """
    counts = ngrams(df, key, text, [] if fold is None else [fold])
    inside = [] if fold is None else [F.count_if(F.col(fold) == i) for i in range(folds)]
    measures = F.array(F.count(F.lit(1)), *inside)
    frequency = counts.groupBy("term").agg(measures.alias("_df"))
    sizes = df.agg(measures.alias("_n")).scalar()
    rows = counts.join(frequency, "term").withColumn("_n", sizes)
    if fold is None:
        known, n = F.col("_df")[0], F.col("_n")[0]
    else:
        known, n = (F.col(c)[0] - F.element_at(c, (F.col(fold) + 2).cast("int")) for c in ("_df", "_n"))
        rows = rows.filter(known > 0)
    weight = F.col("tf") * inverse_frequency(n.cast("double"), known)
    return _normalised(rows.withColumn("_w", weight), key, [] if fold is None else [fold])
