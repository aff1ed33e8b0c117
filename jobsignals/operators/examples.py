"""Training examples from prompt and response pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import IGNORED_LABEL
from ..functions.text import tokens
from .ranking import hashed_rank

PAD_ID = 0
END_ID = 1
# 60 bits: different words of one corpus hardly ever share an id.
HASH_DIGITS = 15


def token_ids(c: Column | str, limit: int | None = None) -> Column:
    """A number for each of the first ``limit`` words, or of all: the first 60 bits of its MD5,
    after the two reserved ids.

    Stands in for a tokenizer, so that every executor gives a word the same id without a
    vocabulary. Callers with a tokenizer pass id arrays to :func:`masked_examples` instead.
    """
    words = tokens(c) if limit is None else F.slice(tokens(c), 1, limit)
    return F.transform(
        words, lambda w: F.conv(F.substring(F.md5(w), 1, HASH_DIGITS), 16, 10).cast("bigint") + 2
    )


def dialogue_pairs(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Each user turn with the assistant turn right after it.

    An equi-join on (conversation, turn), so a long conversation is spread over its turns.
    """
    asked = turns.filter(F.col(role) == "user").select(key, turn, F.col(text).alias("prompt"))
    answered = turns.filter(F.col(role) == "assistant").select(
        key, (F.col(turn) - 1).alias(turn), F.col(text).alias("response")
    )
    return asked.join(answered, [key, turn]).withColumn(
        "pair_id", F.concat_ws("-", F.col(key).cast("string"), F.col(turn).cast("string"))
    )


def masked_examples(
    pairs: DataFrame,
    max_prompt: int | None = None,
    max_response: int | None = None,
    batch_size: int = 8,
    seed: int = 0,
    key: str = "pair_id",
    prompt_ids: str = "prompt_ids",
    response_ids: str = "response_ids",
) -> DataFrame:
    """Token ids, labels and attention mask of each pair, padded to its batch.

    Prompt and response are cut to their token limits, if there are any, and an end token is added. Labels repeat
    the response and hide the prompt and the padding behind -100. Batches are consecutive runs
    of ``batch_size`` pairs in a seeded random order, so a batch is the largest group here.
    """
    prompt = F.col(prompt_ids) if max_prompt is None else F.slice(prompt_ids, 1, max_prompt)
    answer = F.col(response_ids) if max_response is None else F.slice(response_ids, 1, max_response)
    response = F.concat(answer, F.array(F.lit(END_ID).cast("bigint")))
    cut = pairs.select(key, prompt.alias("_p"), response.alias("_r"))
    ranked = hashed_rank(cut, key, seed, name="position")
    batched = ranked.withColumn("batch", F.floor(F.col("position") / batch_size).cast("bigint"))
    length = F.size("_p") + F.size("_r")
    width = F.max(length).over(Window.partitionBy("batch"))
    sized = batched.withColumns({"_length": length, "_pad": width - length})

    def run(value: int, times: Column) -> Column:
        return F.array_repeat(F.lit(value).cast("bigint"), times)

    return sized.select(
        key,
        "batch",
        "position",
        F.concat("_p", "_r", run(PAD_ID, F.col("_pad"))).alias("input_ids"),
        F.concat(run(IGNORED_LABEL, F.size("_p")), F.col("_r"), run(IGNORED_LABEL, F.col("_pad"))).alias("labels"),
        F.concat(run(1, F.col("_length")), run(0, F.col("_pad"))).alias("attention_mask"),
    )
