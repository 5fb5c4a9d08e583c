"""Training samples: label ids, prompts, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def padded_labels(ids: Column, length: int, pad: int = 0) -> Column:
    """Ids cut or padded to ``length``; padding is ignored in the loss."""
    cut = F.slice(ids, 1, length)
    full = F.concat(cut, F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(0), F.lit(length) - F.size(cut))))
    return F.transform(full, lambda x: F.when(x == pad, F.lit(IGNORED)).otherwise(x))


def shifted_right(labels: Column, start: int, pad: int = 0) -> Column:
    """Decoder inputs: the start id, then the labels without the last, ignored ones as padding."""
    shifted = F.concat(F.array(F.lit(start).cast("int")), F.slice(labels, F.lit(1), F.size(labels) - 1))
    return F.transform(shifted, lambda x: F.when(x == IGNORED, F.lit(pad).cast("int")).otherwise(x))


def masked_prompt(ids: Column, prompt_length: Column, ignored_ids: list[int]) -> Column:
    """Ids with the prompt's, padding and image ids ignored."""
    return F.transform(ids, lambda x, i: F.when((i < prompt_length) | x.isin(ignored_ids), F.lit(IGNORED)).otherwise(x))


def batch_padded(df: DataFrame, batch: str, ids: str, pad: int = IGNORED) -> DataFrame:
    """Every row's ids padded to the longest of its batch."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("longest"))
    return df.join(longest, batch).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), F.col("longest") - F.size(ids)))).drop("longest")


def chat(prompt: str, answer: Column) -> Column:
    """A user's prompt with an image and the assistant's answer, as JSON."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    user = F.struct(F.lit("user").alias("role"), F.array(part("image", F.lit(None).cast("string")), part("text", F.lit(prompt))).alias("content"))
    assistant = F.struct(F.lit("assistant").alias("role"), F.array(part("text", answer)).alias("content"))
    return F.to_json(F.array(user, assistant))


def conversation(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its messages in order, as JSON."""
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return listed.select("conv_id", F.size("m").alias("n_messages"), F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"))
