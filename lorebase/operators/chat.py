"""Conversations: the history that goes with a question, and appending turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clean_text

# What the assistant's turn says while an answer is awaited, and where none came.
PENDING, NO_ANSWER = "Đang xử lý...", "Không có phản hồi từ hệ thống."


def history_payload(messages: DataFrame) -> DataFrame:
    """For each question that is not empty after cleaning: the cleaned text and the turns strictly before it.

    Each payload holds its whole history, so a conversation of n turns gives n * n / 2 turns, by one task.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("messages", F.collect_list(F.struct("role", "text")).over(before)).filter(F.col("role") == "user")
    asked = rows.select("conv_id", "turn", clean_text(F.col("text")).alias("question"), "messages")
    return asked.filter(F.col("question") != "")


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def append(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """Each conversation that something is sent in, with all its turns as an array: those of before, then for each
    sent row (conv_id, turn, sent, reply), by turn, the user's text and the reply, or a placeholder while it is null.

    Rows are known by (conv_id, turn), so questions under way at the same time can't overwrite each other; of several
    rows of a turn the one with a reply counts. Texts that are empty after cleaning aren't sent, and conversations
    where nothing else is have no row. A conversation is one row, gathered by one task.
    """
    turns = sent.select("conv_id", "turn", clean_text(F.col("sent")).alias("sent"), "reply").filter("sent <> ''")
    once = turns.groupBy("conv_id", "turn").agg(F.max(F.struct(F.col("reply").isNotNull(), "sent", "reply")).alias("s"))
    both = once.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s"))).alias("xs"))
    new = both.select("conv_id", F.flatten(F.transform("xs", lambda x: F.array(_turn("user", x["s"]["sent"]), _turn("assistant", F.coalesce(x["s"]["reply"], F.lit(PENDING)))))).alias("new"))
    own = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    before = F.transform(F.coalesce("turns", F.array().cast("array<struct<turn:bigint,role:string,text:string>>")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return new.join(own, "conv_id", "left").select("conv_id", F.concat(before, "new").alias("messages"))


def answer(sent: DataFrame, replies: DataFrame) -> DataFrame:
    """Sent rows (conv_id, turn, sent) with the reply of their turn, of replies (conv_id, turn, at, reply).

    Replies may come in any order; the last of a turn, by `at`, counts. An empty or null one becomes a fixed sentence;
    turns without one stay pending, with a null reply. Replies to turns that were not sent are left out.
    """
    text = F.when(F.coalesce("reply", F.lit("")) == "", F.lit(NO_ANSWER)).otherwise(F.col("reply"))
    last = replies.select("conv_id", "turn", "at", text.alias("reply")).groupBy("conv_id", "turn").agg(F.max_by("reply", F.struct("at", "reply")).alias("reply"))
    return sent.select("conv_id", "turn", "sent").join(last, ["conv_id", "turn"], "left")


def drop_last(messages: Column) -> Column:
    """An array of turns without its last one."""
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


def as_text(messages: str = "messages") -> F.Column:
    """An array of turns as lines of 'role: text'."""
    return F.array_join(F.transform(messages, lambda t: F.concat_ws(": ", t["role"], t["text"])), "\n")
