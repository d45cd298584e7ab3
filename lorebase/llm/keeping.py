"""Dropping documents by what was decided about their rows, without shuffling texts more than it takes.

A row is known by its doc_id and the MD5 of its text; only these go through the decisions. Rows that agree in both
are repeats of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import selection
from .common import discard, settle

#: The most bytes in memory of the bits that are broadcast, as for selections.
MARKS = 64 << 20


def row_key(of: str = "") -> Column:
    """The key of a row, ordered by doc_id, a null one last; null text differs from empty text. `of` names the struct that holds the row."""
    doc_id, text = F.col(f"{of}doc_id"), F.col(f"{of}text")
    return F.struct(doc_id.isNull().alias("last"), doc_id.alias("doc_id"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("md5"))


def marks(keys: DataFrame, most_bytes: int) -> DataFrame | None:
    """The doc_ids of the keys as bits, by 64 ids, to be broadcast; none where they take more than `most_bytes` in memory."""
    held = settle(selection.of(keys.select(F.col("key.doc_id").alias("id"))), "marks")
    if held.count() * selection.ROW_BYTES <= most_bytes:
        return F.broadcast(held.select(F.col("word").alias("marked_word"), F.col("bits").alias("marked_bits")))
    discard(held)
    return None


def here(doc_id: Column) -> Column:
    """Whether a doc_id's bit is set in the marks that are joined."""
    return (selection.word(doc_id) == F.col("marked_word")) & (F.getbit("marked_bits", selection.place(doc_id)) == 1)


def marked(docs: DataFrame, keys: DataFrame, most_bytes: int = MARKS) -> DataFrame:
    """(doc_id, text) of docs: all rows whose doc_id one of the keys has, found where they lie, and those of a null doc_id.

    What is left may be joined by the whole key. Where the marks are too large to broadcast, these are all rows.
    """
    rows, bits = docs.select("doc_id", "text"), marks(keys, most_bytes)
    return rows if bits is None else rows.join(bits, here(F.col("doc_id")), "left_semi").unionByName(rows.filter("doc_id IS NULL"))


def keep(docs: DataFrame, losers: DataFrame, repeated: DataFrame, most_bytes: int = MARKS) -> DataFrame:
    """docs, with all their columns, without the rows of `losers`; of the rows of each key of `repeated` one stays.

    Both are tables of a column `key`, and are settled here. Of repeats, which differ in other columns at most, the
    one whose columns come first as JSON stays. Rows whose doc_id neither table has stay where they lie, told by
    broadcast bits; only the others, most of which go, are shuffled. Where the bits would take more than
    `most_bytes`, all rows are shuffled, once.
    """
    columns = docs.columns
    losers, repeated = settle(losers.select("key").distinct(), "losers"), settle(repeated.select("key").distinct(), "repeated")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"))
    bits, doc_id = marks(losers.unionByName(repeated), most_bytes), F.col("doc.doc_id")
    judged = rows if bits is None else rows.join(bits, here(doc_id), "left_semi").unionByName(rows.filter(doc_id.isNull()))
    kept = judged.select("doc", row_key("doc.").alias("key")).join(losers, "key", "left_anti")
    if not repeated.isEmpty():
        one = kept.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
        kept = kept.join(repeated, "key", "left_anti").select("doc").unionByName(one.select("doc"))
    kept = kept.select("doc")
    if bits is not None:
        kept = kept.unionByName(rows.filter(doc_id.isNotNull()).join(bits, here(doc_id), "left_anti"))
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in columns))
