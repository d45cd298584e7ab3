"""Exact duplicates with a split for heavy hitters. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, discard, settle
from .keeping import keep, row_key

#: Digests with more than this share of the rows are candidates for map-side removal. The Misra-Gries sketch
#: holds at most its inverse, so the broadcast table has at most 1 / SUPPORT rows.
SUPPORT = 1e-3


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with every run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


def heavy_hitters(digests: DataFrame, key: str = "text_sha256", support: float = SUPPORT) -> DataFrame:
    """(key, first, n) of digests that hold over `support` of the rows; at most 1 / support rows.

    freqItems is the algorithm of Misra and Gries (as of Karp, Shenker and Papadimitriou): it gives every such
    digest, and maybe others. Those are counted exactly and only verified ones stay.
    """
    sketch = digests.stat.freqItems([key], support).select(F.explode(f"{key}_freqItems").alias(key))
    counted = digests.join(F.broadcast(sketch), key).groupBy(key).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") > digests.count() * support).select(key, "first", "n")


def duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays; a null doc_id comes last, and of repeated doc_ids one
    row stays. Null text counts as empty. An empty table gives an empty one; other columns are ignored.

    Digests are written once. Frequent ones are settled by a broadcast of their verified winners, without a
    shuffle; the others are grouped and joined by ordinary shuffles in which no key holds over `support` of the rows.
    """
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.monotonically_increasing_id().alias("n"))
    rows = settle(docs.select(row.alias("row"), digest(F.col("text")).alias("text_sha256")), "digests")
    heavy = F.broadcast(settle(heavy_hitters(rows, support=support), "heavy"))  # at most 1 / support rows
    light = rows.join(heavy, "text_sha256", "left_anti")
    least = light.groupBy("text_sha256").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    both = rows.join(heavy, "text_sha256").unionByName(light.join(least, "text_sha256"))
    return both.select(F.col("row.doc_id").alias("doc_id"), F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row.n") == F.col("first.n")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The documents, with all their columns, of which one of each group of equal texts stays.

    Texts are equal as in `duplicates`. The row of smallest doc_id stays, a null one last; of several rows of that
    doc_id the one whose raw text's MD5 comes first, and of repeated rows one. Null text counts as empty. An empty
    table gives an empty one. Only digests are grouped: frequent ones are settled by a broadcast of their verified
    winners, the others by ordinary shuffles. Then the rows that go are taken out of the documents.
    """
    rows = settle(docs.select(row_key().alias("row"), digest(F.col("text")).alias("text_sha256")), "digests")
    heavy = settle(heavy_hitters(rows, support=support), "heavy")
    one = F.broadcast(heavy.select("text_sha256", "first"))  # at most 1 / support rows
    light = rows.join(one, "text_sha256", "left_anti")
    least = light.groupBy("text_sha256").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    both = rows.join(one, "text_sha256").select("row", "first").unionByName(light.join(least, "text_sha256").select("row", "first"))
    decided = settle(both.groupBy(F.col("row").alias("key"), "first").agg(F.count(F.lit(1)).alias("n")), "decided")
    out = keep(docs, decided.filter("key <> first"), decided.filter("key = first AND n > 1"))
    for used in (rows, heavy, decided):
        discard(used)
    return out
