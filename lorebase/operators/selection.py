"""Selections of ids as bits: a table (word, bits) with a row for each 64 ids in a row that hold a selected one.

Ids are whole numbers, negative ones too; null ids are never selected. A selection is one bit for each id where ids
lie close together, so it may be broadcast where a list of the ids may not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import scratch

# What a row of a broadcast selection takes in memory, about, with its place in the hash table.
ROW_BYTES = 40


def word(id_: Column) -> Column:
    return F.shiftright(id_.cast("bigint"), 6)


def place(id_: Column) -> Column:
    return id_.cast("bigint").bitwiseAND(F.lit(63)).cast("int")


def of(ids: DataFrame) -> DataFrame:
    """The selection of the ids; ids that come more than once are selected once."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place(F.col("id")))
    return ids.filter("id IS NOT NULL").groupBy(word(F.col("id")).alias("word")).agg(F.bit_or(bit).alias("bits"))


def toggled(*selections: DataFrame) -> DataFrame:
    """Ids that are in an odd number of the selections: one aggregation, whatever their number."""
    rows = reduce(DataFrame.unionByName, (s.select("word", "bits") for s in selections))
    return rows.groupBy("word").agg(F.bit_xor("bits").alias("bits")).filter("bits <> 0")


def united(*selections: DataFrame) -> DataFrame:
    """Ids that are in any of the selections."""
    rows = reduce(DataFrame.unionByName, (s.select("word", "bits") for s in selections))
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def ids(selection: DataFrame) -> DataFrame:
    """The selected ids, one row each."""
    bit = selection.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return bit.filter(F.getbit("bits", F.col("bit")) == 1).select((F.col("word") * 64 + F.col("bit")).alias("id"))


def size(selection: DataFrame) -> DataFrame:
    """How many ids are selected, in one row."""
    return selection.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint").alias("n_selected"))


def _join(rows: DataFrame, selection: DataFrame, how: str, most_bytes: int) -> DataFrame:
    kept = scratch(selection.select(F.col("word").alias("word"), F.col("bits").alias("bits")), "selection")
    kept = kept.hint("broadcast" if kept.count() * ROW_BYTES <= most_bytes else "merge")
    here = (word(rows["id"]) == kept["word"]) & (F.getbit(kept["bits"], place(rows["id"])) == 1)
    return rows.join(kept, here, how)


def chosen(rows: DataFrame, selection: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The rows whose id is selected. A selection that takes at most `most_bytes`, by its counted words, is broadcast,
    and rows stay where they are; a larger one is joined by a sorted exchange."""
    return _join(rows, selection, "left_semi", most_bytes)


def others(rows: DataFrame, selection: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The rows whose id is not selected, those of a null id included; joined as in `chosen`."""
    return _join(rows, selection, "left_anti", most_bytes)


def state(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Whether all, some or none of the listed rows are selected, by the two counts alone."""
    n = rows.agg(F.count(F.lit(1)).alias("n_filtered")).crossJoin(F.broadcast(size(selection)))  # one row each
    listed, marked = F.col("n_filtered"), F.col("n_selected")
    return n.select("*", ((listed > 0) & (marked == listed)).alias("all_selected"), ((marked > 0) & (marked < listed)).alias("some_selected"))
