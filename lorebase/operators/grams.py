"""Literal substring search that scans only blocks of rows in which the needle may be.

A block, a range of ids of a stored table, is indexed by the pieces of one, two and three letters that its texts hold.
A text with the needle holds all the needle's pieces, so only blocks that have them all are read; rows are then
decided by the search itself. Pieces are only ever added: what a change has removed from a block costs a scan, and
no row is missed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.ranges import RangeTable
from .questions import matches_search

#: Letters of the longest pieces.
LONGEST = 3


def pieces(text: Column) -> Column:
    """The distinct pieces of 1 to LONGEST letters of a text in lower case; none for a null or empty one."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    # at each place, what lies ahead
    each = [F.regexp_extract_all(lower, F.lit(f"(?s)(?=(.{{{k}}}))"), 1) for k in range(1, LONGEST + 1)]
    return F.array_distinct(F.concat(*each))


@dataclass
class GramIndex:
    """The pieces of a stored table's questions and answers: (piece, block), in a table bucketed by piece."""

    table: RangeTable
    folder: str
    buckets: int

    @classmethod
    def create(cls, table: RangeTable, folder: str, buckets: int | None = None) -> GramIndex:
        out = cls(table, folder, buckets or int(table.spark.conf.get("spark.sql.shuffle.partitions")))
        table.spark.sql(f"CREATE TABLE IF NOT EXISTS {out._name} (piece STRING, block BIGINT) USING parquet CLUSTERED BY (piece) SORTED BY (piece) INTO {out.buckets} BUCKETS LOCATION '{folder}'")
        out.add(table.read())
        return out

    @property
    def _name(self) -> str:
        return f"lorebase_{hashlib.md5(self.folder.encode()).hexdigest()}_grams"

    def add(self, rows: DataFrame) -> None:
        """Index rows (id, question, answer) that are or will be put in the table."""
        held = F.array_union(pieces(F.col("question")), pieces(F.col("answer")))
        found = rows.select(self.table.range_of(F.col("id")).alias("block"), F.explode(held).alias("piece")).distinct()
        found.select("piece", "block").repartition(self.buckets, "piece").write.insertInto(self._name)
        self.table.spark.catalog.refreshTable(self._name)

    def blocks(self, needle: str) -> list[int] | None:
        """Numbers of the blocks that hold every piece of the needle; None, for all, if it is empty."""
        spark = self.table.spark
        own = spark.range(1).select(pieces(F.lit(needle)).alias("own")).first().own
        longest = max(map(len, own), default=0)
        wanted = [p for p in own if len(p) == longest]  # shorter pieces are in these
        if not wanted:
            return None
        found = spark.table(self._name).filter(F.col("piece").isin(wanted)).groupBy("block").agg(F.count_distinct("piece").alias("n"))
        return sorted(r.block for r in found.filter(F.col("n") == len(wanted)).collect())  # a number for each block at most

    def search(self, needle: str) -> DataFrame:
        """Rows whose question or answer holds the needle, as `questions.search` finds them."""
        blocks, rows = self.blocks(needle), self.table.in_ranges
        return self.table.read() if blocks is None else rows(blocks).filter(matches_search(needle))
