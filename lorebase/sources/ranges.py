"""A table kept by ranges of ids, so that a change rewrites only the ranges it touches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

RANGE = "id_range"


@dataclass
class RangeTable:
    """Rows with an `id` in a folder, a directory for each `width` ids.

    A change reads the ranges that hold its ids, found by partition pruning, and overwrites just those directories.
    Files are written beside the table first and put in place when all tasks have ended, so a failed write leaves the
    table as it was, and repeating one gives the same table. Directories are replaced one by one: a driver that dies
    amid that has changed some ranges and not others, and leaves the last one's new files in the folder's staging
    directory. There is one writer at a time.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    width: int

    @classmethod
    def create(cls, rows: DataFrame, folder: str, width: int = 100_000) -> RangeTable:
        """A table of rows, whose ids are distinct and not null."""
        out = cls(rows.sparkSession, folder, rows.schema, width)
        out._write(rows.withColumn(RANGE, out.range_of(F.col("id"))), "errorifexists")
        return out

    def range_of(self, id_: Column) -> Column:
        return F.floor(id_ / self.width).cast("bigint")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add(RANGE, "long")).parquet(self.folder)

    def read(self) -> DataFrame:
        return self._rows().drop(RANGE)

    def in_ranges(self, numbers: list[int]) -> DataFrame:
        """The rows of some ranges; others are not read."""
        return self._rows().filter(F.col(RANGE).isin(numbers)).drop(RANGE)

    def lookup(self, id_: int) -> DataFrame:
        """The row of an id; other ranges are not read."""
        return self._rows().filter((F.col(RANGE) == id_ // self.width) & (F.col("id") == id_)).drop(RANGE)

    def pages(self, matching: Column | None = None) -> Pages:
        """The list of the rows that match, in the order of id, for reading its pages."""
        matching = F.lit(True) if matching is None else matching
        counts = self._rows().filter(matching).groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect()
        return Pages(self, matching, sorted((r[RANGE], r.n) for r in counts))

    def _write(self, rows: DataFrame, mode: str) -> None:
        writer = rows.repartition(RANGE).sortWithinPartitions(RANGE, "id").write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(RANGE).parquet(self.folder)

    def _beside(self, ids: DataFrame) -> DataFrame:
        """The other rows of the ranges that hold the ids."""
        touched = [r[0] for r in ids.select(RANGE).distinct().collect()]  # a number for each range of the table at most
        return self._rows().filter(F.col(RANGE).isin(touched)).join(ids, [RANGE, "id"], "left_anti")

    def apply(self, changed: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Put in rows in place of those of the same ids, and take out the ids of `gone`, in one write.

        Ids of `changed` are distinct; an id in both is put in. Ids of `gone` that are not there change nothing.
        """
        named = lambda rows: rows.withColumn(RANGE, self.range_of(F.col("id")))
        keys = [named(x.select("id")) for x in (changed, gone) if x is not None]
        ids = reduce(DataFrame.unionByName, keys).distinct()
        rows = self._beside(ids)
        if changed is not None:
            rows = rows.unionByName(named(changed.select(self.schema.names)))
        emptied = [r[0] for r in ids.select(RANGE).distinct().join(rows.select(RANGE).distinct(), RANGE, "left_anti").collect()]
        self._write(rows, "overwrite")
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for number in emptied:  # a range without rows is not among what was written
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{RANGE}={number}")
            path.getFileSystem(conf).delete(path, True)


@dataclass
class Pages:
    """How many rows of each range match, a number for each range of the table, counted once for all pages.

    A page, however deep, reads the ranges that it lies in and no other, and gathers its own rows only behind the
    places of those ranges. Counts hold for the table as it was when they were made.
    """

    table: RangeTable
    matching: Column
    counts: list[tuple[int, int]]

    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of a 0-based page with their place `stt`, from 1, in the whole list; empty past the end."""
        first, before, picked, begin = number * size, 0, [], 0
        for range_, n in self.counts:
            if before < first + size and before + n > first:
                begin = begin if picked else before
                picked.append(range_)
            before += n
        rows = self.table.in_ranges(picked).filter(self.matching).orderBy("id").offset(first - begin if picked else 0).limit(size)
        # the window is over the rows of one page only
        return rows.withColumn("stt", (F.row_number().over(Window.orderBy("id")) + first).cast("bigint"))
