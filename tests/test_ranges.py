"""The table by ranges of ids: what a change rewrites, and what a failed one leaves."""

import os

import pytest
from lorebase.sources.ranges import RangeTable
from pyspark.sql import functions as F


def files(folder):
    return {(d.rpartition("/")[2], f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def rows(table):
    return sorted((r.id, r.text) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    return RangeTable.create(spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("text")), str(tmp_path / "t"), width=10)


def test_only_touched_ranges_are_written(spark, table):
    before = files(table.folder)
    changed = spark.createDataFrame([(12, "twelve"), (17, None), (205, "new"), (-3, "below")], "id bigint, text string")
    table.apply(changed, spark.createDataFrame([(33,), (34,), (999,)], "id bigint"))
    want = {i: f"text {i}" for i in range(100) if i not in (33, 34)} | {12: "twelve", 17: None, 205: "new", -3: "below"}
    assert rows(table) == sorted(want.items())
    after = files(table.folder)
    assert {d for d, _ in before - after} == {"id_range=1", "id_range=3"}
    assert {d for d, _ in after - before} == {"id_range=1", "id_range=3", "id_range=20", "id_range=-1"}
    table.apply(changed)
    assert rows(table) == sorted(want.items())


def test_scans_only_touched_ranges(spark, table):
    plan = table.lookup(41)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id_range" in plan and table.lookup(41).collect()[0].text == "text 41"
    plan = table._beside(spark.createDataFrame([(41, 4)], "id bigint, id_range bigint"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id_range" in plan and "(id_range#" in plan and "= 4)" in plan


def test_emptied_range_goes(spark, table):
    table.apply(gone=spark.range(40, 50))
    assert [i for i, _ in rows(table)] == [*range(40), *range(50, 100)]
    assert "id_range=4" not in os.listdir(table.folder)


def test_failed_write_changes_nothing(spark, table):
    before, want = files(table.folder), rows(table)
    bad = spark.range(20, 60).select("id", F.when(F.col("id") < 59, F.lit("x")).otherwise(F.raise_error(F.lit("broken"))).alias("text"))
    with pytest.raises(Exception, match="broken"):
        table.apply(bad)
    assert files(table.folder) == before and rows(table) == want
    table.apply(bad.filter("id < 59"))
    assert rows(table) == sorted({i: f"text {i}" if not 20 <= i < 59 else "x" for i in range(100)}.items())


@pytest.mark.parametrize("size", [1, 7, 25, 1000])
def test_pages(table, size):
    pages = table.pages(F.col("id") % 3 != 1)
    want = [(i, k + 1) for k, i in enumerate(i for i in range(100) if i % 3 != 1)]
    assert pages.total() == len(want)
    for number in {0, 1, len(want) // size // 2, (len(want) - 1) // size, len(want) // size + 1}:
        assert sorted((r.id, r.stt) for r in pages.page(number, size).collect()) == want[number * size : (number + 1) * size]


def test_a_deep_page_reads_its_ranges_only(table):
    plan = table.pages().page(8, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(id_range" in plan and "= 8)" in plan
    assert sorted(r.stt for r in table.pages().page(8, 10).collect()) == list(range(81, 91))
