import zlib

import pytest
from lorebase.llm import quality, queries

from .conftest import ROWS

SF = "/root/testdata/sf0.01"


def held(i, of=5):
    return i is None or zlib.crc32(str(i).encode()) % of == 0


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op2_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    mine = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good = [p for y, p in mine if y == 1]
    assert sum(y == p for y, p in mine) / len(mine) > 0.93 and sum(good) / len(good) > 0.97


def test_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = quality.score(odd, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted)
    assert quality.score(empty, model).collect() == []


def test_whole_texts_and_the_difference_alone(spark):
    """Every row against a plain version: sizes by both dictionaries, block by block, over the whole text."""
    import math

    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    sizes = []
    for raw in (model.good, model.bad):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False)
        sizes.append(lambda x, c=c: sum(len(c.compress(x[i : i + quality.BLOCK])) for i in range(0, len(x), quality.BLOCK)))
    slope, constant = model.weights
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    off = []
    for r in docs.collect():
        x = r.text.encode()
        z = slope * (10 * (sizes[1](x) - sizes[0](x)) + quality.ADDED * model.average) / (len(x) + quality.ADDED) + constant
        off.append(abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-30, min(30, z))))))
    assert max(off) < 0.02


def test_sample_is_bounded_by_rows(spark):
    """A labelled doc_id with many rows counts once, with a text that does not depend on their order."""
    from lorebase.llm.common import labelled_sample
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "b"), (3, "c"), (None, "d")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1)], "doc_id bigint, quality int")
    rows = labelled_sample(docs.repartition(7), labels, "quality", F.lit(True), 10).collect()
    again = labelled_sample(docs.orderBy(F.desc("text")), labels, "quality", F.lit(True), 10).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and sorted((r.doc_id, r.label) for r in rows) == [(1, 1), (2, 0), (3, 0)]


@pytest.mark.parametrize("kinds", [[], [1] * 20])
def test_without_both_labels(spark, odd, kinds):
    labels = spark.createDataFrame(list(enumerate(kinds)) + [(None, None)], "doc_id bigint, quality int")
    scores = {r.score for r in quality.score(odd, quality.fit(odd, labels)).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    from lorebase.llm.common import crc_fold
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(crc_fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_keep_good_takes_any_column_names(spark):
    class Fixed:
        """A model whose score is 1 for texts with an x."""

        def scorer(self):
            return lambda text: float("x" in (text or ""))

    docs = spark.createDataFrame([(1, "ax", 7), (2, None, 8), (None, "x", 9)], "doc_id bigint, text string, `a.b` int")
    kept = quality.keep_good(docs, Fixed())
    assert kept.columns == docs.columns and sorted(r["a.b"] for r in kept.collect()) == [7, 9]
