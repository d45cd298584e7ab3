from lorebase.operators import selection
from pyspark.sql import functions as F


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def ids(df):
    return sorted(r.id for r in selection.ids(df).collect())


ODD = [0, 1, 63, 64, -1, -64, -65, 2**40, -(2**62), 2**63 - 1, 64, None]


def test_ids_come_back(spark):
    assert ids(selection.of(frame(spark, ODD))) == sorted({i for i in ODD if i is not None})
    assert ids(selection.of(frame(spark, []))) == []
    assert selection.size(selection.of(frame(spark, ODD))).first()[0] == 10 and selection.size(selection.of(frame(spark, []))).first()[0] == 0


def test_toggled_and_united(spark):
    a, b, c = ({3, 70, 500}, {3, 71, -9}, {3, 71, 10_000})
    of = [selection.of(frame(spark, x)) for x in (a, b, c)]
    assert ids(selection.toggled(*of)) == sorted(a ^ b ^ c) and ids(selection.united(*of)) == sorted(a | b | c)
    assert selection.toggled(of[0], of[0]).count() == 0


def test_rows_stay_where_they_are(spark):
    rows = spark.range(-500, 5000).select("id", F.col("id").alias("word"), F.lit("x").alias("bits"))
    rows = rows.unionByName(spark.createDataFrame([(None, None, "null")], "id bigint, word bigint, bits string"))
    sel = selection.of(frame(spark, range(-600, 6000, 7)))
    want = {i for i in range(-500, 5000) if i in range(-600, 6000, 7)}
    for most in (1 << 20, 0):
        got, left = selection.chosen(rows, sel, most), selection.others(rows, sel, most)
        assert got.columns == rows.columns and {r.id for r in got.collect()} == want
        assert {r.id for r in left.collect()} == set(range(-500, 5000)) - want | {None}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan and "hashpartitioning" not in plan) == bool(most) and ("SortMergeJoin" in plan) != bool(most)


def test_state(spark):
    rows = spark.range(10)
    for chosen, everything, some in (([], False, False), (range(10), True, False), ([4], False, True)):
        r = selection.state(rows, selection.of(frame(spark, chosen))).first()
        assert (r.n_filtered, r.n_selected, r.all_selected, r.some_selected) == (10, len(chosen), everything, some)
