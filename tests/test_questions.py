import pytest
from lorebase.functions.rows import with_ordinal
from lorebase.operators import chat, documents, importer, navigation, questions, utilities
from lorebase.plans import catalog
from pyspark.sql import functions as F

SCHEMA = "id bigint, question string, answer string, has_answer boolean"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, f"q{i}" if i % 5 else None, f"a{i}" if i % 2 else None, [True, False, None][i % 3]) for i in range(23)], SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_tabs_part_the_table(table):
    answered, open_ = (ids(questions.tab(table, t)) for t in ("answered", "unanswered"))
    assert sorted(answered + open_) == list(range(23))
    assert not ids(questions.tab(table, "other"))


def test_pages(table):
    pages = [questions.page(table, p, 10).collect() for p in range(4)]
    assert [[r.stt for r in p] for p in pages] == [list(range(1, 11)), list(range(11, 21)), [21, 22, 23], []]
    assert sorted(r.id for p in pages for r in p) == list(range(23))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans(table, spark):
    assert "TakeOrderedAndProject" in plan_of(questions.page(table, 1, 10))
    assert "LeftAnti" in plan_of(questions.delete_many(table, table.select("id").limit(3)))
    for name in ("question_list_page", "import_rows", "document_chunks", "chat_history_payload"):
        plan = plan_of(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "Python" not in plan and "Arrow" not in plan


def test_toggle_twice_is_nothing(spark):
    one, two = (spark.createDataFrame([(i,) for i in x], "id bigint") for x in ([1, 2], [2]))
    assert ids(questions.toggle(one, two)) == [1]
    assert ids(questions.toggle(questions.toggle(one, two), two)) == [1, 2]


@pytest.mark.parametrize(("n", "m", "all_", "some"), [(0, 0, False, False), (5, 0, False, False), (5, 3, False, True), (5, 5, True, False), (5, 6, False, False)])
def test_selection_state(spark, n, m, all_, some):
    r = questions.selection_state(spark.range(n), spark.range(m)).first()
    assert (r.all_selected, r.some_selected) == (all_, some)


def test_ordinals(spark):
    rows = with_ordinal(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), "k", "n", 16).collect()
    assert all(r.n == r.k + 1 for r in rows)
    assert with_ordinal(spark.range(0), "id", "n").collect() == []


def test_import_rows(spark):
    cells = [["h", "h", "h"], ["1", "q", None], ["2", None, "a"], ["3", "", ""], ["4", "  ", None], ["5", " q ", "  "], ["6"]]
    sheet = spark.createDataFrame(list(enumerate(cells)), "row_idx bigint, cells array<string>")
    got = {r.row_idx: (r.question, r.answer, r.has_answer) for r in importer.rows_of(sheet).collect()}
    assert got == {1: ("q", "", False), 2: ("", "a", True), 4: ("", "", False), 5: ("q", "", True)}


def test_duplicate_check_is_exact(spark):
    texts = ["a b c d", "A  b c d", "a b c d e", "x y z", "", "a b c z y x w", None]
    rows = list(enumerate(texts))
    got = importer.check(spark.createDataFrame(rows, "input_pos bigint, question string"), spark.createDataFrame([(10, "a b c d"), (11, "x y q"), (12, "a b c d e f"), (9, "a b c d e f")], "existing_id bigint, text string"))
    best = {r.input_pos: (r.existing_id, r.score) for r in got.collect()}
    assert best[0] == (10, 100.0)
    assert best[1] == (10, 80.0) or best[1] == (10, 100.0)
    assert best[2] == (9, round(500 / 6, 6))
    assert best[3] == best[4] == best[5] == best[6] == (None, None)


def test_reconcile(spark, table):
    checked = spark.createDataFrame(
        [(0, "n0", " ", 3, "overwrite"), (1, "n1", "x", 3, "overwrite"), (2, "n2", None, 4, "create_new"), (3, "n3", "y", 5, "skip"), (4, "n4", "y", 6, None)],
        "input_pos bigint, question string, answer string, existing_id bigint, action string",
    )
    got = {r.id: (r.question, r.answer, r.has_answer) for r in importer.reconcile(table, checked).collect()}
    assert len(got) == 24 and got[3] == ("n1", "x", True) and got[25] == ("n2", "", False)


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, ""), (3, None)], "id bigint, text string")
    got = sorted((r.id, r.chunk, len(r.piece)) for r in documents.chunks(docs, 400, 100).collect())
    assert got == [(1, 0, 400), (1, 1, 400), (1, 2, 400), (1, 3, 100), (2, 0, 0)]
    with pytest.raises(ValueError):
        documents.chunks(docs, 200, 200)


def test_history_is_strictly_before(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", " \n c "), (1, 3, "user", " ")]
    got = {r.turn: (r.question, [m.text for m in r.messages]) for r in chat.history_payload(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == {0: ("a", []), 2: ("c", ["a", "b"])}


def test_navigation(spark):
    nav = navigation.menu(spark)
    assert {r.node_id for r in navigation.active(spark, nav, "/admin/questions/add").collect() if r.active} == {4, 6}
    assert navigation.flatten(spark, nav).filter("kind = 'branch'").count() == 2


def test_merge(spark):
    maps = spark.sql("SELECT map('a', '1', 'b', '2') AS x, map('b', '3') AS y, CAST(NULL AS map<string,string>) AS z")
    r = maps.select(utilities.merge(F.col("x"), F.col("y"), F.col("z")).alias("m"), utilities.merge(F.col("z"), F.col("y")).alias("n")).first()
    assert r.m == {"a": "1", "b": "3"} and r.n == {"b": "3"}
