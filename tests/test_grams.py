"""Search through the index of pieces against the plain search."""

import pytest
from lorebase.operators import grams, questions
from lorebase.sources.ranges import RangeTable

TEXTS = ["What is the FEE?", "Straße und Größe", "ab", "a", "", None, "xyz 🙂 emoji", "100% _sure_ (yes)", "İstanbul ΑΣ", "line\nbreak"]
NEEDLES = ["", "a", "A", "ab", "fee", "the f", "STRASSE", "straße", "ß", "🙂", "🙂 e", "%", "_s", "(yes)", "zq", "number 17", "NUMBER 4", "e\nb", "σ", "ας", "i̇s"]


def rows(df):
    return sorted(map(str, df.select("id", "question", "answer").collect()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    data = [(k, TEXTS[k] if k < len(TEXTS) else f"question number {k}", f"answer {TEXTS[k % len(TEXTS)]}" if k % 37 == 0 else None) for k in range(400)]
    frame = spark.createDataFrame(data, "id bigint, question string, answer string")
    table = RangeTable.create(frame, str(tmp_path_factory.mktemp("grams") / "t"), width=20)
    return table, grams.GramIndex.create(table, str(tmp_path_factory.mktemp("grams") / "g"), 4)


def test_same_rows(stored):
    table, index = stored
    for needle in NEEDLES:
        assert rows(index.search(needle)) == rows(questions.search(table.read(), needle)), needle


def test_blocks_are_pruned(stored):
    table, index = stored
    assert index.blocks("") is None and index.blocks("fee") == [0, 18] and index.blocks("zq") == []
    assert index.blocks("number 17") == [0, 8]  # 17, 170 to 179
    plan = index.search("number 17")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [id_range" in plan


def test_changes(spark, tmp_path):
    table = RangeTable.create(spark.createDataFrame([(k, f"old {k}", None) for k in range(100)], "id bigint, question string, answer string"), str(tmp_path / "t"), width=10)
    index = grams.GramIndex.create(table, str(tmp_path / "g"), 3)
    changed = spark.createDataFrame([(55, "brand NEW", "x"), (205, "other", "newer")], "id bigint, question string, answer string")
    index.add(changed)
    table.apply(changed)
    assert index.blocks("new") == [5, 20]
    for needle in ("new", "old 5", "old 55", "w"):
        assert rows(index.search(needle)) == rows(questions.search(table.read(), needle))
