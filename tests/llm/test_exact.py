import hashlib
import re

import pytest

from lorebase.llm import exact, keeping, queries

from .conftest import ROWS, SF


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(t.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return sorted(map(str, out))


def test_odd_rows(odd, empty):
    for support in (1e-3, 0.1, 0.9):
        got = exact.duplicates(odd, support).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(str(tuple(r)) for r in got) == brute(ROWS)
    assert exact.duplicates(empty).collect() == [] and exact.keep_first(empty).collect() == []


def test_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"text {i // 6}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = exact.duplicates(df, 0.01).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    heavy = exact.heavy_hitters(df.selectExpr("struct(doc_id IS NULL AS last, doc_id, doc_id AS n) AS row", "text AS text_sha256"), support=0.01).collect()
    assert [(r.text_sha256, r.first.doc_id, r.n) for r in heavy] == [("same", 1, 2000)]


def test_keep_first(odd):
    kept = exact.keep_first(odd)
    assert kept.columns == odd.columns
    want = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS}
    got = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(got) == sorted(want)
    assert {r.doc_id for r in kept.collect()} == {1, 3, 5, 6, 8, 9, 10, 11, 12, -5, 13}


def test_keep_first_with_repeated_ids(spark):
    """Rows of one doc_id that differ in white space only: the one whose MD5 comes first; other columns by JSON."""
    rows = [(1, "a b", "z"), (1, "a  b", "y"), (1, "a b", "x"), (5, "a\tb", "w"), (5, "own", "v"), (None, "own", "u"), (None, None, "t"), (None, "", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc string")
    first = min(("a b", "a  b"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = [(1, first, "x" if first == "a b" else "y"), (5, "own", "v"), (None, None, "t")]
    for k in (1, 3, 8):
        for support in (1e-3, 0.3):
            got = [tuple(r) for r in exact.keep_first(df.repartition(k, "doc"), support).collect()]
            assert sorted(map(str, got)) == sorted(map(str, want))


def test_plan_has_no_python(spark, capsys):
    exact.duplicates(spark.read.parquet(f"{SF}/documents.parquet")).explain()
    exact.keep_first(spark.read.parquet(f"{SF}/documents.parquet")).explain()
    plan = capsys.readouterr().out
    assert plan.count("Physical Plan") == 2 and not re.search("Python|InArrow|InPandas|Cartesian|NestedLoop", plan)


def test_query(spark, documents):
    got = queries.op7_exact_dedup(spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(list(zip(documents.doc_id.tolist(), documents.text, strict=True)))


@pytest.mark.parametrize("most_bytes", [keeping.MARKS, 0])
def test_keep_leaves_rows_of_other_ids_where_they_lie(spark, monkeypatch, most_bytes):
    """Rows of doc_ids that nothing goes of are not joined by their key, which is not even made for them; all rows are right either way."""
    rows = [(k, f"text {k % 90}") for k in range(-30, 100)] + [(None, "text 3"), (None, "own"), (5, "text 50"), (200, "twice"), (200, "twice")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    named = docs.select("doc_id", "text", keeping.row_key().alias("key"))
    losers, repeated = named.filter("text IN ('text 3', 'text 7') OR doc_id % 9 = 0").select("key"), named.filter("text = 'twice'").select("key")
    kept = keeping.keep(docs, losers, repeated, most_bytes)
    want = [r for r in rows if r[1] not in ("text 3", "text 7") and (r[0] is None or r[0] % 9)]
    want.remove((200, "twice"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert ("marked_word" in plan) == (most_bytes > 0)
