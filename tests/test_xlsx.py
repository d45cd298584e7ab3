import io
import zipfile

import pytest
from lorebase.sources import xlsx


def test_columns():
    assert [xlsx.column_number(xlsx.column_name(n)) for n in range(800)] == list(range(800))


def test_build_and_parse():
    rows = [["STT", "a"], [1, " <&> \né"], [None, "x"], [2.5, None]]
    assert list(xlsx.parse_workbook(xlsx.build_workbook(rows))) == [(0, ["STT", "a"]), (1, ["1", " <&> \né"]), (2, [None, "x"]), (3, ["2.5"])]


def test_shared_strings_and_sparse_cells():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", xlsx._WORKBOOK.format("s"))
        z.writestr("xl/_rels/workbook.xml.rels", xlsx._RELATIONS)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>p</t></si><si><r><t>q</t></r><r><t>r</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert list(xlsx.parse_workbook(out.getvalue())) == [(1, [None, None, "qr"])]


@pytest.mark.parametrize("parts", [1, 3])
def test_write_and_read(spark, tmp_path, parts):
    df = spark.range(10).selectExpr("id", "concat('t', id) AS t").repartition(parts)
    xlsx.write_sheets(df, str(tmp_path / "out"), "Sheet")
    got = xlsx.read_sheets(spark, str(tmp_path / "out")).filter("row_idx > 0").collect()
    assert sorted(tuple(r.cells) for r in got) == [(str(i), f"t{i}") for i in range(10)]
    assert xlsx.file_sizes(spark, str(tmp_path / "out")).count() == parts


def test_new_workbook_when_one_is_full(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, NULL, concat('ä\u2028', id)) AS t", "id / 7 AS x").repartition(2)
    xlsx.write_sheets(df, str(tmp_path / "out"), most=101)
    files = list((tmp_path / "out").glob("*.xlsx"))
    assert len(files) == 10 and all(zipfile.ZipFile(f).testzip() is None for f in files)
    rows = xlsx.read_sheets(spark, str(tmp_path / "out"))
    assert rows.groupBy("file").count().selectExpr("max(count)").first()[0] == 101
    got = sorted((int(r.cells[0]), r.cells[1], float(r.cells[2])) for r in rows.filter("row_idx > 0").collect())
    assert got == [(i, f"ä\u2028{i}" if i % 3 else None, i / 7) for i in range(1000)]


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(100, numPartitions=4).selectExpr("if(id = 99, raise_error('broken'), id) AS id")
    with pytest.raises(Exception, match="broken"):
        xlsx.write_sheets(df, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_empty_table_is_a_header(spark, tmp_path):
    xlsx.write_sheets(spark.createDataFrame([], "id int, t string").coalesce(1), str(tmp_path / "out"))
    assert [(r.row_idx, r.cells) for r in xlsx.read_sheets(spark, str(tmp_path / "out")).collect()] == [(0, ["id", "t"])]


def test_rows_are_read_as_a_stream():
    """A sheet of many rows is parsed in memory that doesn't grow with them."""
    import tracemalloc

    content = xlsx.build_workbook([i, f"text number {i}"] for i in range(100_000))
    tracemalloc.start()
    assert sum(1 for _ in xlsx.parse_workbook(content)) == 100_000
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
