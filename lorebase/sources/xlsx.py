"""Spreadsheet files as a source and a sink.

Both go through Spark's own file sources and committers, so any store that Spark reaches will do. A sheet holds
1,048,576 rows at most, by its format, so a workbook is the work of one task: it is read as a stream of rows, and a
task that writes begins another workbook when one is full.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import shared_folder

# Fixed values of the Office Open XML format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_ROOT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
_WORKBOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{}" sheetId="1" r:id="rId1"/></sheets></workbook>'
#: Rows of a sheet, its header included. A fixed value of the format.
SHEET_ROWS = 1_048_576
#: Rows that a task sends at once when it reads.
BATCH = 10_000
#: Workers get this module with the work, as they may not have it installed.
register_pickle_by_value(sys.modules[__name__])
_UNSAFE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_name(n: int) -> str:
    name = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return name


def _text(node: ElementTree.Element) -> str:
    """Plain and rich text, without phonetic hints."""
    runs = [node.find(f"{MAIN}t"), *(r.find(f"{MAIN}t") for r in node.findall(f"{MAIN}r"))]
    return "".join(t.text or "" for t in runs if t is not None)


def parse_workbook(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row_idx from 0, cells) of the first sheet; cells are placed by their references, missing ones are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        first = book.find(f"{MAIN}sheets/{MAIN}sheet").get(RELATION)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheet = targets[first].lstrip("/")
        sheet = sheet if sheet in names else f"xl/{sheet}"
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        at, data = -1, None
        with z.open(sheet) as f:
            for event, row in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    data = row if row.tag == f"{MAIN}sheetData" else data
                    continue
                if row.tag != f"{MAIN}row":
                    continue
                at = int(row.get("r", at + 2)) - 1
                cells: list[str | None] = []
                for c in row.findall(f"{MAIN}c"):
                    place = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    value, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        inline = c.find(f"{MAIN}is")
                        cells[place] = _text(inline) if inline is not None else None
                    elif value is not None and value.text is not None:
                        cells[place] = shared[int(value.text)] if kind == "s" else value.text
                yield at, cells
                data.clear()  # rows that have been read take no memory


class Workbook:
    """A workbook of one sheet, written row by row: numbers as numbers, nulls as missing cells, anything else as text."""

    def __init__(self, sheet: str = "Sheet1"):
        self.out, self.rows = io.BytesIO(), 0
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr("[Content_Types].xml", _TYPES)
        self.zip.writestr("_rels/.rels", _ROOT)
        self.zip.writestr("xl/workbook.xml", _WORKBOOK.format(escape(sheet[:31], {'"': "&quot;"})))
        self.zip.writestr("xl/_rels/workbook.xml.rels", _RELATIONS)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())

    def add(self, row: Iterable) -> None:
        self.rows += 1
        cells = []
        for c, v in enumerate(row):
            if v is None:
                continue
            at = f'r="{column_name(c)}{self.rows}"'
            number = isinstance(v, (int, float)) and not isinstance(v, bool)
            cells.append(f"<c {at}><v>{v}</v></c>" if number else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_UNSAFE.sub("", str(v)))}</t></is></c>')
        self.sheet.write(f'<row r="{self.rows}">{"".join(cells)}</row>'.encode())

    def content(self) -> bytes:
        """The finished archive. Its comment is a line feed, so that it may end in one."""
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.comment = b"\n"
        self.zip.close()
        return self.out.getvalue()


def build_workbook(rows: Iterable[Iterable], sheet: str = "Sheet1") -> bytes:
    book = Workbook(sheet)
    for row in rows:
        book.add(row)
    return book.content()


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_idx, cells) of the first sheet of each workbook at the path; row 0 is the header."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))])
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held: list[tuple[int, list[str | None]]] = []
                for row in parse_workbook(content.as_py()):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array([i for i, _ in held], pa.int64()), pa.array([c for _, c in held], pa.list_(pa.string()))], schema=schema)
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(held), pa.string()), pa.array([i for i, _ in held], pa.int64()), pa.array([c for _, c in held], pa.list_(pa.string()))], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInArrow(parse, "file string, row_idx bigint, cells array<string>")


def write_sheets(df: DataFrame, folder: str, sheet: str = "Sheet1", most: int = SHEET_ROWS) -> None:
    """Workbooks of df in a folder, with a header each: one for each partition, and another for each `most` rows more.

    A task builds a workbook in memory, deflated as it goes. Spark writes them, as files of one text each, to a folder
    beside, so that what failed or was tried twice leaves nothing; then they are moved, which copies no data.
    """
    columns = df.columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if book is not None and book.rows == most:
                    yield pa.RecordBatch.from_arrays([pa.array([book.content()], pa.binary())], names=["book"])
                    book = None
                if book is None:
                    book = Workbook(sheet)
                    book.add(columns)
                book.add(row)
        if book is None:
            book = Workbook(sheet)
            book.add(columns)
        yield pa.RecordBatch.from_arrays([pa.array([book.content()], pa.binary())], names=["book"])

    spark = df.sparkSession
    beside = shared_folder(spark, "workbooks")
    # the writer ends each text in a line feed, which is the last byte of a workbook
    books = df.mapInArrow(build, "book binary").select(F.expr("cast(substring(book, 1, length(book) - 1) AS string)"))
    books.write.option("maxRecordsPerFile", 1).text(beside)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(folder)
    source = jvm.org.apache.hadoop.fs.Path(beside)
    files, store = source.getFileSystem(conf), target.getFileSystem(conf)
    store.mkdirs(target)
    for written in files.listStatus(source):
        name = written.getPath().getName()
        if name.endswith(".txt"):
            to = jvm.org.apache.hadoop.fs.Path(target, name.removesuffix(".txt") + ".xlsx")
            jvm.org.apache.hadoop.fs.FileUtil.copy(files, written.getPath(), store, to, True, conf) if files.getUri() != store.getUri() else store.rename(written.getPath(), to)
    files.delete(source, True)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files at the path; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
