import hashlib

from lorebase.operators import documents
from lorebase.plans import fixtures


def test_checked_files(spark, tmp_path):
    inner = tmp_path / "sub"
    inner.mkdir()
    files = {"a.pdf": b"%PDF-1.4\n...", "b.pdf": b"<html>", "c.txt": b"%PDF-1.4", "d.PDF": b"%PDF-1.4", "e.pdf": b"", "f.pdf": b"%PDF-" + b"x" * 100, "g.pdf": b"%PDF-", "h.pdf": b" %PDF-1.4", "i.pdf": b"%PDF"}
    for name, content in files.items():
        (inner / name).write_bytes(content)
    # the empty one has no row
    got = {r.path.rpartition("/")[2]: r for r in documents.checked_files(spark, str(tmp_path), most=100).collect()}
    assert {n: r.reason for n, r in got.items()} == {"a.pdf": None, "b.pdf": "content", "c.txt": "kind", "d.PDF": "kind", "f.pdf": "length", "g.pdf": None, "h.pdf": "content", "i.pdf": "length"}
    assert all(r.length == len(files[n]) for n, r in got.items())
    assert all(r.sha256 == (hashlib.sha256(files[n]).hexdigest() if r.reason in (None, "content") else None) for n, r in got.items())


def test_contents_are_read_of_candidates_only(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    plan = documents.checked_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan binaryFile" in line]
    assert len(scans) == 2 and sum("content#" in s for s in scans) == 1 and all("PushedFilters: []" not in s for s in scans if "content#" in s)


def test_files_are_dealt_to_all_tasks(spark, tmp_path):
    """A table of one partition is written by several tasks, which all file names tell."""
    suppliers = spark.range(1200).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").coalesce(1)
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    fixtures.write_files(spark, str(tmp_path), f"{tmp_path}/files")
    names = [f.name for f in tmp_path.glob("files/*/number=*/part-*")]
    assert len(names) == 1200 and len({n.split("-")[1] for n in names}) >= 4
