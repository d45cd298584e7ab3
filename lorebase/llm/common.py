"""What the operators share: reading tables, intermediate tables, row-wise Arrow work, sampling labels."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import shuffles_removed

#: Bytes that separate words in the operators' contracts, as a Java and DuckDB pattern.
SPACE = r"[\x20\x09-\x0D]+"

#: How many rows a Python worker turns into objects at once.
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a temporary folder is made in local mode only, where all tasks run on this machine; on a
    cluster each executor would write to a disk of its own, so that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lorebase-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again.

    This cuts lineage: what follows can be recomputed from the files when an executor is lost. Shuffles go as soon as it is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a settled table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context, as they may not have it installed."""
    context, top = spark.sparkContext, Path(__file__).parent.parent
    if not getattr(context, "_lorebase_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="lorebase-")) / "lorebase.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(archive))
        context._lorebase_shipped = True


class Remembered(dict):
    """What `find` gives for short strings, found on first use and kept.

    Two generations are kept, each of at most `entries` strings and `held` characters together. Strings over
    `longest` characters are never kept, so a text without white space takes no lasting memory.
    """

    def __init__(self, find: Callable[[str], object], entries: int = 250_000, held: int = 4_000_000, longest: int = 64):
        super().__init__()
        self.find, self.entries, self.held, self.longest = find, entries, held, longest
        self.size, self.old = 0, {}

    def __missing__(self, key: str) -> object:
        if len(key) > self.longest:
            return self.find(key)
        if len(self) >= self.entries or self.size >= self.held:
            self.old = dict(self)
            self.clear()
            self.size = 0
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        self[key] = value
        self.size += len(key)
        return value


def ddl(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., Sequence[Sequence]]]) -> DataFrame:
    """Each Arrow batch of df through a function of its columns as lists, which returns the new columns.

    start() runs once in each task, so that models and caches are built there. It gets ROWS rows at a time, so that a
    worker doesn't hold a whole batch of texts, and what is made of them, as Python objects.
    """
    ship(df.sparkSession)
    arrow = to_arrow_schema(ddl(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            out = work(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def crc_fold(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo of; null ids count as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0))


def third(doc_id: Column) -> Column:
    """0, 1 or 2 by another hash than the one that chooses samples."""
    return F.pmod(F.hash(doc_id, F.lit("third")), F.lit(3))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """Rows (doc_id, text, label) of at most `most` labelled documents for each value of the label.

    They are the ones whose ids hash lowest, so the choice does not depend on partitioning. A doc_id with several
    rows in docs counts once, with the text that hashes lowest; one with several labels has the largest. Only ids
    are ranked; texts are then fetched for the chosen ids, whose number is bounded by `most`.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.filter(train).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [known.filter(F.col("label") == v).orderBy(*order).limit(most) for v in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * most rows of two numbers
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(ids, "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
