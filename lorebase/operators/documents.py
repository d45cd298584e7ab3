"""The document library: cards, paths, pending documents, chunks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import fixed1, without_first

# The labels of the flag.
EMBEDDED, NOT_EMBEDDED = "Đã xử lý dữ liệu", "Chưa xử lý dữ liệu"


def cards(documents: DataFrame) -> DataFrame:
    """What a card shows: type and time of upload, and whether the document has been embedded."""
    caption = F.concat(F.coalesce(F.upper("file_type"), F.lit("")), F.lit(" - "), F.date_format("created_at", "dd/MM/yyyy HH:mm:ss"))
    status = F.when(F.coalesce("is_embed", F.lit(False)), EMBEDDED).otherwise(NOT_EMBEDDED)
    return documents.select("id", "title", "description", caption.alias("caption"), status.alias("status"))


def api_path(documents: DataFrame) -> DataFrame:
    """The path that the services expect: without the first 'storage/'."""
    return documents.select("id", without_first(F.col("file_path"), "storage/").alias("api_path"))


def pending(documents: DataFrame) -> DataFrame:
    """Documents that are not embedded; a null flag counts as not."""
    return documents.filter(~F.coalesce("is_embed", F.lit(False)))


def chunks(documents: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Pieces of `size` characters, each repeating the last `overlap` ones of the piece before it."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    length = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size - overlap))
    rows = documents.filter("text IS NOT NULL").select("id", "text", F.posexplode(starts).alias("chunk", "start"))
    return rows.select("id", F.col("chunk").cast("bigint").alias("chunk"), F.substring("text", F.col("start") + 1, F.lit(size)).alias("piece"))


def embed_requests(documents: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """What is asked for each pending document; credentials are not part of the data."""
    return api_path(pending(documents)).select(F.col("api_path").alias("file_path"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"))


def page_numbers(documents: DataFrame, pages: str = "n_pages") -> DataFrame:
    """A row for each page from 1; none for fewer than one page."""
    return documents.filter(F.col(pages) > 0).select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(pages).cast("bigint"))).alias("page"))


def size_label(files: DataFrame) -> DataFrame:
    """Kilobytes with one decimal, of a table with a length in bytes."""
    return files.withColumn("size_kb", F.concat(fixed1(F.col("length") / 1024), F.lit(" KB")))


def accepted(files: DataFrame, kind: str = ".pdf") -> DataFrame:
    """Files (path, ...) whose name ends with the kind, in lower case."""
    return files.filter(F.endswith("path", F.lit(kind)))


def checked_files(spark: SparkSession, path: str, kind: str = ".pdf", signature: bytes = b"%PDF-", most: int = 64 << 20) -> DataFrame:
    """The files below a path, with what decides on it: path, length, reason, sha256.

    Names and lengths come from the listing; contents are read only of files of the kind, in lower case, that are not
    longer than `most` bytes, one file at a time. `reason` says what speaks against a file: "kind", "length" (longer,
    or shorter than the signature) or "content" (it begins otherwise); it is null for an accepted one. sha256, the
    digest of the content, is null where no content was read. An empty file has no row, as Spark's readers pass over it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    of_kind, fits = F.endswith("path", F.lit(kind)), F.col("length").between(len(signature), most)
    unread = F.when(~of_kind, "kind").otherwise("length").alias("reason")
    # a folder of few files each is listed in no time, so a task lists many
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing)
    spark.conf.set(listing, str(4 * spark.sparkContext.defaultParallelism))
    try:
        everything, of_name = files.load(path), files.option("pathGlobFilter", f"*{kind}").load(path)
    finally:
        spark.conf.set(listing, before)
    listed = everything.filter(~of_kind | ~fits).select("path", "length", unread, F.lit(None).cast("string").alias("sha256"))
    begin = F.substring("content", 1, len(signature)) == F.lit(signature)
    read = of_name.filter(fits)
    return listed.unionByName(read.select("path", "length", F.when(~begin, "content").alias("reason"), F.sha2("content", 256).alias("sha256")))


def upload(documents: DataFrame, files: DataFrame) -> DataFrame:
    """The table with a row for each accepted file (number, path, title, description, created_at), not yet embedded.

    New ids are the largest id and the file's number, from 1, together; numbers are distinct.
    """
    columns = ["id", "title", "description", "file_type", "file_path", "created_at", "is_embed"]
    top = F.broadcast(documents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))  # one row
    rows = accepted(files).crossJoin(top).withColumn("id", F.col("top") + F.col("number"))
    rows = rows.withColumns({"file_type": F.lit("pdf"), "file_path": F.col("path"), "is_embed": F.lit(False)})
    return documents.select(columns).unionByName(rows.select(columns))


def delete(documents: DataFrame, id_: int) -> DataFrame:
    return documents.filter(F.col("id") != id_)


def embedded(documents: DataFrame, done: DataFrame) -> DataFrame:
    """The table with the flag set for the ids whose embedding is done."""
    marks = done.select("id", F.lit(True).alias("done")).distinct()
    return documents.join(marks, "id", "left").withColumn("is_embed", F.coalesce("done", "is_embed", F.lit(False))).drop("done")
