"""The knowledge base's tables, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import upper_each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each user turn; its answer is the next turn if that is the assistant's."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(turns)).withColumn("next_text", F.lead("text").over(turns))
    replied = F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    return t.filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("question"), F.when(replied, F.col("next_text")).alias("answer"), replied.alias("has_answer"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the library; those with a label count as embedded."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("is_embed", F.lit(True))
    d = table(spark, sf_dir, "documents").join(known, "doc_id", "left")
    created = F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    path = F.concat(F.lit("storage/documents/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("description"), F.lit("pdf").alias("file_type"), path.alias("file_path"), created.alias("created_at"), F.coalesce("is_embed", F.lit(False)).alias("is_embed"), "text")


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).filter("id % 7 = 0").select("id")


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet rows with the question in column 1 and the answer in column 2, padded or emptied by id."""
    q = questions(spark, sf_dir)
    kind = F.col("id") % 5
    question = F.when(kind == 1, F.concat(F.lit("  "), "question", F.lit("\t"))).when(kind == 2, F.lit("")).otherwise(F.col("question"))
    answer = F.when(kind == 2, F.lit(None)).when(kind == 3, F.lit("  ")).otherwise(F.col("answer"))
    return q.select(F.col("id").alias("row_idx"), F.array(F.col("id").cast("string"), question, answer).alias("cells"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 2 = 1").select(F.col("doc_id").alias("input_pos"), F.col("text").alias("question"))


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("existing_id"), "text")


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of a duplicate check with actions: each question is its own match, with a score and an action by its id."""
    q = questions(spark, sf_dir)
    action = F.element_at(F.array(F.lit("overwrite"), F.lit("create_new"), F.lit("skip"), F.lit(None)), (F.col("id") % 4 + 1).cast("int"))
    score = F.when(F.col("id") % 11 != 0, F.col("id") % 801 / 8)
    return q.select(
        F.col("id").alias("input_pos"),
        F.concat(F.lit(" "), "question").alias("question"),
        "answer",
        "has_answer",
        F.when(F.col("id") % 6 != 0, F.col("id") % 3 != 0).alias("is_duplicate"),
        (F.col("id") - F.col("id") % 3).alias("existing_id"),
        F.when(F.col("id") % 13 != 0, F.col("question")).alias("existing_doc"),
        score.alias("score"),
        action.alias("action"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the admin console, one for each part."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("/admin/questions/edit/", "/admin//documents/", "/admin/questions/add/x%20y+", "/", "/admin/1e5/0x10/12abc/"))), (key % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(key.alias("path_id"), F.concat(kind, key.cast("string")).alias("path"))


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions sent by a form: as in the table but for white space, with other words, or with a word more; then once more, some with a word more or less, some without a question."""
    q = questions(spark, sf_dir)
    other = F.concat(F.lit("zz"), F.replace("question", F.lit(" "), F.lit(" zz")))
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), "question", F.lit("\n"))).when(F.col("id") % 3 == 1, other).otherwise(F.concat("question", F.lit(" more")))
    again = F.when(F.col("id") % 4 == 0, F.concat(other, F.lit(" again and again"))).when(F.col("id") % 4 == 1, F.regexp_replace(other, " [^ ]*$", "")).when(F.col("id") % 4 == 2, F.lit(None)).otherwise(upper_each(other))
    first = q.select(F.col("id").alias("input_pos"), text.alias("question"), "answer")
    return first.unionByName(q.select((F.col("id") + 1_000_000_000).alias("input_pos"), again.alias("question"), "answer"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files, one for each part; some of a kind that is not accepted."""
    kind = F.element_at(F.array(*map(F.lit, (".PDF", ".txt", ".pdf", ".pdf"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("storage/documents/"), F.col("p_partkey").cast("string"), kind)
    created = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), path.alias("path"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), created.alias("created_at"))


def sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions under way in each conversation, and a blank one in some."""
    conversations = messages(spark, sf_dir).select("conv_id").distinct()
    each = F.array(*(F.struct(F.lit(t).cast("bigint").alias("turn"), s.alias("sent")) for t, s in ((1001, F.lit(" first\n\n")), (1002, F.when(F.col("conv_id") % 5 == 0, F.lit(" \n")).otherwise(F.lit("second"))))))
    return conversations.select("conv_id", F.inline(each))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to them: to the second first, to the first twice in some, empty or missing in some, one to a turn that was not sent."""
    conversations = messages(spark, sf_dir).select("conv_id").distinct()
    c = F.col("conv_id")
    rows = ((1002, 1, F.when(c % 3 == 0, F.lit("")).otherwise(F.lit("to the second"))), (1001, 2, F.lit("to the first")), (1001, 3, F.when(c % 2 == 0, F.lit("better"))), (1003, 4, F.lit("to none")))
    each = F.array(*(F.struct(F.lit(t).cast("bigint").alias("turn"), F.lit(at).alias("at"), r.alias("reply")) for t, at, r in rows))
    return conversations.select("conv_id", F.inline(each)).filter("NOT (turn = 1001 AND conv_id % 7 = 0) AND NOT (at = 3 AND conv_id % 4 = 1)")


def write_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A file for each supplier below the path: of the kind and content of a PDF, or of another content, name or length."""
    kind = F.col("s_suppkey") % 4
    lines = F.concat(F.when(kind == 1, "<html> ").otherwise("%PDF-1.7 "), F.when(kind == 3, F.repeat("s_name", F.lit(100))).otherwise(F.col("s_name")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("number"), lines.alias("line"))
    # files take their time one by one, so they are dealt to all tasks, which put them in place themselves
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, rows.count() // 500), "number")
    committed = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    rows.filter("number % 4 <> 2").write.options(extension="pdf", **committed).partitionBy("number").csv(f"{path}/a")
    rows.filter("number % 4 = 2").write.options(**committed).partitionBy("number").text(f"{path}/b")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties, and two values to merge into them, whose shapes differ by row."""
    kind = F.col("event_id") % 4
    deep = F.concat(F.lit('{"k": {"deep": {"n": 1.50, "id": '), F.col("event_id").cast("string"), F.lit("}}}"))
    named = F.concat(F.lit('{"o": {"kind": "'), F.col("event_type"), F.lit('"}}'))
    first = F.when(kind == 0, deep).when(kind == 1, '{"k": null, "o": [1, {"a": 2}]}').when(kind == 2, '"text"').otherwise(named)
    second = F.when(F.col("event_id") % 3 == 0, '{"o": {"more": {"x": true}}}')
    return table(spark, sf_dir, "events").select("event_id", "props", F.parse_json("props").alias("target"), F.parse_json(first).alias("first"), F.parse_json(second).alias("second"))
