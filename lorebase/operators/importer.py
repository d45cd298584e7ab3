"""Importing a sheet of questions: rows, duplicate check, split, and reconciliation with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clean_text, fixed2, lower_each, trim
from ..sources.shared import drop, scratch
from . import sets
from .similar import checked, distinct_texts, distinct_words, keyed, set_digest

# Fixed value: the heading of a row without a question.
NO_QUESTION = "[Chưa nhập câu hỏi]"


def rows_of(sheet: DataFrame) -> DataFrame:
    """Questions of sheet rows (row_idx, cells): the header dropped, and rows without a question and an answer.

    A cell counts as filled before it is trimmed; the flag is true for an answer of white space.
    """
    cell = lambda i: F.get("cells", F.lit(i))
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    kept = sheet.filter((F.col("row_idx") > 0) & (full(cell(1)) | full(cell(2))))
    return kept.select("row_idx", trim(F.coalesce(cell(1), F.lit(""))).alias("question"), trim(F.coalesce(cell(2), F.lit(""))).alias("answer"), full(cell(2)).alias("has_answer"))


def check(candidates: DataFrame, existing: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Each candidate (input_pos, question) with its best existing match (existing_id, text) and score.

    Texts that are equal after cleaning and lower-casing score 100; others score the Jaccard similarity of their
    word sets, in percent. Of the best matches the smallest existing_id counts. Matches below the threshold are not
    reported: their id and score are null. Equal texts are collapsed on both sides first.

    All are compared with all (`sets`), as an index for one check costs more than it saves. For a table that is checked
    against again and again, `similar.PrefixIndex` keeps one.
    """
    known = distinct_texts(keyed(existing.select("existing_id", F.col("text").alias("question"))), F.min("existing_id").alias("existing_id"))
    return checked(candidates, lambda texts: sets.best(texts, known, known.select("digest", "existing_id"), threshold))


def new_rows(checked: DataFrame) -> DataFrame:
    """Rows that are not marked as duplicates; a null mark counts as new."""
    return checked.filter(~F.coalesce("is_duplicate", F.lit(False)))


def duplicate_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.coalesce("is_duplicate", F.lit(False)))


def counts(checked: DataFrame) -> DataFrame:
    mark = F.coalesce("is_duplicate", F.lit(False))
    return checked.agg(F.count_if(~mark).alias("n_new"), F.count_if(mark).alias("n_duplicate"))


def merged(new: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Both, repeated rows included."""
    return new.unionByName(duplicates)


def duplicate_report(checked: DataFrame) -> DataFrame:
    """The score as a label and its band."""
    label = F.concat(F.coalesce(fixed2(F.col("score")), F.lit("0")), F.lit("%"))
    band = F.when(F.col("score") >= 90, "success").when(F.col("score") >= 70, "warning").otherwise("default")
    return checked.select("input_pos", F.coalesce("existing_doc", F.lit("—")).alias("existing"), label.alias("label"), band.alias("band"))


def save_new(rows: DataFrame) -> DataFrame:
    """Both fields cleaned, the flag as it came."""
    return rows.select("row_idx", clean_text(F.col("question")).alias("question"), clean_text(F.col("answer")).alias("answer"), "has_answer")


def inline_edit(rows: DataFrame, at: int, answer: str) -> DataFrame:
    """One row's answer set, and its flag from the trimmed answer."""
    here = F.col("row_idx") == at
    flag = F.when(here, F.lit(bool(answer.strip()))).otherwise(F.col("has_answer"))
    return rows.withColumn("answer", F.when(here, F.lit(answer)).otherwise(F.col("answer"))).withColumn("has_answer", flag)


def headings(rows: DataFrame) -> DataFrame:
    """What the list of new rows shows for each: its question, or a placeholder where that is null or empty."""
    return rows.select("row_idx", F.coalesce(F.nullif("question", F.lit("")), F.lit(NO_QUESTION)).alias("heading"))


def remove_at(rows: DataFrame, at: int) -> DataFrame:
    return rows.filter(F.col("row_idx") != at)


def _payload() -> list[Column]:
    answer = F.coalesce("answer", F.lit(""))
    return [F.col("question"), answer.alias("answer"), (trim(answer) != "").alias("has_answer")]


def overwrites(checked: DataFrame) -> DataFrame:
    """Rows marked to overwrite, under the id of the existing row, their texts as they are."""
    return checked.filter(F.col("action") == "overwrite").select("input_pos", F.col("existing_id").alias("id"), *_payload())


def creates(checked: DataFrame) -> DataFrame:
    """Rows marked to be created."""
    return checked.filter(F.col("action") == "create_new").select("input_pos", *_payload())


def reconcile(questions: DataFrame, checked: DataFrame) -> DataFrame:
    """The table after overwrites and creations, in one result.

    Of several overwrites of an id the last by input_pos counts; one of an id that is not there adds the row. New
    ids follow the largest id in the order of input_pos, with gaps, so that no task has to number all rows; as each
    row of a sheet has its own input_pos, they are distinct.
    """
    columns = ["id", "question", "answer", "has_answer"]
    changed = reconciled(questions, checked)
    return questions.select(columns).join(changed.select("id"), "id", "left_anti").unionByName(changed)


def reconciled(questions: DataFrame, checked: DataFrame) -> DataFrame:
    """The rows that `reconcile` puts in: overwrites under their ids, and creations under new ones."""
    columns = ["id", "question", "answer", "has_answer"]
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("input_pos")))
    changed = overwrites(checked).filter("id IS NOT NULL").withColumn("place", last).filter("place = 1").select(columns)
    top = F.broadcast(questions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))  # one row
    added = creates(checked).crossJoin(top).withColumn("id", F.col("input_pos") + 1 + F.col("top")).select(columns)
    return changed.unionByName(added)


def append_new(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with the rows of a sheet added, cleaned, under new ids: the largest id, 1 and the row_idx together.

    As each row of a sheet has its own row_idx, the ids are distinct; they have gaps, so that no task has to number
    all rows.
    """
    return questions.select("id", "question", "answer", "has_answer").unionByName(appended(questions, rows))


def appended(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that `append_new` adds."""
    top = F.broadcast(questions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))  # one row
    added = save_new(rows).crossJoin(top).withColumn("id", F.col("row_idx") + 1 + F.col("top"))
    return added.select("id", "question", "answer", "has_answer")


def add_questions(questions: DataFrame, sent: DataFrame, threshold: float = 70.0) -> DataFrame:
    """What becomes of each sent question (input_pos, question, answer): status 201 with its new id, or 409, a conflict.

    The result is that of sending them one after the other, by input_pos, which is distinct: a question is a conflict
    with what is in the table and with each one before it that was put in, not with one that was itself refused. A
    conflict has the id and score of its best match among those. Fields are cleaned and the flag follows the cleaned
    answer; rows without a question, which the form refuses, are left out.

    A table of similar pairs is decided in rounds: of the questions in it that wait for none before them, all are put
    in at once, and those similar to one of them are refused. Rounds are as many as the longest chain of questions
    that wait for one another; each reads the pairs that are still open.
    """
    form = sent.filter(F.col("question").isNotNull() & (F.col("question") != "")).select("input_pos", clean_text(F.col("question")).alias("question"), clean_text(F.col("answer")).alias("answer"))
    form = form.withColumn("words", distinct_words(lower_each(F.col("question"))))
    form = scratch(form.withColumn("digest", set_digest(F.col("words"))), "form")
    texts = distinct_texts(form, F.min("input_pos").alias("first"))
    table = distinct_texts(keyed(questions.select("id", "question")), F.min("id").alias("existing_id"))
    known = scratch(sets.best(texts, table, table.select("digest", "existing_id"), threshold), "known")
    drop(table)
    new = scratch(texts.join(known, "digest", "left_anti"), "new")
    pairs = sets.matches(texts, new, threshold)

    order = new.select("digest", "first")
    waits = pairs.join(order.withColumnsRenamed({"digest": "own", "first": "own_first"}), "own").join(order, "digest").filter("own_first > first")
    open_, refused = scratch(waits.select("own", "digest"), "open"), []
    while not open_.isEmpty():
        heads = open_.select("digest").distinct().join(open_.select(F.col("own").alias("digest")), "digest", "left_anti")
        refused.append(scratch(open_.join(heads, "digest", "left_semi").select("own").distinct(), "refused"))
        left = open_.join(refused[-1], "own", "left_anti")
        open_ = scratch(left.join(refused[-1].select(F.col("own").alias("digest")), "digest", "left_anti"), "open")
    put_in = order
    for own in refused:
        put_in = put_in.join(own.select(F.col("own").alias("digest")), "digest", "left_anti")
    top = F.broadcast(questions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))  # one row
    put_in = scratch(put_in.crossJoin(top).select("digest", "first", (F.col("top") + 1 + F.col("first")).alias("id")), "put-in")

    offers = pairs.join(put_in, "digest").select(F.col("own").alias("digest"), "first", "id", "score")
    offers = offers.unionByName(put_in.withColumn("score", F.lit(100.0)))
    offers = offers.unionByName(known.select("digest", F.lit(None).cast("bigint").alias("first"), F.col("existing_id").alias("id"), "score"))
    before = form.select("input_pos", "digest").join(offers, "digest").filter(F.col("first").isNull() | (F.col("first") < F.col("input_pos")))
    best = before.groupBy("input_pos").agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("best"))
    inserted = put_in.select(F.col("first").alias("input_pos"), F.col("id").alias("new_id"))
    rows = form.join(best, "input_pos", "left").join(inserted, "input_pos", "left")
    match = F.when(F.col("new_id").isNull(), F.col("best"))
    return rows.select("input_pos", F.when(F.col("new_id").isNull(), 409).otherwise(201).alias("status"), F.col("new_id").alias("id"), "question", "answer", (F.col("answer") != "").alias("has_answer"), (-match["id"]).alias("existing_id"), F.round(match["score"], 6).alias("score"))
