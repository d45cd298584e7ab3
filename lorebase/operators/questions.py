"""The question list: search, tabs, pages, display, selection, writes and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rows import with_ordinal
from ..functions.text import clean_text, contains_ignoring_case, leading_int

# The labels of the flag.
ANSWERED, UNANSWERED = "Đã trả lời", "Chưa trả lời"


def matches_search(needle: str) -> Column:
    return contains_ignoring_case(F.col("question"), needle) | contains_ignoring_case(F.col("answer"), needle)


def in_tab(tab: str) -> Column:
    """A null flag counts as unanswered, so the two tabs part the table; an unknown tab holds nothing."""
    answered = F.coalesce(F.col("has_answer"), F.lit(False))
    return {"all": F.lit(True), "answered": answered, "unanswered": ~answered}.get(tab, F.lit(False))


def search(questions: DataFrame, needle: str) -> DataFrame:
    return questions.filter(matches_search(needle))


def tab(questions: DataFrame, name: str) -> DataFrame:
    return questions.filter(in_tab(name))


def filtered(questions: DataFrame, needle: str, name: str) -> DataFrame:
    return questions.filter(matches_search(needle) & in_tab(name))


def page(questions: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Rows of a 0-based page in the order of id, with their place `stt` in the whole list; empty past the end."""
    rows = questions.orderBy("id").offset(number * size).limit(size)
    # the window is over the rows of one page only
    return rows.withColumn("stt", (F.row_number().over(Window.orderBy("id")) + number * size).cast("bigint"))


def paginate(rows: DataFrame, current: int = 1, size: int = 6, key: str = "id") -> DataFrame:
    """Rows of a 1-based page in the order of the key."""
    return rows.orderBy(key).offset((current - 1) * size).limit(size)


def filtered_count(questions: DataFrame) -> DataFrame:
    return questions.agg(F.count(F.lit(1)).alias("n"))


def lookup(questions: DataFrame, id_: int) -> DataFrame:
    return questions.filter(F.col("id") == id_).select("id", "question", F.coalesce("answer", F.lit("")).alias("answer"), "has_answer")


def display(questions: DataFrame) -> DataFrame:
    """The answer, or a dash for none, and the label of the flag."""
    shown = F.coalesce(F.nullif("answer", F.lit("")), F.lit("-"))
    status = F.when(in_tab("answered"), ANSWERED).otherwise(UNANSWERED)
    return questions.select("id", "question", shown.alias("answer"), status.alias("status"))


def all_ids(questions: DataFrame) -> DataFrame:
    return questions.select("id")


def selected(questions: DataFrame, selection: DataFrame) -> DataFrame:
    return questions.join(selection, "id", "left_semi")


def toggle(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that are in one of the two sets but not in both."""
    return selection.join(ids, "id", "left_anti").unionByName(ids.join(selection, "id", "left_anti"))


def selection_state(questions: DataFrame, selection: DataFrame) -> DataFrame:
    """Whether all, some or none are selected, by the two counts alone."""
    counts = questions.select(F.lit(1).alias("listed"), F.lit(0).alias("chosen")).unionByName(selection.select(F.lit(0).alias("listed"), F.lit(1).alias("chosen")))
    n = counts.agg(F.coalesce(F.sum("listed"), F.lit(0)).cast("bigint").alias("n_filtered"), F.coalesce(F.sum("chosen"), F.lit(0)).cast("bigint").alias("n_selected"))
    return n.withColumn("all_selected", (F.col("n_filtered") > 0) & (F.col("n_selected") == F.col("n_filtered"))).withColumn("some_selected", (F.col("n_selected") > 0) & (F.col("n_selected") < F.col("n_filtered")))


def update_one(questions: DataFrame, id_: int, question: str | None, answer: str | None) -> DataFrame:
    """The table with one row as a form writes it: both fields cleaned, and the flag from the cleaned answer."""
    here = F.col("id") == id_
    q, a = clean_text(F.lit(question).cast("string")), clean_text(F.lit(answer).cast("string"))
    new = {"question": q, "answer": a, "has_answer": a != ""}
    return questions.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()})


def page_size(chosen: Column, allowed: tuple[int, ...] = (5, 10, 25), default: int = 10) -> Column:
    """The number of rows of a page that a text begins with, if it is allowed, else the default."""
    size = leading_int(chosen)
    return F.when(size.isin(*allowed), size).otherwise(F.lit(default))


def delete_one(questions: DataFrame, id_: int) -> DataFrame:
    return questions.filter(F.col("id") != id_)


def deselect(selection: DataFrame, id_: int) -> DataFrame:
    """The selection after a row has been deleted."""
    return selection.filter(F.col("id") != id_)


def delete_many(questions: DataFrame, selection: DataFrame) -> DataFrame:
    """Without the selected rows; an empty selection deletes nothing."""
    return questions.join(selection, "id", "left_anti")


def written(questions: DataFrame) -> DataFrame:
    """What a form writes: both fields cleaned, and the flag from the cleaned answer."""
    return questions.select("id", clean_text(F.col("question")).alias("question"), clean_text(F.col("answer")).alias("answer"), (clean_text(F.col("answer")) != "").alias("has_answer"))


def valid(questions: DataFrame) -> DataFrame:
    """Rows that a form accepts: a question is there, though it may be of white space only."""
    return questions.filter(F.col("question").isNotNull() & (F.col("question") != ""))


def export_unanswered(questions: DataFrame) -> DataFrame:
    """The sheet of unanswered questions: number, question and answer."""
    rows = with_ordinal(tab(questions, "unanswered"), "id", "STT")
    return rows.select("STT", F.coalesce("question", F.lit("")).alias("Nội dung câu hỏi"), F.coalesce("answer", F.lit("")).alias("Trả lời"))
