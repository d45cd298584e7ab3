"""The knowledge base's queries over the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import TRIMMED, clean_text, compact, initial, number, usd
from ..operators import chat, documents, importer, navigation, questions, selection, similar, utilities, variants
from ..operators.grams import GramIndex
from ..sources import xlsx
from ..sources.ranges import RangeTable
from ..sources.shared import shared_folder
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
NEEDLE, ONE, PATH = "THE", 300, "/admin/questions/import"


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(FOUND)


@query
def questions_view(spark, d):
    return fx.questions(spark, d)


@query
def clean_texts(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", clean_text(F.concat(F.lit("  "), "text", F.lit(" \n\n\t "))).alias("cleaned"))


@query
def question_search(spark, d):
    return questions.search(fx.questions(spark, d), NEEDLE)


@query
def question_search_indexed(spark, d):
    table = RangeTable.create(fx.questions(spark, d), shared_folder(spark, "questions"), 5000)
    return GramIndex.create(table, shared_folder(spark, "grams")).search(NEEDLE)


@query
def question_tab_answered(spark, d):
    return questions.tab(fx.questions(spark, d), "answered")


@query
def question_tab_unanswered(spark, d):
    return questions.tab(fx.questions(spark, d), "unanswered")


@query
def question_list_filtered(spark, d):
    return questions.filtered(fx.questions(spark, d), NEEDLE, "answered")


@query
def question_list_page(spark, d):
    return questions.page(questions.filtered(fx.questions(spark, d), NEEDLE, "answered"), 1, 10)


@query
def question_deep_page(spark, d):
    table = RangeTable.create(fx.questions(spark, d), shared_folder(spark, "questions"), 1000)
    return table.pages(questions.matches_search(NEEDLE) & questions.in_tab("answered")).page(7, 25)


@query
def question_filtered_count(spark, d):
    return questions.filtered_count(questions.filtered(fx.questions(spark, d), NEEDLE, "answered"))


@query
def point_lookup(spark, d):
    return questions.lookup(fx.questions(spark, d), ONE)


@query
def question_display(spark, d):
    return questions.display(fx.questions(spark, d))


@query
def select_all_ids(spark, d):
    return questions.all_ids(questions.filtered(fx.questions(spark, d), NEEDLE, "all"))


@query
def selected_rows(spark, d):
    return questions.selected(fx.questions(spark, d), fx.selection(spark, d))


@query
def toggle_selection(spark, d):
    return questions.toggle(fx.selection(spark, d), fx.questions(spark, d).filter("id % 5 = 0").select("id"))


@query
def selection_state(spark, d):
    return questions.selection_state(questions.tab(fx.questions(spark, d), "answered"), fx.selection(spark, d))


@query
def delete_one(spark, d):
    return questions.delete_one(fx.questions(spark, d), ONE)


@query
def delete_many(spark, d):
    return questions.delete_many(fx.questions(spark, d), fx.selection(spark, d))


@query
def question_write(spark, d):
    return questions.written(fx.questions(spark, d))


@query
def valid_questions(spark, d):
    return questions.valid(importer.rows_of(fx.sheet(spark, d)))


@query
def export_unanswered(spark, d):
    return questions.export_unanswered(fx.questions(spark, d))


@query
def import_rows(spark, d):
    return importer.rows_of(fx.sheet(spark, d))


@query
def import_check(spark, d):
    return importer.check(fx.candidates(spark, d), fx.existing(spark, d)).select("input_pos", "is_duplicate", F.coalesce("existing_id", F.lit(-1)).alias("existing_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


@query
def import_check_indexed(spark, d):
    index = similar.PrefixIndex.create(fx.existing(spark, d), shared_folder(spark, "index"))
    return index.check(fx.candidates(spark, d)).select("input_pos", "is_duplicate", F.coalesce("existing_id", F.lit(-1)).alias("existing_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


@query
def import_new(spark, d):
    return importer.new_rows(fx.checked(spark, d)).select("input_pos", "question")


@query
def import_duplicate(spark, d):
    return importer.duplicate_rows(fx.checked(spark, d)).select("input_pos", "question")


@query
def import_counts(spark, d):
    return importer.counts(fx.checked(spark, d))


@query
def import_merged(spark, d):
    c = fx.checked(spark, d).select("input_pos", "question", "is_duplicate")
    return importer.merged(importer.new_rows(c), importer.duplicate_rows(c)).drop("is_duplicate")


@query
def duplicate_report(spark, d):
    return importer.duplicate_report(fx.checked(spark, d))


@query
def import_save_new(spark, d):
    return importer.save_new(importer.rows_of(fx.sheet(spark, d)))


@query
def inline_edit(spark, d):
    return importer.inline_edit(importer.rows_of(fx.sheet(spark, d)), ONE, "  ")


@query
def import_headings(spark, d):
    return importer.headings(importer.rows_of(fx.sheet(spark, d)))


@query
def selection_after_delete(spark, d):
    return questions.deselect(fx.selection(spark, d), 700)


@query
def remove_row(spark, d):
    return importer.remove_at(importer.rows_of(fx.sheet(spark, d)), ONE)


@query
def reconcile_overwrite(spark, d):
    return importer.overwrites(fx.checked(spark, d)).drop("input_pos")


@query
def reconcile_create(spark, d):
    return importer.creates(fx.checked(spark, d)).drop("input_pos")


@query
def reconcile_apply(spark, d):
    return importer.reconcile(fx.questions(spark, d), fx.checked(spark, d))


@query
def document_cards(spark, d):
    return documents.cards(fx.documents(spark, d))


@query
def document_api_path(spark, d):
    return documents.api_path(fx.documents(spark, d))


@query
def document_pending(spark, d):
    return documents.pending(fx.documents(spark, d)).select("id", "title", "file_path")


@query
def document_embed_requests(spark, d):
    return documents.embed_requests(fx.documents(spark, d))


@query
def document_chunks(spark, d):
    return documents.chunks(fx.documents(spark, d))


@query
def page_sequence(spark, d):
    return documents.page_numbers(fx.documents(spark, d).select("id", (F.col("id") % 9).alias("n_pages")))


@query
def chat_history_payload(spark, d):
    rows = chat.history_payload(fx.messages(spark, d))
    return rows.select("conv_id", "turn", "question", F.size("messages").cast("bigint").alias("n_before"), chat.as_text().alias("history"))


@query
def chat_append(spark, d):
    sent = fx.messages(spark, d).select("conv_id").distinct().select("conv_id", F.lit(1000).cast("bigint").alias("turn"), F.lit(" hello \n\n").alias("sent"), F.when(F.col("conv_id") % 2 == 0, F.lit("yes")).alias("reply"))
    return chat.append(fx.messages(spark, d), sent).select("conv_id", F.size("messages").cast("bigint").alias("n"), chat.as_text().alias("turns"))


@query
def nav_flatten(spark, d):
    return navigation.flatten(spark, navigation.menu(spark))


@query
def nav_active(spark, d):
    return navigation.active(spark, navigation.menu(spark), PATH)


@query
def breadcrumbs(spark, d):
    return navigation.breadcrumbs(fx.paths(spark, d))


@query
def paginate_util(spark, d):
    return questions.paginate(fx.table(spark, d, "customer").select("c_custkey", "c_name"), 3, 6, "c_custkey")


@query
def currency_format(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", usd(F.col("o_totalprice")).alias("price"))


@query
def currency_compact(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", compact(F.col("o_totalprice")).alias("price"))


@query
def merge_props(spark, d):
    props = F.from_json("props", "map<string,string>")
    merged = utilities.merge(props, F.create_map(F.lit("kind"), F.col("event_type")))
    return fx.table(spark, d, "events").select("event_id", F.element_at(merged, "kind").alias("kind"), (F.size(merged) - F.size(F.coalesce(props, F.create_map().cast("map<string,string>")))).cast("bigint").alias("added"))


@query
def equal_rows(spark, d):
    q = fx.questions(spark, d)
    cleaned = F.struct(clean_text(F.col("question")).alias("q"), F.col("answer").alias("a"))
    return q.select("id", utilities.equal(F.struct(F.col("question").alias("q"), F.col("answer").alias("a")), cleaned).alias("same"))


@query
def currency_ties(spark, d):
    eighth, sixteenth = F.col("o_orderkey") / 8, F.col("o_orderkey") / 16
    return fx.table(spark, d, "orders").select("o_orderkey", usd(eighth).alias("price"), usd(-eighth).alias("owed"), number(sixteenth).alias("plain"))


@query
def merge_nested(spark, d):
    part = fx.table(spark, d, "part").select("p_partkey", F.struct("p_size", F.struct("p_name", "p_brand").alias("o")).alias("t"), F.struct(F.struct(F.col("p_type").alias("p_brand"), "p_retailprice").alias("o")).alias("s"))
    merged = part.select("p_partkey", utilities.merge_structs(F.col("t"), part.schema["t"].dataType, F.col("s"), part.schema["s"].dataType).alias("m"))
    return merged.select("p_partkey", "m.p_size", "m.o.p_name", "m.o.p_brand", "m.o.p_retailprice")


@query
def question_update(spark, d):
    return questions.update_one(fx.questions(spark, d), ONE, "  new \n\n text ", " ")


@query
def page_sizes(spark, d):
    chosen = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" rows")).otherwise(F.lit("")))
    return fx.table(spark, d, "part").select("p_partkey", questions.page_size(chosen).alias("size"))


@query
def initials(spark, d):
    return fx.table(spark, d, "supplier").select("s_suppkey", initial(F.lower("s_name")).alias("initial"))


@query
def bulk_append(spark, d):
    return importer.append_new(fx.questions(spark, d), importer.rows_of(fx.sheet(spark, d)))


@query
def question_insert(spark, d):
    return importer.add_questions(fx.questions(spark, d), fx.sent(spark, d)).select("input_pos", "status", F.coalesce("id", F.lit(-1)).alias("id"), "question", "answer", "has_answer", F.coalesce("existing_id", F.lit(-1)).alias("existing_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _stored(spark: SparkSession, d: str) -> RangeTable:
    return RangeTable.create(fx.questions(spark, d), shared_folder(spark, "questions"))


@query
def store_reconcile(spark, d):
    table = _stored(spark, d)
    table.apply(importer.reconciled(table.read(), fx.checked(spark, d)))
    return table.read()


@query
def store_append(spark, d):
    table = _stored(spark, d)
    table.apply(importer.appended(table.read(), importer.rows_of(fx.sheet(spark, d))))
    return table.read()


@query
def store_update(spark, d):
    table = _stored(spark, d)
    table.apply(questions.update_one(table.lookup(ONE), ONE, "  new \n\n text ", " "))
    return table.read()


@query
def store_delete(spark, d):
    table = _stored(spark, d)
    table.apply(gone=fx.selection(spark, d))
    return table.read()


@query
def document_upload(spark, d):
    return documents.upload(fx.documents(spark, d), fx.files(spark, d))


@query
def document_delete(spark, d):
    return documents.delete(fx.documents(spark, d).drop("text"), 10)


@query
def document_embedded(spark, d):
    return documents.embedded(fx.documents(spark, d), fx.documents(spark, d).filter("id % 4 = 0")).select("id", "is_embed")


@query
def chat_answered(spark, d):
    conversations = fx.messages(spark, d).select("conv_id").distinct()
    sent = conversations.select("conv_id", F.lit(1000).cast("bigint").alias("turn"), F.lit("hello").alias("sent"))
    replies = conversations.filter("conv_id % 3 <> 0").select("conv_id", F.lit(1000).cast("bigint").alias("turn"), F.lit(1).alias("at"), F.when(F.col("conv_id") % 3 == 1, F.lit("yes")).alias("reply"))
    rows = chat.append(fx.messages(spark, d), chat.answer(sent, replies))
    return rows.select("conv_id", F.size("messages").cast("bigint").alias("n"), chat.as_text().alias("turns"))


@query
def chat_turns(spark, d):
    rows = chat.append(fx.messages(spark, d), chat.answer(fx.sends(spark, d), fx.replies(spark, d)))
    return rows.select("conv_id", F.size("messages").cast("bigint").alias("n"), chat.as_text().alias("turns"))


@query
def merge_nulls(spark, d):
    k = F.col("p_partkey")
    target = F.struct("p_size", F.when(k % 2 != 0, F.struct("p_name", "p_brand")).alias("o")).alias("t")
    source = F.when(k % 5 != 0, F.struct(F.when(k % 3 != 0, F.struct(F.col("p_type").alias("p_brand"), "p_retailprice")).alias("o"))).alias("s")
    part = fx.table(spark, d, "part").select("p_partkey", target, source)
    merged = part.select("p_partkey", utilities.merge_structs(F.col("t"), part.schema["t"].dataType, F.col("s"), part.schema["s"].dataType).alias("m"))
    return merged.select("p_partkey", "m.p_size", F.col("m.o").isNull().alias("none"), "m.o.p_name", "m.o.p_brand", "m.o.p_retailprice")


@query
def shuffle_rows(spark, d):
    return utilities.shuffle_rows(fx.table(spark, d, "customer").select("c_custkey", "c_name"), 42, "c_custkey")


@query
def object_ids(spark, d):
    return fx.table(spark, d, "nation").select("n_nationkey", utilities.object_id().alias("object_id"))


def _exported(spark: SparkSession, d: str) -> str:
    """A folder of exported workbooks, under the shared one."""
    folder = shared_folder(spark, "xlsx")
    xlsx.write_sheets(export_unanswered(spark, d), folder)
    return folder


@query
def xlsx_roundtrip(spark, d):
    rows = xlsx.read_sheets(spark, _exported(spark, d)).filter("row_idx > 0")
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.select(cell(0).cast("bigint").alias("stt"), F.coalesce(cell(1), F.lit("")).alias("question"), F.coalesce(cell(2), F.lit("")).alias("answer"))


@query
def file_size_kb(spark, d):
    return documents.size_label(xlsx.file_sizes(spark, _exported(spark, d))).select("size_kb")


@query
def select_rows_bits(spark, d):
    return selection.chosen(fx.questions(spark, d), selection.of(fx.selection(spark, d)))


@query
def delete_many_bits(spark, d):
    return selection.others(fx.questions(spark, d), selection.of(fx.selection(spark, d)))


@query
def toggle_selection_bits(spark, d):
    other = fx.questions(spark, d).filter("id % 5 = 0").select("id")
    return selection.ids(selection.toggled(selection.of(fx.selection(spark, d)), selection.of(other)))


@query
def selection_state_bits(spark, d):
    return selection.state(questions.tab(fx.questions(spark, d), "answered"), selection.of(fx.selection(spark, d)))


@query
def upload_check(spark, d):
    folder = shared_folder(spark, "files")
    fx.write_files(spark, d, folder)
    number = F.regexp_extract("path", r"/number=(\d+)/", 1).cast("bigint").alias("number")
    return documents.checked_files(spark, folder, most=1000).select(number, "length", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("sha256", F.lit("")).alias("sha256"))


@query
def merge_variants(spark, d):
    merged = variants.merge(F.col("target"), F.col("first"), F.col("second"))
    return fx.patches(spark, d).select("event_id", F.to_json(merged).alias("merged"))


@query
def equal_variants(spark, d):
    """Properties against the same with another number form, a key more, a text for the number, or themselves."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 4
    other = F.when(kind == 0, F.concat(F.lit('{"k": '), k, F.lit(".0}"))).when(kind == 1, F.concat(F.lit('{"z": null, "k": '), k, F.lit("}")))
    other = other.when(kind == 2, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).otherwise(F.col("props"))
    return fx.patches(spark, d).select("event_id", variants.equal(F.col("target"), F.parse_json(other)).alias("same"))


# --- SQL -----------------------------------------------------------------------------------------------------------

_Q = """q AS (
  SELECT conv_id * 100 + turn AS id, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer,
         coalesce(nr = 'assistant', false) AS has_answer
  FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations)
  WHERE role = 'user')"""
_SHEET = """sheet AS (
  SELECT id AS row_idx,
         CASE id % 5 WHEN 1 THEN '  ' || question || chr(9) WHEN 2 THEN '' ELSE question END AS c1,
         CASE id % 5 WHEN 2 THEN NULL WHEN 3 THEN '  ' ELSE answer END AS c2 FROM q)"""


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{TRIMMED}+|{TRIMMED}+$', '', 'g')"


def _clean(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda s: {_trim('s')}), lambda s: s <> ''), chr(10))"


_ROWS = f"""rows_ AS (
  SELECT row_idx, {_trim("coalesce(c1, '')")} AS question, {_trim("coalesce(c2, '')")} AS answer, coalesce(c2, '') <> '' AS has_answer
  FROM sheet WHERE row_idx > 0 AND (coalesce(c1, '') <> '' OR coalesce(c2, '') <> ''))"""
_CHECKED = """checked AS (
  SELECT id AS input_pos, ' ' || question AS question, answer, has_answer,
         CASE WHEN id % 6 <> 0 THEN id % 3 <> 0 END AS is_duplicate, id - id % 3 AS existing_id,
         CASE WHEN id % 13 <> 0 THEN question END AS existing_doc,
         CASE WHEN id % 11 <> 0 THEN (id % 801) / 8.0::DOUBLE END AS score,
         CASE id % 4 WHEN 0 THEN 'overwrite' WHEN 1 THEN 'create_new' WHEN 2 THEN 'skip' END AS action
  FROM q)"""
_DOCS = """docs AS (
  SELECT d.doc_id AS id, source AS title, lang AS description, 'pdf' AS file_type,
         'storage/documents/' || d.doc_id || '.pdf' AS file_path,
         TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at, l.doc_id IS NOT NULL AS is_embed, text
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))"""
_MSG = "msg AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))"
_SEARCH = f"(contains(lower(coalesce(question, '')), lower('{NEEDLE}')) OR contains(lower(coalesce(answer, '')), lower('{NEEDLE}')))"
_SEL = "sel AS (SELECT id FROM q WHERE id % 7 = 0)"


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


_NAV = "nav(node_id, parent_id, ord, type, label, name, path) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in navigation.MENU) + ")"
_ANSWER = "coalesce(answer, '')"
_PAYLOAD = f"question, {_ANSWER} AS answer, {_trim(_ANSWER)} <> '' AS has_answer"
_PATHS = """paths AS (
  SELECT p_partkey AS path_id, CASE p_partkey % 5 WHEN 0 THEN '/admin/questions/edit/' WHEN 1 THEN '/admin//documents/'
         WHEN 2 THEN '/admin/questions/add/x%20y+' WHEN 3 THEN '/' ELSE '/admin/1e5/0x10/12abc/' END || p_partkey AS path FROM part)"""
_LABEL = " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in navigation.LABELS.items())
_UNIT = "CASE WHEN o_totalprice < 1000 THEN o_totalprice WHEN o_totalprice < 1e6 THEN o_totalprice / 1e3 WHEN o_totalprice < 1e9 THEN o_totalprice / 1e6 ELSE o_totalprice / 1e9 END"


_OTHER = "'zz' || replace(question, ' ', ' zz')"
_SENT = f"""sent AS (
  SELECT id AS input_pos, CASE id % 3 WHEN 0 THEN ' ' || question || chr(10) WHEN 1 THEN {_OTHER} ELSE question || ' more' END AS question, answer FROM q
  UNION ALL
  SELECT id + 1000000000, CASE id % 4 WHEN 0 THEN {_OTHER} || ' again and again' WHEN 1 THEN regexp_replace({_OTHER}, ' [^ ]*$', '') WHEN 3 THEN upper({_OTHER}) END, answer FROM q)"""


def _shuffled(rows: str, columns: str, seed: int) -> str:
    """The same network as `utilities.permuted`, a step of the walk for each level of the recursion."""
    mix = lambda x, r: f"(SELECT xor(y, y >> 15) * 668265263 % {utilities.PRIME} FROM (SELECT ({x} + {r * 7919 + seed}) % {utilities.PRIME} * 1103515245 % {utilities.PRIME} AS y))"
    step = "SELECT i, n, rows, cols, x // cols AS high, x % cols AS low FROM t"
    for r in range(1, utilities.ROUNDS + 1):
        step = f"SELECT i, n, rows, cols, high, (low + {mix('high', r)}) % cols AS low FROM ({step})"
        step = f"SELECT i, n, rows, cols, (high + {mix('low', r + utilities.ROUNDS)}) % rows AS high, low FROM ({step})"
    step = f"SELECT i, n, rows, cols, high * cols + low AS x FROM ({step})"
    return f"""WITH RECURSIVE own AS ({rows}),
        size AS (SELECT count(*) AS n, (floor(sqrt(count(*) - 1)) + 1)::BIGINT AS rows FROM own),
        begin_ AS (SELECT i, n, rows, (n + rows - 1) // rows AS cols, i AS x FROM own, size),
        walk AS ({step.replace("FROM t", "FROM begin_")} UNION ALL {step.replace("FROM t", "FROM (FROM walk WHERE x >= n)")})
        SELECT {columns}, x AS place FROM own JOIN walk USING (i) WHERE x < n"""


def oracle_sql() -> dict[str, str]:
    sql = _sql()
    stored = {"question_search_indexed": "question_search", "store_reconcile": "reconcile_apply", "store_append": "bulk_append", "store_update": "question_update", "store_delete": "delete_many"}
    stored |= {"select_rows_bits": "selected_rows", "delete_many_bits": "delete_many", "toggle_selection_bits": "toggle_selection", "selection_state_bits": "selection_state"}
    return sql | {"import_check_indexed": sql["import_check"]} | {k: sql[v] for k, v in stored.items()}


def _sql() -> dict[str, str]:
    w = lambda *ctes: "WITH " + ", ".join(ctes) + " "
    return {
        "questions_view": w(_Q) + "SELECT * FROM q",
        "clean_texts": f"SELECT conv_id, turn, {_clean('chr(160) || chr(32) || text || chr(32) || chr(10) || chr(10) || chr(9) || chr(32)')} AS cleaned FROM conversations",
        "question_search": w(_Q) + f"SELECT * FROM q WHERE {_SEARCH}",
        "question_tab_answered": w(_Q) + "SELECT * FROM q WHERE has_answer",
        "question_tab_unanswered": w(_Q) + "SELECT * FROM q WHERE NOT has_answer",
        "question_list_filtered": w(_Q) + f"SELECT * FROM q WHERE {_SEARCH} AND has_answer",
        "question_list_page": w(_Q) + f"SELECT *, row_number() OVER (ORDER BY id) + 10 AS stt FROM (SELECT * FROM q WHERE {_SEARCH} AND has_answer ORDER BY id LIMIT 10 OFFSET 10)",
        "question_deep_page": w(_Q) + f"SELECT *, row_number() OVER (ORDER BY id) + 175 AS stt FROM (SELECT * FROM q WHERE {_SEARCH} AND has_answer ORDER BY id LIMIT 25 OFFSET 175)",
        "question_filtered_count": w(_Q) + f"SELECT count(*) AS n FROM q WHERE {_SEARCH} AND has_answer",
        "point_lookup": w(_Q) + f"SELECT id, question, coalesce(answer, '') AS answer, has_answer FROM q WHERE id = {ONE}",
        "question_display": w(_Q) + "SELECT id, question, coalesce(nullif(answer, ''), '-') AS answer, CASE WHEN has_answer THEN 'Đã trả lời' ELSE 'Chưa trả lời' END AS status FROM q",
        "select_all_ids": w(_Q) + f"SELECT id FROM q WHERE {_SEARCH}",
        "selected_rows": w(_Q, _SEL) + "SELECT * FROM q WHERE id IN (SELECT id FROM sel)",
        "toggle_selection": w(_Q, _SEL, "other AS (SELECT id FROM q WHERE id % 5 = 0)") + "(SELECT id FROM sel EXCEPT SELECT id FROM other) UNION ALL (SELECT id FROM other EXCEPT SELECT id FROM sel)",
        "selection_state": w(_Q, _SEL, "n AS (SELECT (SELECT count(*) FROM q WHERE has_answer) AS n_filtered, (SELECT count(*) FROM sel) AS n_selected)") + "SELECT *, n_filtered > 0 AND n_selected = n_filtered AS all_selected, n_selected > 0 AND n_selected < n_filtered AS some_selected FROM n",
        "delete_one": w(_Q) + f"SELECT * FROM q WHERE id <> {ONE}",
        "delete_many": w(_Q, _SEL) + "SELECT * FROM q WHERE id NOT IN (SELECT id FROM sel)",
        "question_write": w(_Q) + f"SELECT id, {_clean('question')} AS question, {_clean('answer')} AS answer, {_clean('answer')} <> '' AS has_answer FROM q",
        "valid_questions": w(_Q, _SHEET, _ROWS) + "SELECT * FROM rows_ WHERE question <> ''",
        "export_unanswered": w(_Q) + "SELECT row_number() OVER (ORDER BY id) AS \"STT\", coalesce(question, '') AS \"Nội dung câu hỏi\", coalesce(answer, '') AS \"Trả lời\" FROM q WHERE NOT has_answer",
        "import_rows": w(_Q, _SHEET, _ROWS) + "SELECT * FROM rows_",
        "import_check": w(
            f"t AS (SELECT doc_id, lower({_clean('text')}) AS k FROM documents)",
            r"tok AS (SELECT doc_id, k, list_filter(list_distinct(string_split_regex(k, '[\x20\x09-\x0D]+')), lambda s: s <> '') AS ws FROM t)",
            "known AS (SELECT k, min(doc_id) AS existing_id, any_value(ws) AS ws FROM tok WHERE doc_id % 2 = 0 GROUP BY k)",
            "own AS (SELECT k, any_value(ws) AS ws FROM tok WHERE doc_id % 2 = 1 GROUP BY k)",
            "a AS (SELECT k, unnest(ws) AS word FROM own)",
            "b AS (SELECT existing_id, unnest(ws) AS word FROM known)",
            "shared AS (SELECT a.k, existing_id, count(*) AS n FROM a JOIN b USING (word) GROUP BY ALL)",
            "scored AS (SELECT s.k, s.existing_id, n * 100.0::DOUBLE / (len(o.ws) + len(e.ws) - n) AS score FROM shared s JOIN own o USING (k) JOIN known e USING (existing_id) UNION ALL SELECT o.k, e.existing_id, 100.0 FROM own o JOIN known e USING (k))",
            "best AS (SELECT k, existing_id, score FROM scored WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, existing_id) = 1)",
        )
        + "SELECT doc_id AS input_pos, score IS NOT NULL AS is_duplicate, coalesce(existing_id, -1) AS existing_id, coalesce(round(score, 6), 0.0)::DOUBLE AS score FROM t LEFT JOIN best USING (k) WHERE doc_id % 2 = 1",
        "import_new": w(_Q, _CHECKED) + "SELECT input_pos, question FROM checked WHERE NOT coalesce(is_duplicate, false)",
        "import_duplicate": w(_Q, _CHECKED) + "SELECT input_pos, question FROM checked WHERE is_duplicate",
        "import_counts": w(_Q, _CHECKED) + "SELECT count(*) FILTER (NOT coalesce(is_duplicate, false)) AS n_new, count(*) FILTER (is_duplicate) AS n_duplicate FROM checked",
        "import_merged": w(_Q, _CHECKED) + "SELECT input_pos, question FROM checked",
        "duplicate_report": w(_Q, _CHECKED)
        + """SELECT input_pos, coalesce(existing_doc, '—') AS existing,
             coalesce(CASE WHEN score * 8 = floor(score * 8) AND score * 8 % 2 = 1 THEN printf('%.2f', score + 0.001) ELSE printf('%.2f', score) END, '0') || '%' AS label,
             CASE WHEN score >= 90 THEN 'success' WHEN score >= 70 THEN 'warning' ELSE 'default' END AS band FROM checked""",
        "import_save_new": w(_Q, _SHEET, _ROWS) + f"SELECT row_idx, {_clean('question')} AS question, {_clean('answer')} AS answer, has_answer FROM rows_",
        "inline_edit": w(_Q, _SHEET, _ROWS) + f"SELECT row_idx, question, CASE WHEN row_idx = {ONE} THEN '  ' ELSE answer END AS answer, CASE WHEN row_idx = {ONE} THEN false ELSE has_answer END AS has_answer FROM rows_",
        "import_headings": w(_Q, _SHEET, _ROWS) + f"SELECT row_idx, CASE WHEN question = '' THEN {_literal(importer.NO_QUESTION)} ELSE question END AS heading FROM rows_",
        "selection_after_delete": w(_Q, _SEL) + "SELECT id FROM sel WHERE id <> 700",
        "remove_row": w(_Q, _SHEET, _ROWS) + f"SELECT * FROM rows_ WHERE row_idx <> {ONE}",
        "reconcile_overwrite": w(_Q, _CHECKED) + f"SELECT existing_id AS id, {_PAYLOAD} FROM checked WHERE action = 'overwrite'",
        "reconcile_create": w(_Q, _CHECKED) + f"SELECT {_PAYLOAD} FROM checked WHERE action = 'create_new'",
        "reconcile_apply": w(_Q, _CHECKED, f"o AS (SELECT existing_id AS id, {_PAYLOAD} FROM checked WHERE action = 'overwrite' QUALIFY row_number() OVER (PARTITION BY existing_id ORDER BY input_pos DESC) = 1)")
        + f"SELECT * FROM q WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT * FROM o UNION ALL SELECT input_pos + 1 + (SELECT max(id) FROM q) AS id, {_PAYLOAD} FROM checked WHERE action = 'create_new'",
        "document_cards": w(_DOCS) + "SELECT id, title, description, upper(file_type) || ' - ' || strftime(created_at, '%d/%m/%Y %H:%M:%S') AS caption, CASE WHEN is_embed THEN 'Đã xử lý dữ liệu' ELSE 'Chưa xử lý dữ liệu' END AS status FROM docs",
        "document_api_path": w(_DOCS) + "SELECT id, regexp_replace(file_path, 'storage/', '') AS api_path FROM docs",
        "document_pending": w(_DOCS) + "SELECT id, title, file_path FROM docs WHERE NOT is_embed",
        "document_embed_requests": w(_DOCS) + "SELECT regexp_replace(file_path, 'storage/', '') AS file_path, 1000 AS chunk_size, 200 AS chunk_overlap FROM docs WHERE NOT is_embed",
        "document_chunks": w(_DOCS) + "SELECT id, (s // 800)::BIGINT AS chunk, substr(text, s + 1, 1000) AS piece FROM (SELECT id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 800)) AS s FROM docs)",
        "page_sequence": w(_DOCS) + "SELECT id, unnest(range(1, id % 9 + 1)) AS page FROM docs",
        "chat_history_payload": w(_MSG)
        + f"""SELECT conv_id, turn, {_clean('text')} AS question, n_before, coalesce(history, '') AS history FROM (
              SELECT *, count(*) OVER p AS n_before, string_agg(role || ': ' || text, chr(10)) OVER p AS history FROM msg
              WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
              WHERE role = 'user' AND {_clean('text')} <> ''""",
        "chat_append": w(_MSG) + f"SELECT conv_id, count(*) + 2 AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'user: hello' || chr(10) || 'assistant: ' || CASE WHEN conv_id % 2 = 0 THEN 'yes' ELSE {_literal(chat.PENDING)} END AS turns FROM msg GROUP BY conv_id",
        "nav_flatten": "WITH RECURSIVE "
        + _NAV
        + """, tree AS (SELECT node_id, coalesce(label, name) AS title, type, path, 0 AS depth, lpad(ord::VARCHAR, 4, '0') AS place FROM nav WHERE parent_id IS NULL
             UNION ALL SELECT n.node_id, coalesce(n.label, n.name), n.type, n.path, t.depth + 1, t.place || '.' || lpad(n.ord::VARCHAR, 4, '0') FROM tree t JOIN nav n ON n.parent_id = t.node_id)
             SELECT node_id, title, depth, place, path, CASE WHEN type = 'label' THEN 'label' WHEN path IS NULL THEN 'branch' ELSE 'leaf' END AS kind FROM tree""",
        "nav_active": "WITH RECURSIVE " + _NAV + f", up AS (SELECT node_id, parent_id, path FROM nav UNION ALL SELECT p.node_id, p.parent_id, u.path FROM up u JOIN nav p ON u.parent_id = p.node_id) SELECT node_id, bool_or(coalesce(path = {_literal(PATH)}, false)) AS active FROM up GROUP BY node_id",
        "breadcrumbs": w(_PATHS, "s AS (SELECT path_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM paths)", "c AS (SELECT path_id, parts, unnest(range(0, len(parts))) AS place FROM s)", "e AS (SELECT *, parts[place + 1] AS segment FROM c)")
        + rf"""SELECT path_id, place, '/' || array_to_string(parts[1:place + 1], '/') AS link_to,
               CASE segment {_LABEL} ELSE replace(segment, '%20', ' ') END AS label, place <> len(parts) - 1 AND segment <> 'edit' AS clickable
               FROM e WHERE NOT regexp_matches(segment, '^[+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$|^0[xX][0-9a-fA-F]+$')""",
        "paginate_util": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 6 OFFSET 12",
        "currency_format": r"SELECT o_orderkey, '$' || regexp_replace(format('{:,.2f}', o_totalprice), '\.?0+$', '') AS price FROM orders",
        "currency_compact": rf"""SELECT o_orderkey, CASE WHEN o_totalprice < 1 THEN o_totalprice::VARCHAR ELSE
               '$' || CASE WHEN u < 9.95 THEN regexp_replace(format('{{:.1f}}', round(u, 1)), '\.0$', '') ELSE format('{{:d}}', round(u)::BIGINT) END
               || CASE WHEN o_totalprice < 1000 THEN '' WHEN o_totalprice < 1e6 THEN 'K' WHEN o_totalprice < 1e9 THEN 'M' ELSE 'B' END END AS price
               FROM (SELECT *, {_UNIT} AS u FROM orders)""",
        "upload_check": """WITH f AS (SELECT s_suppkey AS number, s_suppkey % 4 AS kind, CASE s_suppkey % 4 WHEN 1 THEN '<html> ' ELSE '%PDF-1.7 ' END
               || CASE s_suppkey % 4 WHEN 3 THEN repeat(s_name, 100) ELSE s_name END || chr(10) AS line FROM supplier)
               SELECT number, strlen(line) AS length, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'content' WHEN 2 THEN 'kind' ELSE 'length' END AS reason,
               CASE WHEN kind < 2 THEN sha256(line) ELSE '' END AS sha256 FROM f""",
        "merge_variants": """WITH e AS (SELECT event_id, event_type, event_id % 4 AS kind, event_id % 3 = 0 AS more, json_extract(props, '$.k')::VARCHAR AS k FROM events)
               SELECT event_id, '{"k":' || CASE kind WHEN 0 THEN '{"deep":{"id":' || event_id || ',"n":1.5}}' WHEN 1 THEN 'null' ELSE k END
               || CASE WHEN kind = 1 AND NOT more THEN ',"o":[1,{"a":2}]' WHEN kind = 3 THEN ',"o":{"kind":"' || event_type || '"' || CASE WHEN more THEN ',"more":{"x":true}' ELSE '' END || '}'
                  WHEN more THEN ',"o":{"more":{"x":true}}' ELSE '' END || '}' AS merged FROM e""",
        "equal_variants": "SELECT event_id, event_id % 4 IN (0, 3) AS same FROM events",
        "merge_props": "SELECT event_id, event_type AS kind, CASE WHEN json_exists(props, '$.kind') THEN 0 ELSE 1 END::BIGINT AS added FROM events",
        "equal_rows": w(_Q) + f"SELECT id, question IS NOT DISTINCT FROM {_clean('question')} AS same FROM q",
        "currency_ties": r"""WITH x AS (SELECT o_orderkey, (o_orderkey * 100 + 4) // 8 AS cents, (o_orderkey * 1000 + 8) // 16 AS mills FROM orders),
               y AS (SELECT o_orderkey, format('{:,}', cents // 100) || CASE WHEN cents % 100 = 0 THEN '' WHEN cents % 10 = 0 THEN '.' || (cents % 100 // 10) ELSE '.' || lpad((cents % 100)::VARCHAR, 2, '0') END AS p,
                      format('{:,}', mills // 1000) || CASE WHEN mills % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad((mills % 1000)::VARCHAR, 3, '0'), '0') END AS plain FROM x)
               SELECT o_orderkey, '$' || p AS price, CASE WHEN o_orderkey = 0 THEN '$' ELSE '-$' END || p AS owed, plain FROM y""",
        "merge_nested": "SELECT p_partkey, p_size, p_name, p_type AS p_brand, p_retailprice FROM part",
        "question_update": w(_Q) + f"SELECT id, CASE WHEN id = {ONE} THEN 'new' || chr(10) || 'text' ELSE question END AS question, CASE WHEN id = {ONE} THEN '' ELSE answer END AS answer, has_answer AND id <> {ONE} AS has_answer FROM q",
        "page_sizes": "SELECT p_partkey, CASE WHEN p_size IN (5, 10, 25) THEN p_size ELSE 10 END AS size FROM part",
        "initials": "SELECT s_suppkey, upper(left(s_name, 1)) AS initial FROM supplier",
        "bulk_append": w(_Q, _SHEET, _ROWS) + f"SELECT * FROM q UNION ALL SELECT row_idx + 1 + (SELECT max(id) FROM q) AS id, {_clean('question')} AS question, {_clean('answer')} AS answer, has_answer FROM rows_",
        "question_insert": "WITH RECURSIVE "
        + ", ".join(
            (
                _Q,
                _SENT,
                f"form AS (SELECT row_number() OVER (ORDER BY input_pos) AS k, input_pos, {_clean('question')} AS question, {_clean('answer')} AS answer FROM sent WHERE question <> '')",
                r"words AS (SELECT k, lower(question) AS text, list_filter(list_distinct(string_split_regex(lower(question), '[\x20\x09-\x0D]+')), lambda s: s <> '') AS ws FROM form)",
                rf"known AS (SELECT id, text, list_filter(list_distinct(string_split_regex(text, '[\x20\x09-\x0D]+')), lambda s: s <> '') AS ws FROM (SELECT id, lower({_clean('question')}) AS text FROM q))",
                "pieces AS (SELECT k, text, len(ws) AS n, unnest(ws) AS word FROM words)",
                "old AS (SELECT id, text, len(ws) AS n, unnest(ws) AS word FROM known)",
                # scores against the table, and of each two sent ones, from 70 on
                """hits AS (
                  SELECT k, id, max(score) AS score FROM (
                    SELECT k, id, count(*) * 100.0::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS score FROM pieces a JOIN old b USING (word) GROUP BY k, id
                    UNION ALL SELECT k, id, 100.0 FROM words JOIN known USING (text)) WHERE score >= 70 GROUP BY ALL)""",
                """near AS (
                  SELECT k, o, max(score) AS score FROM (
                    SELECT a.k, b.k AS o, count(*) * 100.0::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS score FROM pieces a JOIN pieces b ON a.word = b.word AND a.k > b.k GROUP BY ALL
                    UNION ALL SELECT a.k, b.k, 100.0 FROM words a JOIN words b ON a.text = b.text AND a.k > b.k) WHERE score >= 70 GROUP BY ALL)""",
                "before AS (SELECT k, exists(FROM hits h WHERE h.k = f.k) AS taken, coalesce((SELECT list(o) FROM near n WHERE n.k = f.k), []) AS others FROM form f)",
                # one after the other: who has been put in so far
                "steps AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS done UNION ALL SELECT b.k, CASE WHEN taken OR list_has_any(others, done) THEN done ELSE list_append(done, b.k) END FROM steps s JOIN before b ON b.k = s.k + 1)",
                "put_in AS (SELECT unnest(done) AS k FROM (SELECT done FROM steps ORDER BY k DESC LIMIT 1))",
                "top AS (SELECT max(id) AS top FROM q)",
                """offers AS (
                  SELECT k, id, score FROM hits
                  UNION ALL SELECT n.k, top + 1 + f.input_pos, score FROM near n JOIN put_in p ON p.k = n.o JOIN form f ON f.k = n.o, top)""",
                "best AS (SELECT k, id, score FROM offers QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, id) = 1)",
            )
        )
        + """ SELECT input_pos, CASE WHEN p.k IS NULL THEN 409 ELSE 201 END AS status, CASE WHEN p.k IS NULL THEN -1 ELSE top + 1 + input_pos END AS id, question, answer, answer <> '' AS has_answer,
              coalesce(b.id, -1) AS existing_id, coalesce(round(b.score, 6), 0.0)::DOUBLE AS score FROM form f LEFT JOIN put_in p ON p.k = f.k LEFT JOIN best b ON b.k = f.k, top""",
        "document_upload": w(_DOCS) + "SELECT id, title, description, file_type, file_path, created_at, is_embed FROM docs UNION ALL SELECT (SELECT max(id) FROM docs) + p_partkey, p_name, p_type, 'pdf', 'storage/documents/' || p_partkey || '.pdf', TIMESTAMP '2024-06-01', false FROM part WHERE p_partkey % 4 NOT IN (0, 1)",
        "document_delete": w(_DOCS) + "SELECT id, title, description, file_type, file_path, created_at, is_embed FROM docs WHERE id <> 10",
        "document_embedded": w(_DOCS) + "SELECT id, is_embed OR id % 4 = 0 AS is_embed FROM docs",
        "chat_answered": w(_MSG) + f"SELECT conv_id, count(*) + 2 AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'user: hello' || chr(10) || 'assistant: ' || CASE conv_id % 3 WHEN 0 THEN {_literal(chat.PENDING)} WHEN 1 THEN 'yes' ELSE {_literal(chat.NO_ANSWER)} END AS turns FROM msg GROUP BY conv_id",
        "chat_turns": w(
            _MSG,
            "c AS (SELECT DISTINCT conv_id FROM msg)",
            "b AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN 'to the first' WHEN conv_id % 2 = 0 THEN 'better' ELSE '' END AS r1, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'to the second' END AS r2 FROM c)",
            f"a AS (SELECT conv_id, coalesce(CASE WHEN r1 = '' THEN {_literal(chat.NO_ANSWER)} ELSE r1 END, {_literal(chat.PENDING)}) AS r1, CASE WHEN r2 = '' THEN {_literal(chat.NO_ANSWER)} ELSE r2 END AS r2 FROM b)",
            "h AS (SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS turns FROM msg GROUP BY conv_id)",
        )
        + "SELECT conv_id, n + CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 4 END AS n, turns || chr(10) || 'user: first' || chr(10) || 'assistant: ' || r1 || CASE WHEN conv_id % 5 = 0 THEN '' ELSE chr(10) || 'user: second' || chr(10) || 'assistant: ' || r2 END AS turns FROM h JOIN a USING (conv_id)",
        "merge_nulls": """WITH x AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 2 = 0 ELSE p_partkey % 3 = 0 END AS none FROM part)
               SELECT p_partkey, p_size, none, CASE WHEN NOT none AND p_partkey % 2 <> 0 THEN p_name END AS p_name,
                      CASE WHEN none THEN NULL WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END AS p_brand,
                      CASE WHEN NOT none AND p_partkey % 5 <> 0 THEN p_retailprice END AS p_retailprice FROM x""",
        "shuffle_rows": _shuffled("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer", "c_custkey, c_name", 42),
        "xlsx_roundtrip": w(_Q) + "SELECT row_number() OVER (ORDER BY id) AS stt, coalesce(question, '') AS question, coalesce(answer, '') AS answer FROM q WHERE NOT has_answer",
    }
