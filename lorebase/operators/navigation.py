"""The menu tree and breadcrumb paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import is_numeric, percent_decoded

NAV_SCHEMA = "node_id int, parent_id int, ord int, type string, label string, name string, path string"
#: The menu of the admin console.
MENU = [
    (1, None, 1, "label", "Dashboard", None, None),
    (2, None, 2, None, None, "Trang điều khiển", "/admin"),
    (3, None, 3, "label", "Dữ liệu", None, None),
    (4, None, 4, None, None, "Câu hỏi thường gặp", None),
    (5, 4, 1, None, None, "Danh sách câu hỏi", "/admin/questions/"),
    (6, 4, 2, None, None, "Thêm mới dữ liệu", "/admin/questions/add"),
    (7, 4, 3, None, None, "Import dữ liệu", "/admin/questions/import"),
    (8, None, 5, None, None, "Tài liệu quy chế, quy định", None),
    (9, 8, 1, None, None, "Danh sách tài liệu", "/admin/documents/"),
]
#: Labels of path segments; the first one shows an icon, named here.
LABELS = {"admin": "home", "add": "Thêm câu hỏi", "edit": "Chỉnh sửa câu hỏi", "questions": "Danh sách câu hỏi", "documents": "Danh sách tài liệu"}


def menu(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MENU, NAV_SCHEMA)


def flatten(spark: SparkSession, nav: DataFrame) -> DataFrame:
    """The tree in display order: depth, kind, and a sort key of the places on the way down."""
    return spark.sql(
        """
        WITH RECURSIVE tree AS (
          SELECT node_id, coalesce(label, name) AS title, type, path, 0 AS depth, lpad(CAST(ord AS STRING), 4, '0') AS place
          FROM {nav} WHERE parent_id IS NULL
          UNION ALL
          SELECT n.node_id, coalesce(n.label, n.name), n.type, n.path, t.depth + 1, t.place || '.' || lpad(CAST(n.ord AS STRING), 4, '0')
          FROM tree t JOIN {nav} n ON n.parent_id = t.node_id)
        SELECT node_id, title, depth, place, path,
               CASE WHEN type = 'label' THEN 'label' WHEN path IS NULL THEN 'branch' ELSE 'leaf' END AS kind
        FROM tree""",
        nav=nav,
    )


def active(spark: SparkSession, nav: DataFrame, path: str) -> DataFrame:
    """For each node whether it, or a node below it, has the path."""
    return spark.sql(
        """
        WITH RECURSIVE up AS (
          SELECT node_id, parent_id, path FROM {nav}
          UNION ALL
          SELECT p.node_id, p.parent_id, u.path FROM up u JOIN {nav} p ON u.parent_id = p.node_id)
        SELECT node_id, bool_or(coalesce(path = {path}, false)) AS active FROM up GROUP BY node_id""",
        nav=nav,
        path=path,
    )


def breadcrumbs(paths: DataFrame) -> DataFrame:
    """Crumbs of each path (path_id, path): prefix, label, and whether it is a link. Numeric segments are left out."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = paths.select("path_id", parts.alias("parts"), F.posexplode(parts).alias("place", "segment"))
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.col("segment")), percent_decoded(F.col("segment")))
    to = F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("place") + 1), "/"))
    last = F.col("place") == F.size("parts") - 1
    return rows.filter(~is_numeric(F.col("segment"))).select("path_id", F.col("place").cast("bigint").alias("place"), to.alias("link_to"), label.alias("label"), (~(last | (F.col("segment") == "edit"))).alias("clickable"))
