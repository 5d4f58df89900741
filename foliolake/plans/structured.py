"""Structured documents made of the relational tables: an order is a document, its
lineitems are its lines, and the part decides how a line begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.patterns import assign_levels
from ..session import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").select("*", (F.row_number().over(w) - 1).cast("long").alias("line_id"))
    n, m, k = F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 4 + 1).cast("string"), F.col("l_partkey") % 8
    text = (
        F.when(k == 0, F.concat(n, F.lit(". a"))).when(k == 1, F.concat(n, F.lit("."), m, F.lit(". b"))).when(k == 2, F.concat((F.col("l_linenumber") % 10).cast("string"), F.lit(") c")))
        .when(k == 3, "a) d").when(k == 4, "- e").when(k == 5, "v. f").when(k == 6, F.concat(F.lit("Chapter "), n)).otherwise(F.concat(F.lit("plain "), F.col("l_returnflag")))
    )
    return li.select(F.col("l_orderkey").alias("doc_id"), "line_id", text.alias("text"), F.when(k == 6, "header").alias("tag_type"), F.col("l_quantity").alias("size"), F.col("l_linenumber").cast("long").alias("number"))


def levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_levels(lines(spark, sf_dir))


#: The same lines and levels in SQL.
SQL = r"""
L0 AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS line_id, l_partkey % 8 AS k FROM lineitem),
L AS (
  SELECT l_orderkey AS doc_id, line_id, l_quantity AS size, l_linenumber::BIGINT AS number,
    CASE k WHEN 0 THEN l_linenumber || '. a' WHEN 1 THEN l_linenumber || '.' || (l_partkey % 4 + 1) || '. b' WHEN 2 THEN (l_linenumber % 10) || ') c'
      WHEN 3 THEN 'a) d' WHEN 4 THEN '- e' WHEN 5 THEN 'v. f' WHEN 6 THEN 'Chapter ' || l_linenumber ELSE 'plain ' || l_returnflag END AS text,
    CASE k WHEN 6 THEN 'header' WHEN 7 THEN 'raw_text' ELSE 'list_item' END AS line_type,
    CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 3 WHEN 6 THEN 1 END::DOUBLE AS level_1,
    CASE k WHEN 1 THEN 2 WHEN 7 THEN NULL ELSE 1 END::DOUBLE AS level_2,
    k = 7 AS can_be_multiline FROM L0)"""

#: Inserted lists, merged runs and parents by joins and windows.
TREE_SQL = SQL + r""",
H AS (SELECT *, coalesce(level_1, 1e6) * 1000 + coalesce(level_2, 900) AS hl, sum(CASE WHEN line_type IN ('list_item', 'raw_text') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_id) AS seg FROM L),
I AS (SELECT * FROM H WHERE line_type = 'list_item'),
B AS (SELECT i.doc_id, i.line_id, max(j.line_id) AS near FROM I i LEFT JOIN I j ON i.doc_id = j.doc_id AND i.seg = j.seg AND j.line_id < i.line_id AND j.hl <= i.hl GROUP BY ALL),
N AS (SELECT i.doc_id, i.line_id, i.level_1, i.level_2 - 0.5 AS level_2 FROM I i JOIN B b USING (doc_id, line_id) LEFT JOIN I j ON j.doc_id = b.doc_id AND j.line_id = b.near WHERE b.near IS NULL OR j.hl < i.hl),
A AS (
  SELECT doc_id, line_id * 2 + 1 AS pos, text, line_type, level_1, level_2, hl, can_be_multiline FROM H
  UNION ALL SELECT doc_id, line_id * 2, '', 'list', level_1, level_2, level_1 * 1000 + level_2, false FROM N),
M AS (
  SELECT *, CASE WHEN can_be_multiline AND hl = lag(hl) OVER w AND line_type = lag(line_type) OVER w THEN 0 ELSE 1 END AS new FROM A WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
G AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS node FROM M),
K AS (
  SELECT doc_id, node::BIGINT AS node, min(line_type) AS line_type, min(level_1) AS level_1, min(level_2) AS level_2, min(hl) AS hl, count(*) AS n_lines, string_agg(text, '' ORDER BY pos) AS text FROM G GROUP BY doc_id, node
  UNION ALL SELECT DISTINCT doc_id, 0, 'root', 0.0, 0.0, -1, 0, '' FROM G),
P AS (SELECT a.doc_id, a.node, max(b.node) AS parent FROM K a LEFT JOIN K b ON a.doc_id = b.doc_id AND b.node < a.node AND b.hl < a.hl GROUP BY ALL),
O AS (SELECT *, CASE WHEN node = 0 THEN 0 ELSE row_number() OVER (PARTITION BY doc_id, parent ORDER BY node) - 1 END AS ord FROM P),
R AS (
  SELECT doc_id, node, parent, ord, '0' AS node_id, 0 AS depth FROM O WHERE node = 0
  UNION ALL SELECT o.doc_id, o.node, o.parent, o.ord, r.node_id || '.' || o.ord, r.depth + 1 FROM R r JOIN O o ON o.doc_id = r.doc_id AND o.parent = r.node),
T AS (SELECT R.doc_id, R.node, R.parent, R.ord::BIGINT AS ord, R.node_id, R.depth::BIGINT AS depth, K.line_type, K.level_1, K.level_2, K.n_lines::BIGINT AS n_lines, K.text FROM R JOIN K USING (doc_id, node))"""
