"""Laws made of the relational tables: an order is a document, its lineitems are lines
with a label, a page and a box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table

#: Beginnings by l_partkey % 13, and labels by l_suppkey % 6.
STARTS = ("Глава 1", "Статья 2", "3. часть", "4.5) пункт", "а) подпункт", "Раздел 6", "П. римская", "§ 7", "Часть 8", "12", "Приказ № 47/8 от 1.1.2000", "слова", "З А К О Н")
LABELS = ("raw_text", "structure_unit", "cellar", "title", "application", "footnote")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    li = table(spark, sf_dir, "lineitem").withColumn("line_id", (F.row_number().over(w) - 1).cast("long"))
    k = F.col
    box = [(k("l_partkey") % 9 * 10).alias("x"), (k("line_id") % 3 * 30).alias("y"), (k("l_suppkey") % 5 * 10 + 20).alias("width"), (k("l_partkey") % 4 + 10).alias("height")]
    return li.select(k("l_orderkey").alias("doc_id"), "line_id", pick(STARTS, k("l_partkey") % 13).alias("text"), pick(LABELS, k("l_suppkey") % 6).alias("label"), F.floor(k("line_id") / 3).cast("long").alias("page_id"), k("l_quantity").alias("size"), *box)


SQL = f"""
Q0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS line_id FROM lineitem),
Q AS (SELECT l_orderkey AS doc_id, line_id, {list(STARTS)}[l_partkey % 13 + 1] AS text, {list(LABELS)}[l_suppkey % 6 + 1] AS label, line_id // 3 AS page_id, l_quantity AS size,
    l_partkey % 9 * 10 AS x, line_id % 3 * 30 AS y, l_suppkey % 5 * 10 + 20 AS width, l_partkey % 4 + 10 AS height FROM Q0)"""
