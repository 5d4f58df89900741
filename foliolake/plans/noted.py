"""Lines with annotations and boxes made of the part table: ten parts are a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

_TEXT = """CASE (p_partkey + p_size) % 10 WHEN 0 THEN '  ' || p_name || '  ' || p_brand WHEN 1 THEN '1. ' || upper(p_name) WHEN 2 THEN '1.' || (p_size % 4) || ' ' || p_name || ';'
  WHEN 3 THEN (p_size % 5) || ') (Word) of ' || p_name || ':' WHEN 4 THEN '   ' WHEN 5 THEN 'Глава ' || (p_size % 9) || '. ' || p_name WHEN 6 THEN '«Статья ' || (p_size % 9) || ' 2001 год'
  WHEN 7 THEN CASE WHEN p_size % 2 = 0 THEN 'Введение ' ELSE 'все».' END WHEN 8 THEN 'Приложение №' || (p_size % 3) ELSE 'а) ' || p_type || ', рисунок.' END"""
_NAME = "CASE k % 6 WHEN 0 THEN 'bold' WHEN 1 THEN 'size' WHEN 2 THEN 'bold' WHEN 3 THEN 'italic' WHEN 4 THEN 'table' ELSE 'bold' END"
_VALUE = "CASE WHEN k % 6 = 1 THEN '1' || (p_partkey % 4) WHEN k % 6 = 2 AND p_size % 3 = 0 THEN 'False' ELSE 'True' END"
_BOX = "(p_partkey * 7 % 5) * 20 AS x, p_partkey % 10 * 30 + p_size % 3 AS y, 100 + p_size % 7 * 30 AS width, 20 + p_size % 4 AS height"

SQL = f"""N AS (SELECT p_partkey, p_size, p_partkey // 10 AS doc_id, p_partkey % 10 AS line_id, {_TEXT} AS text, {_BOX} FROM part),
A AS (SELECT doc_id, line_id, {_NAME} AS name, {_VALUE} AS value, (p_partkey * 7 + k * 3) % 12 AS start, (p_partkey * 7 + k * 3) % 12 + 1 + (p_partkey + k * 5) % 6 AS "end" FROM N, (SELECT unnest(range(0, 6)) AS k) WHERE (p_size + k) % 4 <> 0)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_id, text, x, y, width, height, and the columns of the part they come from."""
    return table(spark, sf_dir, "part").selectExpr("*", "p_partkey div 10 AS doc_id", "p_partkey % 10 AS line_id", f"{_TEXT} AS text", *[x.strip() for x in _BOX.split(", ")])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_id, name, value, start, end."""
    rows = lines(spark, sf_dir).selectExpr("*", "explode(sequence(0, 5)) AS k").where("(p_size + k) % 4 <> 0")
    return rows.selectExpr("doc_id", "line_id", f"{_NAME} AS name", f"{_VALUE} AS value", "(p_partkey * 7 + k * 3) % 12 AS start", "(p_partkey * 7 + k * 3) % 12 + 1 + (p_partkey + k * 5) % 6 AS end")


def with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with an array of their annotations, by start, end, name and value."""
    one = F.struct("start", "end", "name", "value")
    found = spans(spark, sf_dir).groupBy("doc_id", "line_id").agg(F.array_sort(F.collect_list(one)).alias("annotations"))
    return lines(spark, sf_dir).join(found, ["doc_id", "line_id"], "left").withColumn("annotations", F.coalesce("annotations", F.array().cast("array<struct<start:bigint,end:bigint,name:string,value:string>>")))
