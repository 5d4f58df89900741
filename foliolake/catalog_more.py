"""Queries on tags, fonts, cells, titles and theses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import domain, labeling, layout, patterns, tables
from .plans import law, noted
from .registry import query
from .session import table

Q = "WITH " + law.SQL


@query("""SELECT p_partkey AS doc_id, CASE p_size % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'list_item' ELSE 'raw_text' END AS line_type, CASE p_size % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END END::DOUBLE AS level_1,
    CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 2 = 0 THEN 4 WHEN p_size % 5 < 2 THEN 2 ELSE 1 END::DOUBLE AS level_2, p_size % 3 = 2 AS can_be_multiline FROM part""")
def pattern_tags(spark, d):
    """Readers' tags with and without levels; numbers in the text give the second one."""
    k = F.col("p_size")
    tagged = k % 3 != 2
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("doc_id"), F.lit(0).alias("line_id"), F.when(tagged & (k % 5 < 2), F.concat(F.lit("1.2. "), "p_name")).otherwise(F.col("p_name")).alias("text"),
        F.when(k % 3 == 0, "header").when(k % 3 == 1, "list_item").alias("tag_type"), F.when(tagged & (k % 2 == 0), 3.0).alias("tag_level_1"), F.when(tagged & (k % 2 == 0), 4.0).alias("tag_level_2"),
    )
    return patterns.assign_levels(rows).select("doc_id", "line_type", "level_1", "level_2", "can_be_multiline")


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_size % 4 IN (0, 1) THEN 'list_item' ELSE 'raw_text' END AS line_type, CASE p_size % 4 WHEN 0 THEN 7 WHEN 1 THEN 8 END::DOUBLE AS level_1, CASE WHEN p_size % 4 IN (0, 1) THEN 1 END::DOUBLE AS level_2 FROM part""")
def pattern_bracket_roman(spark, d):
    own = patterns.parse_patterns("[{'name': 'bracket_roman_list', 'level_1': 7, 'level_2': 1}, {'name': 'letter_list', 'level_1': 8, 'level_2': 1}]")
    lead = F.element_at(F.array(*map(F.lit, ("v) ", "b) ", "ii) ", "5. "))), (F.col("p_size") % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("line_id"), F.concat(F.lit(" "), lead, "p_name").alias("text"))
    return patterns.assign_levels(rows, own).select("doc_id", "line_type", "level_1", "level_2")


@query("""SELECT l_orderkey AS table_id, l_linenumber::BIGINT AS row_id, (l_partkey % 2)::BIGINT AS col_id, string_agg(l_returnflag || l_partkey, chr(10) ORDER BY l_partkey, l_returnflag || l_partkey) AS text FROM lineitem GROUP BY ALL""")
def cell_texts(spark, d):
    k = F.col
    return tables.cell_text(table(spark, d, "lineitem").select(k("l_orderkey").alias("table_id"), k("l_linenumber").cast("long").alias("row_id"), (k("l_partkey") % 2).alias("col_id"), k("l_partkey").alias("line_id"), F.concat("l_returnflag", k("l_partkey").cast("string")).alias("text")))


@query("""WITH C AS (SELECT doc_id, line_id, i, substr(text, i, 1) AS c, CASE WHEN i <= 4 + p_size % 3 THEN 'Times-Bold' WHEN i <= 9 THEN 'Times' ELSE 'Arial' END AS font, CASE WHEN i <= 9 THEN 12.04 ELSE 9.96 END AS size FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM N)),
    R AS (SELECT *, sum(CASE WHEN font = f AND round(size) = s THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line_id ORDER BY i) AS run FROM (SELECT *, lag(font) OVER w AS f, round(lag(size) OVER w) AS s FROM C WINDOW w AS (PARTITION BY doc_id, line_id ORDER BY i)))
    SELECT doc_id, line_id, min(i) - 1 AS start, max(i) AS "end", min(font) AS style, min(contains(font, 'Bold')::INT)::BOOLEAN AS bold, round(min(size))::BIGINT AS size FROM R GROUP BY doc_id, line_id, run""".replace("WITH C", "WITH " + noted.SQL + ", C"))
def font_runs(spark, d):
    rows = noted.lines(spark, d).select("doc_id", "line_id", "p_size", F.explode(F.expr("transform(sequence(1, length(text)), i -> i)")).alias("i"))
    chars = rows.select("doc_id", "line_id", (F.col("i") - 1).alias("place"), F.when(F.col("i") <= 4 + F.col("p_size") % 3, "Times-Bold").when(F.col("i") <= 9, "Times").otherwise("Arial").alias("font"), F.when(F.col("i") <= 9, 12.04).otherwise(9.96).alias("size"))
    return layout.font_runs(chars)


@query(Q + """, T AS (SELECT DISTINCT doc_id, page_id, upper(text) || ' ' AS text, line_id % 4 + 1 AS depth FROM Q WHERE line_id % 3 = 0), M AS (SELECT doc_id, page_id, trim(lower(text)) AS k, min(depth) AS depth FROM T GROUP BY ALL) SELECT Q.doc_id, line_id, depth FROM Q LEFT JOIN M ON M.doc_id = Q.doc_id AND M.page_id = Q.page_id AND M.k = lower(trim(Q.text))""")
def truth_titles(spark, d):
    rows = law.lines(spark, d)
    truth = rows.where("line_id % 3 = 0").select("doc_id", "page_id", F.concat(F.upper("text"), F.lit(" ")).alias("text"), (F.col("line_id") % 4 + 1).alias("depth"))
    return labeling.with_truth(rows, truth).select("doc_id", "line_id", "depth")


@query(Q + """, C AS (SELECT doc_id, line_id, CASE WHEN line_id % 4 = 1 THEN 'toc' ELSE label END AS label FROM Q WHERE line_id % 4 <> 0 UNION ALL SELECT doc_id, line_id, 'toc' FROM Q WHERE line_id % 4 = 0), P AS (SELECT C.doc_id, C.line_id, C.label, page_id FROM C JOIN Q USING (doc_id, line_id))
    SELECT doc_id, page_id, line_id AS own, label, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, line_id) - 1 AS line_id FROM P""")
def toc_replaced(spark, d):
    rows = law.lines(spark, d).select("doc_id", "page_id", "line_id", "label")
    toc = rows.where("line_id % 4 IN (0, 1)").select("doc_id", "page_id", "line_id")
    return domain.with_contents(rows, toc).select("doc_id", "page_id", "own", "label", "line_id")


@query("""WITH T AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page_id, l_partkey AS table_id, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_suppkey, l_linenumber) AS k FROM lineitem), U AS (SELECT doc_id, table_id, min(page_id)::BIGINT AS page_id FROM T GROUP BY ALL)
    SELECT doc_id, table_id, true AS kept FROM U WHERE page_id > 0""")
def first_page_tables(spark, d):
    k = F.col
    rows = table(spark, d, "lineitem").groupBy(k("l_orderkey").alias("doc_id"), k("l_partkey").alias("table_id")).agg(F.min(k("l_linenumber") % 3).cast("long").alias("page_id"))
    notes = rows.select("doc_id", F.lit("table").alias("name"), k("table_id").cast("string").alias("value"))
    kept, left = layout.without_first_page_tables(rows, notes)
    return kept.join(left.select("doc_id", k("value").cast("long").alias("table_id"), F.lit(True).alias("kept")), ["doc_id", "table_id"], "left").select("doc_id", "table_id", "kept")
