"""Queries on trees with annotations and pages, on hierarchies and on outputs, with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from . import catalog_documents, catalog_lines
from .operators import classify, hierarchy, layout, tree
from .plans import law, structured
from .registry import SQL, query
from .session import table
from .sinks import render

#: Nodes' lines with their places, from the SQL of trees.
PLACED = "Z AS (WITH RECURSIVE " + structured.TREE_SQL + """ SELECT doc_id, (pos - 1) // 2 AS line_id, pos % 2 AS real, node, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, node ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM G)"""
_PARTS = ("CASE line_id % 3 WHEN 0 THEN 'size' ELSE 'bold' END AS name", "CASE line_id % 2 WHEN 0 THEN 'True' ELSE 'x' END AS value", "line_id % 2 AS start", "line_id % 2 + 3 + line_id % 4 * 2 AS")
_SPAN = ", ".join(_PARTS)


def tree_spans(spark, d):
    return structured.lines(spark, d).selectExpr("doc_id", "line_id", *_PARTS[:3], f"{_PARTS[3]} end")


@query(f"""WITH RECURSIVE {PLACED}, N AS (SELECT doc_id, node AS line_id, string_agg(text, '' ORDER BY off, line_id) AS text FROM Z GROUP BY ALL), A AS (SELECT doc_id, node AS line_id, name, value, start + off AS start, "end" + off AS "end" FROM (SELECT doc_id, node, off, {_SPAN} "end" FROM Z WHERE real = 1)),
    {catalog_lines.MERGED}, R AS (SELECT M.*, text, row_number() OVER (PARTITION BY doc_id, line_id, name ORDER BY start, "end", value) AS i FROM M JOIN N USING (doc_id, line_id)),
    K AS (SELECT doc_id, line_id, name, value, start, "end", i, 'add' AS act, start AS ls, "end" AS le FROM R WHERE i = 1
      UNION ALL SELECT doc_id, line_id, name, value, start, "end", i, act, CASE WHEN act = 'skip' THEN ls ELSE start END, CASE WHEN act = 'skip' THEN le ELSE "end" END FROM (
        SELECT r.*, CASE WHEN r.start >= k.le THEN 'add' WHEN substr(r.text, k.ls::BIGINT + 1, 1) = ' ' THEN 'instead' ELSE 'skip' END AS act, k.ls, k.le FROM K k JOIN R r ON r.doc_id = k.doc_id AND r.line_id = k.line_id AND r.name = k.name AND r.i = k.i + 1)),
    L AS (SELECT *, lead(act) OVER (PARTITION BY doc_id, line_id, name ORDER BY i) AS after FROM K WHERE act <> 'skip')
    SELECT doc_id, line_id AS node, name, value, start::BIGINT AS start, "end"::BIGINT AS "end" FROM L WHERE after IS DISTINCT FROM 'instead'""")
def tree_annotations(spark, d):
    return tree.node_annotations(structured.levelled(spark, d), tree_spans(spark, d))


@query(f"""WITH RECURSIVE {PLACED}, P AS (SELECT *, line_id // 2 AS page_id, first_value(line_id // 2) OVER (PARTITION BY doc_id, node ORDER BY line_id) AS home FROM Z WHERE real = 1), W AS (SELECT *, CASE WHEN page_id IS DISTINCT FROM lag(page_id) OVER (PARTITION BY doc_id, node ORDER BY line_id) THEN 1 ELSE 0 END AS new FROM P WHERE page_id <> home),
    X AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, node ORDER BY line_id) AS part FROM W) SELECT doc_id, node::BIGINT AS node, min(page_id) AS page_id, min(off) AS start, max(off + length(text))::BIGINT AS "end" FROM X GROUP BY doc_id, node, part""")
def tree_pages(spark, d):
    return tree.page_spans(structured.levelled(spark, d).withColumn("page_id", F.floor(F.col("line_id") / 2)))


@query("WITH RECURSIVE " + structured.TREE_SQL + """, U AS (SELECT doc_id, node, node AS at, '' AS ancestors FROM T UNION ALL SELECT u.doc_id, u.node, t.parent, u.ancestors || CASE WHEN u.ancestors = '' THEN '' ELSE ',' END || p.node_id FROM U u JOIN T t ON t.doc_id = u.doc_id AND t.node = u.at JOIN T p ON p.doc_id = t.doc_id AND p.node = t.parent),
    V AS (SELECT doc_id, node, max_by(ancestors, length(ancestors)) AS ancestors FROM U GROUP BY ALL)
    SELECT T.doc_id, T.node, '0' AS root, ancestors, row_number() OVER (PARTITION BY T.doc_id ORDER BY depth, T.node) - 1 AS breadth, T.node AS preorder FROM T JOIN V USING (doc_id, node)""")
def tree_traversal(spark, d):
    return tree.traversal(tree.build_tree(structured.levelled(spark, d)))


@query("WITH " + structured.SQL + r""", I AS (SELECT doc_id, line_id, list_transform(list_filter(string_split(regexp_extract(text, '^(\d+\.)+'), '.'), lambda x: x <> ''), lambda x: x::BIGINT) AS a FROM L), J AS (SELECT *, lag(a) OVER (PARTITION BY doc_id ORDER BY line_id) AS p FROM I WHERE len(a) > 0)
    SELECT doc_id, line_id, coalesce(p < a, false) AS later, coalesce(len(p) = len(a) - 1 AND a[:len(a) - 1] = p, false) AS below FROM J""")
def list_item_order(spark, d):
    from .operators.features import order

    numbers = F.transform(F.filter(F.split(F.regexp_extract("text", r"^(\d+\.)+", 0), r"\."), lambda x: x != ""), lambda x: x.cast("long"))
    rows = structured.lines(spark, d).select("doc_id", "line_id", numbers.alias("a")).where("size(a) > 0").withColumn("p", F.lag("a").over(order()))
    return rows.select("doc_id", "line_id", F.coalesce(tree.item_before(F.col("p"), F.col("a")), F.lit(False)).alias("later"), F.coalesce(tree.item_above(F.col("p"), F.col("a")), F.lit(False)).alias("below"))


# --- hierarchies -----------------------------------------------------------------------------------


@query(catalog_documents.LAW_LABELS + f""", S AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY line_id) AS n FROM (SELECT *, CASE WHEN count(*) FILTER (fixed = 'application') OVER w > 0 THEN 'application' WHEN count(*) FILTER (fixed = 'cellar') OVER w > 0 THEN 'cellar'
      WHEN count(*) FILTER (fixed = 'structure_unit') OVER w > 0 THEN 'body' ELSE 'header' END AS segment FROM C WINDOW w AS (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING))),
    V AS (SELECT *, regexp_matches(text, '{catalog_documents.ROMAN}') AS roman, CASE WHEN starts_with(lower(text), 'часть') THEN 'part 3 1' WHEN starts_with(lower(text), 'раздел') THEN 'section 4 1' WHEN regexp_matches(text, '{catalog_documents.ROMAN}') THEN 'subsection 5 1'
      WHEN starts_with(lower(text), 'глава') THEN 'chapter 6 1' WHEN starts_with(text, '§') THEN 'paragraph 7 1' WHEN starts_with(lower(text), 'статья') THEN 'article 8 1'
      WHEN regexp_matches(text, '^\\s*(\\d*\\.)*\\d+[)}}]') THEN 'item 10 0' WHEN regexp_matches(text, '^\\s*(\\d+\\.)+') THEN 'articlePart 9 0' WHEN regexp_matches(text, '^\\s*[а-яё][)}}]') THEN 'subitem 11 0' END AS unit FROM S),
    W AS (SELECT *, CASE segment WHEN 'body' THEN CASE WHEN fixed IN ('application', 'raw_text', 'cellar') AND roman THEN 'structure_unit' WHEN fixed = 'application' THEN 'footer' ELSE fixed END
      WHEN 'application' THEN CASE WHEN n = 1 THEN 'application' WHEN fixed IN ('application', 'raw_text', 'cellar', 'title') AND roman THEN 'structure_unit' WHEN fixed IN ('cellar', 'title') THEN 'application' ELSE fixed END END AS lab FROM V),
    X AS (SELECT *, CASE WHEN lab = 'structure_unit' AND unit IS NOT NULL THEN unit WHEN lab = 'application' THEN 'application 2 1' END AS own FROM W),
    Y AS (SELECT *, last_value(own IGNORE NULLS) OVER b AS last, max(CASE WHEN own IS NOT NULL THEN line_id END) OVER b AS last_at, max(CASE WHEN lab = 'raw_text' THEN line_id END) OVER b AS raw_at, max(CASE WHEN coalesce(lab, '') NOT IN ('structure_unit', 'application', 'raw_text') THEN line_id END) OVER b AS end_at
      FROM X WINDOW b AS (PARTITION BY doc_id, segment ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    Z AS (SELECT *, last IS NOT NULL AND coalesce(end_at < last_at, true) AND split_part(last, ' ', 1) IN ('chapter', 'application') AS goes, last IS NOT NULL AND coalesce(end_at < last_at, true) AND coalesce(raw_at < last_at, true) AS open FROM Y),
    M AS (SELECT *, coalesce(own, CASE WHEN lab = 'structure_unit' AND (open OR goes) AND ends_with(last, '1') THEN last WHEN lab = 'raw_text' AND goes THEN last END, 'raw_text') AS hl FROM Z),
    N AS (SELECT doc_id, line_id * 2 + 1 AS k, text, CASE segment WHEN 'header' THEN 'root' WHEN 'cellar' THEN 'cellar' ELSE split_part(hl, ' ', 1) END AS line_type, CASE segment WHEN 'header' THEN 0 WHEN 'cellar' THEN 2 ELSE try_cast(split_part(hl, ' ', 2) AS DOUBLE) END AS level_1,
      CASE WHEN segment IN ('header', 'cellar') THEN true WHEN segment = 'application' AND n = 1 THEN false ELSE ends_with(hl, ' 1') END AS can_be_multiline FROM M
      UNION ALL SELECT doc_id, coalesce(min(CASE WHEN segment <> 'header' THEN line_id END), max(line_id) + 1) * 2, '', 'body', 2, false FROM M GROUP BY doc_id)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line_id, text, line_type, level_1::DOUBLE AS level_1, can_be_multiline FROM N""")
def law_hierarchy(spark, d):
    return hierarchy.law_levels(law.lines(spark, d)).select("doc_id", "line_id", "text", "line_type", "level_1", "can_be_multiline")


@query("WITH C AS (SELECT p_partkey // 8 AS doc_id, p_partkey % 8 AS line_id, CASE WHEN (p_partkey + p_size) % 11 = 0 THEN 'Contents' ELSE p_name END AS text FROM part), F AS (SELECT doc_id, min(line_id) AS f, min_by(lower(text) = 'contents', line_id) AS t FROM C GROUP BY 1)," + """
    U AS (SELECT doc_id, line_id * 2 + 1 AS k, text, CASE WHEN text = 'Contents' THEN 'toc' ELSE 'toc_item' END AS line_type, CASE WHEN text = 'Contents' THEN 2.0 ELSE 3.0 END::DOUBLE AS level_1 FROM C UNION ALL SELECT doc_id, f * 2, '', 'toc', 2.0 FROM F WHERE NOT t)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line_id, text, line_type, level_1 FROM U""")
def contents_nodes(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey div 8 AS doc_id", "p_partkey % 8 AS line_id", "CASE WHEN (p_partkey + p_size) % 11 = 0 THEN 'Contents' ELSE p_name END AS text")
    return hierarchy.contents_levels(rows).select("doc_id", "line_id", "text", "line_type", "level_1")


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_size % 3 = 0 THEN 'section' ELSE 'raw_text' END AS line_type, CASE WHEN p_size % 3 = 0 THEN 1.0 END::DOUBLE AS level_1, CASE WHEN p_size % 3 = 0 THEN (p_size % 4)::DOUBLE END AS level_2 FROM part""")
def article_levels(spark, d):
    k = F.col("p_size")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("line_id"), F.col("p_name").alias("text"), F.when(k % 3 == 0, "section").alias("tag_type"), F.when(k % 3 == 0, 1).alias("tag_level_1"), F.when(k % 3 == 0, k % 4).alias("tag_level_2"))
    return hierarchy.article_levels(rows).select("doc_id", "line_type", "level_1", "level_2")


@query("""SELECT p_partkey AS doc_id, p_name AS text, CASE WHEN p_size % 2 = 0 THEN 'header' ELSE 'raw_text' END AS line_type, CASE WHEN p_size % 2 = 0 THEN 1.0 END::DOUBLE AS level_1, CASE WHEN p_size % 2 = 0 THEN least(p_size % 9, 6)::DOUBLE END AS level_2 FROM part WHERE p_size % 5 <> 0""")
def report_levels(spark, d):
    k = F.col("p_size")
    text = F.when(k % 5 == 0, " .. ").otherwise(F.concat(F.lit("* "), "p_name", F.lit(" ....  ")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("line_id"), text.alias("text"), F.when(k % 2 == 0, k % 9).alias("depth"))
    return hierarchy.report_levels(rows).select("doc_id", "text", "line_type", "level_1", "level_2")


CLASSES = ("title", "item", "raw_text")


def linear_model(x: np.ndarray) -> np.ndarray:
    scores = x @ np.array([[1.0, -0.5, 0.25], [-0.1, 0.2, 0.05]]) + np.array([0.0, 1.0, 0.5])
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@query("WITH " + law.SQL + """, S AS (SELECT *, x / 10.0 - 0.1 * height AS a, -0.5 * x / 10.0 + 0.2 * height + 1.0 AS b, 0.25 * x / 10.0 + 0.05 * height + 0.5 AS c, text = '12' AS blank FROM Q),
    B AS (SELECT *, min(CASE WHEN NOT blank AND b > a AND b >= c THEN line_id END) OVER (PARTITION BY doc_id) AS f FROM S)
    SELECT doc_id, line_id, CASE WHEN blank THEN 'raw_text' WHEN a >= b AND a >= c AND (f IS NULL OR line_id < f) THEN 'title' WHEN b >= c THEN 'item' ELSE 'raw_text' END AS line_type FROM B""")
def line_types(spark, d):
    rows = law.lines(spark, d).select("doc_id", "line_id", F.when(F.col("text") == "12", " ").otherwise(F.col("text")).alias("text"), (F.col("x") / 10.0).alias("a"), F.col("height").alias("b"))
    return classify.settled(classify.probabilities(rows, linear_model, ["a", "b"]), CLASSES, "title", ("item",)).select("doc_id", "line_id", "line_type")


# --- pages and outputs --------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS page_num, l_linenumber % 2 AS block_num, l_suppkey % 2 AS par_num, (l_linenumber % 3)::BIGINT AS line_num, string_agg(l_returnflag || l_partkey, ' ' ORDER BY l_partkey, l_returnflag || l_partkey) AS text, count(*) AS n_words FROM lineitem WHERE l_quantity >= 20 GROUP BY ALL""")
def ocr_blocks(spark, d):
    k = F.col
    words = table(spark, d, "lineitem").select(k("l_orderkey").alias("page_num"), (k("l_linenumber") % 2).alias("block_num"), (k("l_suppkey") % 2).alias("par_num"), (k("l_linenumber") % 3).cast("long").alias("line_num"), k("l_partkey").alias("word_num"), F.concat("l_returnflag", k("l_partkey").cast("string")).alias("text"), (k("l_quantity") * 2).alias("conf"))
    return layout.ocr_lines(words)


@query("""WITH P AS (SELECT doc_id, line_id, line_id // 3 AS page_id, 'line' AS kind FROM (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS line_id FROM lineitem))
    SELECT doc_id, page_id, line_id AS own, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, line_id) - 1 AS line_id FROM P""")
def page_flatten(spark, d):
    rows = law.lines(spark, d).select("doc_id", "page_id", F.col("line_id").alias("own"))
    return layout.flatten_pages([rows.where("page_id > 1"), rows.where("page_id = 0"), rows.where("page_id = 1")], "own")


@query("WITH RECURSIVE " + structured.TREE_SQL + """ SELECT doc_id, count(*) AS n_nodes, string_agg(node_id || ':' || text, '|' ORDER BY node) AS nodes FROM T GROUP BY doc_id""")
def api_schema(spark, d):
    got = render.api_schema(tree.build_tree(structured.levelled(spark, d)))
    return got.select("doc_id", F.size("structure").cast("long").alias("n_nodes"), F.array_join(F.transform("structure", lambda x: F.concat(x["node_id"], F.lit(":"), x["text"])), "|").alias("nodes"))


@query("WITH RECURSIVE " + structured.TREE_SQL + """ SELECT doc_id, count(*) AS n_nodes, sum(length(text))::BIGINT AS n_chars, max(depth) AS depth FROM T GROUP BY doc_id""")
def nested_json(spark, d):
    """Each document as nested JSON, read back: its nodes, characters and depth."""
    got = render.documents(tree.build_tree(structured.levelled(spark, d)))
    ids = F.regexp_extract_all("json", F.lit('"node_id": "([0-9.]+)"'), F.lit(1))
    texts = F.regexp_extract_all("json", F.lit('"text": "([^"]*)"'), F.lit(1))
    deep = F.array_max(F.transform(ids, lambda x: F.size(F.split(x, "[.]")) - 1))
    return got.select("doc_id", F.size(ids).cast("long").alias("n_nodes"), F.length(F.array_join(texts, "")).cast("long").alias("n_chars"), deep.cast("long").alias("depth"))


@query("WITH RECURSIVE " + structured.TREE_SQL + """ SELECT doc_id, count(*) AS opened, count(*) AS closed, length(string_agg(node_id, '' ORDER BY node)) AS ids FROM T GROUP BY doc_id""")
def collapsed_html(spark, d):
    """Pages that fold, one row a document: every node opens and closes once."""
    got = render.collapsed_pages(tree.build_tree(structured.levelled(spark, d)))
    ids = F.array_join(F.regexp_extract_all("html", F.lit("<summary>([0-9.]+) "), F.lit(1)), "")
    return got.select("doc_id", F.regexp_count("html", F.lit("<details>")).cast("long").alias("opened"), F.regexp_count("html", F.lit("</details>")).cast("long").alias("closed"), F.length(ids).cast("long").alias("ids"))


@query("WITH RECURSIVE " + structured.TREE_SQL + """, Y AS (SELECT doc_id, node, '<p>' || repeat('&nbsp;', (4 * depth)::INT) || '<b>' || node_id || ' ' || line_type || '</b> ' || text || '</p>' AS h FROM T) SELECT doc_id, '<html><body>' || chr(10) || string_agg(h, chr(10) ORDER BY node) || chr(10) || '</body></html>' AS html FROM Y GROUP BY doc_id""")
def html_document(spark, d):
    return render.html_pages(tree.build_tree(structured.levelled(spark, d)))


@query("WITH " + structured.SQL + """ SELECT doc_id, line_id, to_json({'_line': text, '_metadata': {'page_id': line_id // 3, 'line_id': line_id}, '_uid': md5(doc_id || '_' || line_id)})::VARCHAR AS json FROM L""")
def label_lines(spark, d):
    from .functions import text as T

    rows = structured.lines(spark, d).select("doc_id", "line_id", "text", F.floor(F.col("line_id") / 3).alias("page_id"), T.uid(F.col("doc_id"), F.col("line_id")).alias("uid"))
    return rows.select("doc_id", "line_id", F.to_json(F.struct(*render.label_columns())).alias("json"))


SQL["html_page_tables"] = """SELECT table_id, '<table>' || string_agg('<tr>' || cells || '</tr>', '' ORDER BY row_id) || '</table>' AS html FROM (
    SELECT l_orderkey AS table_id, l_linenumber::BIGINT AS row_id, string_agg('<td colspan="' || (l_partkey % 2 + 1) || '" rowspan="1">' || l_returnflag || l_partkey || '</td>', '' ORDER BY l_partkey, l_suppkey) AS cells FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL) GROUP BY 1"""


@query(SQL["html_page_tables"])
def html_page_tables(spark, d):
    k = F.col
    cells = table(spark, d, "lineitem").select(k("l_orderkey").alias("table_id"), k("l_linenumber").cast("long").alias("row_id"), F.struct("l_partkey", "l_suppkey").alias("col_id"), F.concat("l_returnflag", k("l_partkey").cast("string")).alias("text"), (k("l_partkey") % 2 + 1).alias("colspan"), F.lit(1).alias("rowspan"), (k("l_partkey") % 5 == 0).alias("invisible"))
    return render.html_tables(cells)
