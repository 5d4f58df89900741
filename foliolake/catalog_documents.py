"""Queries on kinds of documents, boxes, labelling and output, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog
from .operators import domain, features, layout, labeling, lines, tables, tree
from .plans import law, structured
from .registry import SQL, query
from .session import table
from .sinks import render

Q = "WITH " + law.SQL
ROMAN = "^\\s*(I|Г|T|Т|II|П|III|Ш|ТУ|TУ|IV|V|У|VI|УТ|УT|VII|УТТ|VIII|I[XХ]|[XХ]|[XХ]I|[XХ]II)\\.\\s+"

# --- laws, technical tasks, theses -------------------------------------------------------------


@query(Q + f""", U AS (SELECT *, CASE WHEN starts_with(lower(text), 'часть') THEN 'part 3 1' WHEN starts_with(lower(text), 'раздел') THEN 'section 4 1' WHEN regexp_matches(text, '{ROMAN}') THEN 'subsection 5 1'
    WHEN starts_with(lower(text), 'глава') THEN 'chapter 6 1' WHEN starts_with(text, '§') THEN 'paragraph 7 1' WHEN starts_with(lower(text), 'статья') THEN 'article 8 1'
    WHEN regexp_matches(text, '^\\s*(\\d*\\.)*\\d+[)}}]') THEN 'item 10 0' WHEN regexp_matches(text, '^\\s*(\\d+\\.)+') THEN 'articlePart 9 0' WHEN regexp_matches(text, '^\\s*[а-яё][)}}]') THEN 'subitem 11 0' END AS own FROM Q),
    V AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS near FROM U),
    W AS (SELECT *, coalesce(own, CASE WHEN ends_with(near, '1') THEN near END, 'raw_text') AS unit FROM V)
    SELECT doc_id, line_id, split_part(unit, ' ', 1) AS line_type, try_cast(split_part(unit, ' ', 2) AS DOUBLE) AS level_1, ends_with(unit, ' 1') AS can_be_multiline FROM W""")
def law_units(spark, d):
    return domain.law_units(law.lines(spark, d)).select("doc_id", "line_id", "line_type", "level_1", "can_be_multiline")


@query(Q + f""", U AS (SELECT *, CASE WHEN starts_with(lower(text), 'глава') OR regexp_matches(text, '{ROMAN}') THEN 'chapter 6 0' WHEN regexp_matches(text, '^\\s*(\\d*\\.)*\\d+[)}}]') THEN 'subitem 11 2'
    WHEN regexp_matches(text, '^\\s*[а-яё][)}}]') THEN 'subitem 12 1' WHEN regexp_matches(text, '^\\s*(\\d+\\.)+') THEN 'item 10 1' END AS own FROM Q),
    V AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING), 'raw_text') AS unit FROM U)
    SELECT doc_id, line_id, split_part(unit, ' ', 1) AS line_type, try_cast(split_part(unit, ' ', 2) AS DOUBLE) AS level_1, try_cast(split_part(unit, ' ', 3) AS DOUBLE) AS level_2 FROM V""")
def foiv_units(spark, d):
    return domain.foiv_units(law.lines(spark, d)).select("doc_id", "line_id", "line_type", "level_1", "level_2")


@query(Q + f" SELECT doc_id, line_id, CASE WHEN regexp_matches(text, '{ROMAN}') THEN 'II. ' || substr(text, 4) ELSE text END AS text FROM Q")
def roman_repair(spark, d):
    return law.lines(spark, d).select("doc_id", "line_id", domain.roman_repair(F.col("text")).alias("text"))


@query(Q + r""", N AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_id) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM Q),
    F AS (SELECT doc_id, n // 3 AS batch, CASE WHEN starts_with(text, 'Приказ') THEN 'приказ' END AS kind, starts_with(text, 'З А К О Н') AS law FROM N WHERE n < 24 AND c > 3 * (n // 3 + 1)),
    G AS (SELECT doc_id, CASE WHEN max(kind) IS NOT NULL THEN 'приказ' WHEN bool_or(law) THEN 'закон' END AS t FROM F GROUP BY doc_id)
    SELECT DISTINCT doc_id, t AS law_type, CASE WHEN t = 'приказ' THEN 'foiv_law' ELSE 'law' END AS extractor FROM Q LEFT JOIN G USING (doc_id)""")
def law_type(spark, d):
    return domain.law_type(law.lines(spark, d))


LAW_LABELS = Q + """, A AS (SELECT *, min(CASE WHEN label IN ('structure_unit', 'cellar', 'application') THEN line_id END) OVER w AS b, min(CASE WHEN label = 'application' THEN line_id END) OVER w AS a FROM Q WINDOW w AS (PARTITION BY doc_id)),
    B AS (SELECT *, coalesce(max(CASE WHEN label = 'structure_unit' AND line_id < coalesce(a, 1000000) THEN line_id END) OVER (PARTITION BY doc_id), b) AS u FROM A),
    C AS (SELECT *, CASE WHEN line_id < coalesce(b, 1000000) THEN 'title' WHEN label = 'title' OR label = 'cellar' AND (line_id < u OR line_id >= coalesce(a, 1000000)) THEN 'raw_text' ELSE label END AS fixed FROM B)"""


@query(LAW_LABELS + """ SELECT doc_id, line_id, fixed, CASE WHEN count(*) FILTER (fixed = 'application') OVER w > 0 THEN 'application' WHEN count(*) FILTER (fixed = 'cellar') OVER w > 0 THEN 'cellar'
    WHEN count(*) FILTER (fixed = 'structure_unit') OVER w > 0 THEN 'body' ELSE 'header' END AS segment FROM C WINDOW w AS (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING)""")
def law_segments(spark, d):
    return domain.law_labels(law.lines(spark, d)).select("doc_id", "line_id", "fixed", domain.law_segments().alias("segment"))


NAMED = "['toc', 'item', 'title', 'raw_text', 'part', 'named_item']"
TASK = Q + f", T AS (SELECT * REPLACE ({NAMED}[y // 5 % 6 + 1] AS label) FROM (SELECT * REPLACE (x // 10 * 5 + line_id * 5 AS y) FROM Q))"


def task_lines(spark, d):
    names = F.array(*map(F.lit, ("toc", "item", "title", "raw_text", "part", "named_item")))
    return law.lines(spark, d).withColumn("label", F.element_at(names, ((F.col("x") / 10 + F.col("line_id")) % 6 + 1).cast("int")))


@query(TASK + """, M AS (SELECT *, coalesce(max(CASE WHEN label IN ('toc', 'title') THEN line_id END) OVER (PARTITION BY doc_id), 0) AS last_toc, median(size) OVER (PARTITION BY doc_id) AS mid FROM T)
    SELECT doc_id, line_id, CASE WHEN bool_or(label IN ('part', 'item') OR line_id > last_toc) OVER w THEN 'body' WHEN bool_or(label = 'toc') OVER w THEN 'toc' ELSE 'header' END AS segment,
      CASE WHEN size >= mid + 2 AND label IN ('item', 'part', 'named_item') THEN 'part' WHEN label = 'part' THEN 'named_item' ELSE label END AS label FROM M WINDOW w AS (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING)""")
def task_segments(spark, d):
    return domain.task_segments(task_lines(spark, d)).select("doc_id", "line_id", "segment", domain.task_labels("label", "size").alias("label"))


@query(TASK + """, M AS (SELECT *, coalesce(min(CASE WHEN label NOT IN ('title', 'raw_text') THEN line_id END) OVER (PARTITION BY doc_id), 0) AS first FROM T)
    SELECT doc_id, line_id, CASE WHEN line_id < first THEN 'title' WHEN label = 'title' THEN 'raw_text' ELSE label END AS fixed FROM M""")
def title_labels(spark, d):
    return domain.title_labels(task_lines(spark, d)).select("doc_id", "line_id", "fixed")


@query(Q + """ SELECT doc_id, line_id, coalesce(text = '12' AND lag(page_id) OVER w IS NOT NULL AND lead(page_id) OVER w IS NOT NULL AND (lag(page_id) OVER w < page_id OR page_id < lead(page_id) OVER w), false) AS is_page_number
    FROM Q WINDOW w AS (PARTITION BY doc_id ORDER BY line_id)""")
def page_numbers(spark, d):
    return law.lines(spark, d).select("doc_id", "line_id", domain.page_numbers().alias("is_page_number"))


@query(Q + """, R AS (SELECT *, sum(CASE WHEN label = 'footnote' AND before = 'footnote' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_id) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY line_id) AS before FROM Q))
    SELECT doc_id, min(line_id) AS line_id, string_agg(text, '' ORDER BY line_id) AS text, min(label) AS label, count(*) AS n_lines FROM R GROUP BY doc_id, run""")
def footnotes(spark, d):
    return domain.footnotes(law.lines(spark, d))


@query("WITH RECURSIVE " + law.SQL + """, D AS (SELECT doc_id, line_id, size, stddev_pop(size) OVER (PARTITION BY doc_id) AS std FROM Q),
    K AS (SELECT doc_id, line_id, [size] AS stack FROM D WHERE line_id = 0
      UNION ALL SELECT d.doc_id, d.line_id, list_append(k.stack[1:coalesce(list_max(list_filter(range(1, len(k.stack) + 1), lambda i: k.stack[i] > d.size + d.std)), 0)], d.size) FROM K k JOIN D d ON d.doc_id = k.doc_id AND d.line_id = k.line_id + 1)
    SELECT doc_id, line_id, len(stack) - 1 AS depth FROM K""")
def depth_stack(spark, d):
    return domain.depth_stack(law.lines(spark, d))


# --- boxes and tables ----------------------------------------------------------------------------


@query(Q + """, N AS (SELECT *, coalesce((abs(y - lag(y) OVER (PARTITION BY doc_id ORDER BY line_id)) > 15)::INT, 0) AS new FROM Q), R AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_id)::BIGINT AS row_id FROM N)
    SELECT doc_id AS table_id, line_id AS ord, row_id, row_number() OVER (PARTITION BY doc_id, row_id ORDER BY x, line_id) - 1 AS col_id FROM R""")
def box_rows(spark, d):
    boxes = law.lines(spark, d).select(F.col("doc_id").alias("table_id"), F.col("line_id").alias("ord"), "x", "y")
    return tables.rows_of_boxes(boxes).select("table_id", "ord", "row_id", "col_id")


@query("""WITH C AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, l_linenumber % 4 * 100 + l_partkey % 7 AS x, l_suppkey % 3 * 40 + l_partkey % 5 AS y, CASE WHEN l_partkey % 3 = 0 THEN 200 ELSE 100 END AS w, 40 AS h, l_returnflag AS text FROM lineitem),
    S AS (SELECT k, min(w) / 2 AS ex, min(h) / 2 AS ey FROM C GROUP BY k),
    B AS (SELECT DISTINCT k, 'x' AS axis, unnest([x, x + w]) AS b FROM C UNION SELECT DISTINCT k, 'y', unnest([y, y + h]) FROM C),
    L AS (SELECT k, axis, CASE axis WHEN 'x' THEN any_value(ex) ELSE any_value(ey) END AS near, list(b::DOUBLE ORDER BY b) AS bs FROM B JOIN S USING (k) GROUP BY k, axis),
    R AS (SELECT k, axis, bs, list_reduce(list_transform(bs, lambda x: [[x, x, near]]), lambda acc, x: list_append(acc, [x[1][1], CASE WHEN x[1][1] - acc[-1][2] <= x[1][3] THEN acc[-1][2] ELSE x[1][1] END, x[1][3]])) AS r FROM L),
    A AS (SELECT k, axis, u[1] AS b, u[2] AS snap FROM (SELECT k, axis, unnest(r) AS u FROM R)),
    G AS (SELECT k, axis, b, dense_rank() OVER (PARTITION BY k, axis ORDER BY snap) - 1 AS i FROM A),
    P AS (SELECT c.k, c.ord, c.text, l.i AS l, r.i AS r, t.i AS t, b.i AS b FROM C c JOIN G l ON l.k = c.k AND l.axis = 'x' AND l.b = c.x JOIN G r ON r.k = c.k AND r.axis = 'x' AND r.b = c.x + c.w JOIN G t ON t.k = c.k AND t.axis = 'y' AND t.b = c.y JOIN G b ON b.k = c.k AND b.axis = 'y' AND b.b = c.y + c.h),
    E AS (SELECT *, unnest(range(t::BIGINT, b::BIGINT)) AS row_id FROM P), F AS (SELECT *, unnest(range(l::BIGINT, r::BIGINT)) AS col_id FROM E), H AS (SELECT k, row_id, col_id, max(ord) AS ord FROM F GROUP BY ALL),
    Z AS (SELECT x.k, x.row_id, y.col_id FROM (SELECT k, unnest(range(0, max(i)::BIGINT)) AS row_id FROM G WHERE axis = 'y' GROUP BY k) x JOIN (SELECT k, unnest(range(0, max(i)::BIGINT)) AS col_id FROM G WHERE axis = 'x' GROUP BY k) y USING (k))
    SELECT k AS table_id, z.row_id, z.col_id, coalesce(f.text, '') AS text, CASE WHEN f.row_id = t AND f.col_id = l THEN r - l ELSE 1 END::BIGINT AS colspan, CASE WHEN f.row_id = t AND f.col_id = l THEN b - t ELSE 1 END::BIGINT AS rowspan, coalesce(f.row_id > t OR f.col_id > l, false) AS invisible
    FROM Z z LEFT JOIN H h USING (k, row_id, col_id) LEFT JOIN F f USING (k, row_id, col_id, ord)""")
def cell_grid(spark, d):
    from pyspark.sql.window import Window

    k = F.col
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    cells = table(spark, d, "lineitem").select(
        k("l_orderkey").alias("table_id"), ord_.alias("ord"), (k("l_linenumber") % 4 * 100 + k("l_partkey") % 7).alias("x"), (k("l_suppkey") % 3 * 40 + k("l_partkey") % 5).alias("y"),
        F.when(k("l_partkey") % 3 == 0, 200).otherwise(100).alias("width"), F.lit(40).alias("height"), k("l_returnflag").alias("text"),
    )
    return tables.split_cells(cells)


@query("""WITH R AS (SELECT l_orderkey AS table_id, l_linenumber::BIGINT AS row_id, bool_and(l_partkey % 4 <> 0) AS ok FROM lineitem GROUP BY ALL)
    SELECT table_id, coalesce(min(CASE WHEN NOT ok THEN row_id END), max(row_id) + 1) AS n_header FROM R GROUP BY table_id""")
def table_header(spark, d):
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("long").alias("row_id"), (F.col("l_partkey") % 4 != 0).alias("is_attribute"))
    return tables.header_rows(cells)


LINKS = Q + """, OB AS (SELECT doc_id * 100 + line_id AS object_id, doc_id, page_id, x + 5 AS x, y + 12 AS y, width, height FROM Q WHERE label = 'cellar'), LB AS (SELECT * FROM Q WHERE label <> 'cellar'),
    N AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, y, x, line_id) AS pos FROM LB),
    O2 AS (SELECT o.*, (SELECT count(*) FROM LB l WHERE l.doc_id = o.doc_id AND (l.page_id, l.y, l.x) <= (o.page_id, o.y, o.x)) AS before FROM OB o),
    P AS (SELECT o.doc_id, o.object_id, n.line_id, n.pos, o.before, n.page_id = o.page_id AS same, n.page_id = o.page_id - 1 AS previous, least(abs(n.y - o.y - o.height), abs(n.y + n.height - o.y)) / (o.height + 1e-3)
      - CASE WHEN least(n.x + n.width, o.x + o.width) > greatest(n.x, o.x) THEN (least(n.x + n.width, o.x + o.width) - greatest(n.x, o.x)) / n.width ELSE 0 END AS dist FROM O2 o JOIN N n ON n.doc_id = o.doc_id AND n.pos BETWEEN o.before - 4 AND o.before + 5),
    R AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY CASE WHEN same THEN 0 WHEN previous AND pos <= before THEN 1 WHEN pos <= before THEN 2 ELSE 3 END, CASE WHEN same THEN round(dist, 9) ELSE abs(pos - before) END, pos) AS r FROM P)
    SELECT doc_id, object_id, line_id FROM R WHERE r = 1"""


@query(LINKS)
def link_objects(spark, d):
    rows = law.lines(spark, d)
    objects = rows.where("label = 'cellar'").select((F.col("doc_id") * 100 + F.col("line_id")).alias("object_id"), "doc_id", "page_id", (F.col("x") + 5).alias("x"), (F.col("y") + 12).alias("y"), "width", "height")
    return layout.link_objects(objects, rows.where("label <> 'cellar'"))


@query(Q + " SELECT doc_id, line_id, page_id FROM Q WHERE page_id BETWEEN 1 AND 1")
def page_slice(spark, d):
    return layout.page_slice(law.lines(spark, d), "2:2").select("doc_id", "line_id", "page_id")


@query(Q + """, M AS (SELECT doc_id, page_id, line_id FROM Q WHERE page_id = 0 AND label <> 'cellar' UNION ALL SELECT doc_id, page_id, line_id FROM Q WHERE page_id > 0)
    SELECT doc_id, page_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, line_id) - 1 AS line_id FROM M""")
def merge_first_page(spark, d):
    rows = law.lines(spark, d)
    cols = ["doc_id", "page_id", "line_id"]
    return layout.merge_first_page(rows.where("label <> 'cellar'").select(*cols), rows.select(*cols))


#: Tags of pages as lines; eight pages are a document of more than 6 pages, its last ones one of fewer.
PAGE_SLOTS = """WITH P AS (SELECT page_id // 8 * 2 + (page_id % 8 > 6)::INT AS doc_id, page_id % 8 AS page_id, regexp_replace(t, '[^ -~]', '~', 'g') AS text, i AS line_id FROM (SELECT page_id, unnest(string_split(html, '><')) AS t, unnest(range(0, len(string_split(html, '><')))) AS i FROM pages)),
    A AS (SELECT doc_id, page_id, line_id, regexp_replace(text, '[0-9]', '@', 'g') AS pattern, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY line_id) AS a, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY line_id DESC) AS b, count(*) OVER (PARTITION BY doc_id, page_id) AS n FROM P),
    R AS (SELECT doc_id, page_id, line_id, pattern, 'h' || a AS slot, a AS k FROM A WHERE a <= 4 AND n >= 8 UNION ALL SELECT doc_id, page_id, line_id, pattern, 'f' || b, b FROM A WHERE b <= 4 AND n >= 8),
    E AS (SELECT doc_id, CASE WHEN count(DISTINCT page_id) > 6 THEN 2 ELSE 1 END AS step, CASE WHEN count(DISTINCT page_id) > 6 THEN 0.4 ELSE 0.7 END AS share FROM P GROUP BY 1),
    S AS (SELECT r.doc_id, r.slot, round(avg([1.0, 1.0, 0.85, 0.75][r.k]::DOUBLE * (1 - levenshtein(r.pattern, n.pattern)::DOUBLE / greatest(length(r.pattern), length(n.pattern), 1))), 6) AS score, count(*) AS n_pairs FROM R r JOIN E e USING (doc_id) JOIN R n ON n.doc_id = r.doc_id AND n.slot = r.slot AND n.page_id = r.page_id + e.step GROUP BY ALL),
    O AS (SELECT doc_id, slot, pattern, count(*) AS n_pages, sum(count(*)) OVER (PARTITION BY doc_id, slot) AS total FROM R JOIN S USING (doc_id, slot) WHERE score > 0.5 GROUP BY doc_id, slot, pattern), F AS (SELECT * FROM O JOIN E USING (doc_id) WHERE n_pages > share * total)"""


def page_lines(spark, d):
    plain = F.regexp_replace("html", "[^ -~]", "~")  # SQL's distance counts bytes
    k = F.col("page_id")
    return table(spark, d, "pages").select((F.floor(k / 8) * 2 + (k % 8 > 6).cast("int")).alias("doc_id"), (k % 8).alias("page_id"), F.posexplode(F.split(plain, "><")).alias("line_id", "text"))


@query(PAGE_SLOTS + " SELECT * FROM S WHERE score > 0.5")
def repeated_ends(spark, d):
    return layout.repeated_ends(page_lines(spark, d))


@query(PAGE_SLOTS + " SELECT doc_id, slot, pattern, n_pages FROM F")
def header_footer_popular(spark, d):
    return layout.popular_ends(page_lines(spark, d))


@query(PAGE_SLOTS + " SELECT P.doc_id, P.page_id, P.line_id FROM P WHERE NOT EXISTS (SELECT 1 FROM R JOIN F USING (doc_id, slot, pattern) WHERE R.doc_id = P.doc_id AND R.page_id = P.page_id AND R.line_id = P.line_id)")
def header_footer_removed(spark, d):
    return layout.without_ends(page_lines(spark, d)).select("doc_id", "page_id", F.col("line_id").cast("long").alias("line_id"))


@query("""WITH C AS (SELECT o_custkey AS doc_id, (o_orderkey % 5)::BIGINT AS page_id, (o_orderkey // 5)::BIGINT AS row_id, o_orderpriority AS text, o_orderkey % 10 < 2 AS head FROM orders), W AS (SELECT doc_id, page_id, 200.0 + (doc_id * page_id % 4) * 3 AS width, [100.0 + doc_id * page_id % 3 * 6, 100.0] AS widths FROM C GROUP BY ALL),
    N AS (SELECT *, CASE WHEN page_id = lag(page_id) OVER w + 1 AND abs(width - lag(width) OVER w) <= 0.03 * lag(width) OVER w AND abs(widths[1] - lag(widths[1]) OVER w) <= greatest(4, 0.1 * lag(widths[1]) OVER w) THEN 0 ELSE 1 END AS new FROM W WINDOW w AS (PARTITION BY doc_id ORDER BY page_id)),
    H AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page_id)::BIGINT AS chain FROM N), T AS (SELECT doc_id, page_id, row_id, bool_and(head) AS head, string_agg(text, chr(9) ORDER BY text) AS text FROM C GROUP BY ALL),
    J AS (SELECT T.*, chain, first_value(page_id) OVER (PARTITION BY doc_id, chain, text, head ORDER BY page_id, row_id) AS first FROM T JOIN H USING (doc_id, page_id))
    SELECT doc_id, chain, page_id, row_number() OVER (PARTITION BY doc_id, chain ORDER BY page_id, row_id) - 1 AS row_id, text FROM J WHERE NOT head OR page_id = first""")
def table_rows_merged(spark, d):
    k = F.col
    cells = table(spark, d, "orders").select(k("o_custkey").alias("doc_id"), (k("o_orderkey") % 5).alias("page_id"), F.floor(k("o_orderkey") / 5).alias("row_id"), k("o_orderpriority").alias("col_id"), k("o_orderpriority").alias("text"), (k("o_orderkey") % 10 < 2).alias("is_header"))
    pages = cells.select("doc_id", "page_id").distinct().select("*", (200.0 + k("doc_id") * k("page_id") % 4 * 3).alias("width"), F.array(100.0 + k("doc_id") * k("page_id") % 3 * 6, F.lit(100.0)).alias("widths"))
    return layout.merge_tables(cells, pages)


@query(LINKS.replace("SELECT doc_id, object_id, line_id FROM R WHERE r = 1", "SELECT R.doc_id, R.line_id, 'table' AS name, 'table_' || object_id AS value, 0::BIGINT AS start, length(text) AS \"end\" FROM R JOIN Q ON Q.doc_id = R.doc_id AND Q.line_id = R.line_id WHERE r = 1"))
def table_annotations(spark, d):
    return layout.table_notes(link_objects(spark, d), law.lines(spark, d))


# --- labelling and output ----------------------------------------------------------------------------


@query(Q + " SELECT doc_id, line_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_id, line_id) - 1) // 2 AS task_id FROM Q")
def label_tasks(spark, d):
    return labeling.tasks(law.lines(spark, d), 2).select("doc_id", "line_id", "task_id")


@query(Q + " SELECT doc_id, line_id FROM Q WHERE page_id < 2 OR (doc_id, page_id) IN (SELECT doc_id, page_id FROM Q WHERE label = 'title')")
def toc_pages(spark, d):
    return labeling.toc_pages(law.lines(spark, d).withColumn("is_toc", F.col("label") == "title")).select("doc_id", "line_id")


@query(Q + """, U AS (SELECT doc_id, line_id, md5(doc_id || '_' || line_id % 4) AS uid, label FROM Q) SELECT u.doc_id, u.line_id, m.label FROM U u JOIN (SELECT uid, min(label) AS label FROM U WHERE line_id % 2 = 0 GROUP BY uid) m USING (uid)""")
def label_transfer(spark, d):
    uid = catalog.T.uid(F.col("doc_id"), F.col("line_id") % 4)
    rows = law.lines(spark, d).select("doc_id", "line_id", uid.alias("uid"), "label")
    return labeling.transfer(rows.drop("label"), rows.where("line_id % 2 = 0")).select("doc_id", "line_id", "label")


@query("WITH C AS (" + SQL["toc_align"] + """), M AS (SELECT round(coalesce(matched::DOUBLE / nullif(matched + added + mismatched, 0), 0), 6) AS p, round(coalesce(matched::DOUBLE / nullif(matched + missed + mismatched, 0), 0), 6) AS r FROM C),
    N AS (SELECT p, r, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f FROM M) SELECT count(*) AS n_docs, round(avg(p), 6) AS mean_precision, round(stddev_pop(p), 6) AS std_precision, round(avg(r), 6) AS mean_recall, round(stddev_pop(r), 6) AS std_recall, round(avg(f), 6) AS mean_f1, round(stddev_pop(f), 6) AS std_f1 FROM N""")
def toc_averages(spark, d):
    return labeling.averages(catalog.toc_align(spark, d))


@query("""SELECT event_type AS dataset, count(*) AS n_files, round(sum(value), 4) AS total_seconds, round(sum(value) / count(*), 6) AS seconds_per_file, round(sum(value) / sum(event_id % 5 + 1), 6) AS seconds_per_page, round(sum(value) / count(*) * 1.366, 6) AS normalised FROM events GROUP BY 1""")
def timing_report(spark, d):
    runs = table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("value").alias("seconds"), (F.col("event_id") % 5 + 1).alias("pages"))
    return labeling.timing(runs, 1.366)


@query("WITH " + catalog.DOC_LINES + " SELECT doc_id, line_id, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM D")
def line_offsets(spark, d):
    return catalog.doc_lines(spark, d).select("doc_id", "line_id", lines.offsets("text", 1).alias("offset"))


@query(catalog.TREE + " SELECT doc_id, node, '<p>' || repeat('&nbsp;', (4 * depth)::INT) || '<b>' || node_id || ' ' || line_type || '</b> ' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' AS html FROM T")
def tree_html(spark, d):
    return render.html_rows(tree.build_tree(structured.levelled(spark, d)))


@query(catalog.TREE + """ SELECT doc_id, node, to_json({'node_id': node_id, 'text': text, 'metadata': {'paragraph_type': line_type, 'n_lines': n_lines}})::VARCHAR AS json FROM T""")
def tree_json(spark, d):
    return render.json_nodes(tree.build_tree(structured.levelled(spark, d)))
