"""Queries on readers: files are rows made of the tables, with a path and their content."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query
from .session import attach, table
from .sources import readers


def files(spark, d, name: str, path: str, content: str):
    return table(attach(spark), d, name).selectExpr(f"{path} AS path", f"CAST({content} AS BINARY) AS content")


_ENDS = "['.docx', '.TXT', '.txt.gz', '.csv', '.html', '.note.json', '.json', '.tar.gz', '.tei.xml', '.mht', '.eml', '.xml', '.bin', '']"
_MIME = "CASE p_size % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' END"


@query(f"""SELECT p_partkey, p_name || {_ENDS}[p_partkey % 14 + 1] AS path, CASE WHEN p_partkey % 14 = 8 THEN 'article' WHEN p_partkey % 14 = 0 THEN 'docx' WHEN p_partkey % 14 IN (1, 2, 11) THEN 'txt' WHEN p_partkey % 14 = 13 AND p_size % 3 = 1 THEN 'txt' WHEN p_partkey % 14 = 3 THEN 'csv'
    WHEN p_partkey % 14 = 4 OR p_size % 3 = 0 THEN 'html' WHEN p_partkey % 14 = 5 THEN 'note' WHEN p_partkey % 14 = 6 THEN 'json' WHEN p_partkey % 14 = 7 THEN 'archive' WHEN p_partkey % 14 = 10 THEN 'eml' WHEN p_partkey % 14 = 9 THEN 'mhtml' END AS kind FROM part""")
def reader_kinds(spark, d):
    ends = F.array(*map(F.lit, [x.strip(" '") for x in _ENDS.strip("[]").split(",")]))
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.element_at(ends, (F.col("p_partkey") % 14 + 1).cast("int"))).alias("path"), F.expr(_MIME).alias("mime"))
    return rows.select("p_partkey", "path", readers.kind_of(F.col("path"), F.col("mime")).alias("kind"))


@query("""WITH P AS (SELECT p_partkey, ['true', 'false', 'auto', 'auto_tabby', 'tabby'][p_partkey % 5 + 1] AS option, p_size % 2 = 0 AS f, p_size % 3 > 0 AS o FROM part)
    SELECT p_partkey, CASE option WHEN 'true' THEN 'text_layer' WHEN 'false' THEN 'image' WHEN 'tabby' THEN 'tabby' ELSE CASE WHEN NOT f THEN 'image' WHEN option = 'auto' THEN 'text_layer' ELSE 'tabby' END END AS first,
      CASE option WHEN 'true' THEN 'text_layer' WHEN 'false' THEN 'image' WHEN 'tabby' THEN 'tabby' ELSE CASE WHEN NOT o THEN 'image' WHEN option = 'auto' THEN 'text_layer' ELSE 'tabby' END END AS others FROM P""")
def pdf_routes(spark, d):
    option = F.element_at(F.array(*map(F.lit, ("true", "false", "auto", "auto_tabby", "tabby"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", readers.pdf_route(option, F.col("p_size") % 2 == 0, F.col("p_size") % 3 > 0).alias("r")).select("p_partkey", "r.*")


@query("""WITH B AS (SELECT l_orderkey AS path, l_linenumber % 2 AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o, l_returnflag || l_partkey || chr(10) || l_suppkey AS text, l_partkey % 2 = 0 AS bold, l_partkey % 5 + 8 AS size FROM lineitem),
    S AS (SELECT path, page_id, o, unnest([0, 1]) AS part, unnest(string_split(text, chr(10))) AS text, bold, size FROM B) SELECT path, page_id, row_number() OVER (PARTITION BY path ORDER BY page_id, o, part) - 1 AS line_id, text, bold, size FROM S""")
def tabby_pages(spark, d):
    from pyspark.sql.window import Window

    k = F.col
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    one = F.struct(k("o").alias("order"), F.concat("l_returnflag", k("l_partkey").cast("string"), F.lit("\n"), k("l_suppkey").cast("string")).alias("text"), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), (k("l_partkey") % 2 == 0).alias("is_bold"), (k("l_partkey") % 5 + 8).alias("font_size"))).alias("annotations"))
    rows = table(spark, d, "lineitem").withColumn("o", F.row_number().over(w)).groupBy(k("l_orderkey").alias("path"), (k("l_linenumber") % 2).alias("number")).agg(F.collect_list(one).alias("blocks"))
    return readers.tabby_lines(rows.groupBy("path").agg(F.to_json(F.struct(F.collect_list(F.struct("number", "blocks")).alias("pages"))).alias("json")))


_TXT = r"replace(replace(text, ', ', ',' || chr(10) || chr(10)), '. ', '.' || chr(10) || '   ')"


@query(f"""WITH D AS (SELECT doc_id, unnest(string_split({_TXT}, chr(10))) AS text, unnest(range(0, len(string_split({_TXT}, chr(10))))) AS i FROM documents WHERE text <> ''),
    E AS (SELECT *, max(CASE WHEN trim(text) <> '' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, length(regexp_extract(text, '^ *')) AS w FROM D),
    F AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_id, w - coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), 0) < 2 AS can_be_multiline FROM E WHERE trim(text) <> '')
    SELECT 'd' || doc_id || '.txt' AS path, line_id, text || chr(10) AS text, can_be_multiline, (greatest(0.5, i - coalesce(before, -1) - 1) * 100)::BIGINT AS spacing, w * 211 AS indentation FROM F""")
def txt_lines(spark, d):
    rows = readers.read_items(files(spark, d, "documents", "'d' || doc_id || '.txt'", _TXT))
    note = lambda n: F.filter("annotations", lambda a: a["name"] == n)[0]["value"].cast("long").alias(n)
    return rows.where("error IS NULL").select("path", "line_id", "text", "can_be_multiline", note("spacing"), note("indentation"))


@query("""SELECT 'e' || event_id || '.json' AS path, k::BIGINT AS line_id, CASE k WHEN 0 THEN 'k' WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN 'list' WHEN 3 THEN event_type ELSE '' END AS text, CASE k WHEN 0 THEN 'key' WHEN 1 THEN 'raw_text' WHEN 2 THEN 'key' ELSE 'list_item' END AS tag_type, CASE WHEN k IN (0, 2) THEN 1.0 ELSE 2.0 END::DOUBLE AS tag_level_1
    FROM events, (SELECT unnest(range(0, 5)) AS k)
    UNION ALL SELECT 'e' || event_id || '.json', 5, 'a', 'key', 3.0 FROM events""")
def json_lines(spark, d):
    content = """concat('{"list": ["', event_type, '", {"a": null}], "k": ', get_json_object(props, '$.k'), ', "page": {"html": "<p>x</p>"}}')"""
    rows = readers.read_items(files(spark, d, "events", "'e' || event_id || '.json'", content), html_fields='[["page", "html"]]')
    return rows.select("path", "line_id", "text", "tag_type", "tag_level_1")


@query("""SELECT 'o' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.csv' ELSE '.tsv' END AS path, r AS row_id, c AS col_id, CASE WHEN r = 0 THEN ['id', 'a,b', ''][c + 1] ELSE [o_orderkey::VARCHAR, 'é "q" ', o_orderpriority][c + 1] END AS text FROM orders, (SELECT unnest(range(0, 2)) AS r), (SELECT unnest(range(0, 3)) AS c)""")
def csv_tables(spark, d):
    sep = "CASE WHEN o_orderkey % 2 = 0 THEN ',' ELSE '\\t' END"
    content = f'''concat('id', {sep}, '"a,b"', {sep}, '\\r\\n', o_orderkey, {sep}, '"é ""q"" "', {sep}, o_orderpriority, '\\n')'''
    return readers.read_cells(files(spark, d, "orders", "'o' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.csv' ELSE '.tsv' END", content)).select("path", "row_id", "col_id", "text")


@query("""SELECT 'c' || conv_id || '_' || turn || '.eml' AS path, k AS line_id, CASE k WHEN 2 THEN role || '@example.org' WHEN 3 THEN 'plain body' ELSE 'Turn ' || turn END AS text, CASE k WHEN 0 THEN 'root' WHEN 1 THEN 'subject' WHEN 2 THEN 'from' END AS tag_type, CASE k WHEN 0 THEN 0.0 WHEN 3 THEN NULL ELSE 1.0 END::DOUBLE AS tag_level_1
    FROM conversations, (SELECT unnest(range(0, 4)) AS k)""")
def mail_lines(spark, d):
    content = "concat('Subject: Turn ', turn, '\\nFrom: ', role, '@example.org\\nContent-Type: text/plain\\n\\nplain body')"
    return readers.read_items(files(spark, d, "conversations", "'c' || conv_id || '_' || turn || '.eml'", content)).select("path", "line_id", "text", "tag_type", "tag_level_1")


_HTML = """concat('<body><h1>', p_name, '</h1><table ', CASE WHEN p_size % 2 = 0 THEN 'border="1"' ELSE '' END, '><tr><td rowspan="2">', p_brand, '</td><td>', p_type, '</td></tr><tr><td style="', CASE WHEN p_size % 3 = 0 THEN 'border-top: 1px solid' ELSE '' END, '">', p_size, '</td></tr></table>',
    '<p style="font-size: 12pt; text-align: end">all of <b>', p_name, '</b></p></body>')"""


@query("""SELECT 'p' || p_partkey || '.html' AS path, r AS row_id, c AS col_id, CASE WHEN c = 0 THEN p_brand WHEN r = 0 THEN p_type ELSE p_size::VARCHAR END AS text, CASE WHEN r = 0 AND c = 0 THEN 2 ELSE 1 END::BIGINT AS rowspan, r = 1 AND c = 0 AS invisible
    FROM part, (SELECT unnest(range(0, 2)) AS r), (SELECT unnest(range(0, 2)) AS c) WHERE p_size % 2 = 0 OR p_size % 3 = 0""")
def html_cells(spark, d):
    return readers.read_cells(files(spark, d, "part", "'p' || p_partkey || '.html'", _HTML)).where("error IS NULL").select("path", "row_id", "col_id", "text", "rowspan", "invisible")


@query("""WITH L AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN 1 ELSE 3 END AS n, p_name FROM part), N AS (SELECT *, 7 + length(p_name) AS len FROM L)
    SELECT 'p' || p_partkey || '.html' AS path, n::BIGINT AS line_id, 'bold' AS name, 'True' AS value, 7::BIGINT AS start, len AS "end" FROM N UNION ALL SELECT 'p' || p_partkey || '.html', n, 'size', '12', 0, len FROM N UNION ALL SELECT 'p' || p_partkey || '.html', n, 'alignment', 'left', 0, len FROM N""")
def html_styles(spark, d):
    rows = readers.read_items(files(spark, d, "part", "'p' || p_partkey || '.html'", _HTML))
    return rows.select("path", "line_id", F.explode("annotations").alias("a")).select("path", "line_id", "a.name", "a.value", "a.start", "a.end")


_TEI = """concat('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>', p_name, '</title></titleStmt></fileDesc></teiHeader><text><body><div><head n="', p_size % 3 + 1, '.2">', p_brand, '</head><p>see <ref target="#b0">[1]</ref> of ', p_type,
    '</p></div></body><back><div><listBibl><biblStruct xml:id="b0"><analytic><title level="a">', p_type, '</title></analytic></biblStruct></listBibl></div></back></text></TEI>')"""


@query("""SELECT 'p' || p_partkey || '.tei.xml' AS path, k AS line_id, CASE k WHEN 0 THEN p_name WHEN 1 THEN (p_size % 3 + 1) || '.2 ' || p_brand WHEN 2 THEN 'see [1] of ' || p_type WHEN 3 THEN 'bibliography' WHEN 4 THEN '' ELSE p_type END AS text, ['root', 'section', 'raw_text', 'bibliography', 'bibliography_item', 'title'][k + 1] AS tag_type,
    [0.0, 1.0, NULL, 1.0, 2.0, 3.0][k + 1]::DOUBLE AS tag_level_1, [0.0, 2.0, NULL, 1.0, 1.0, 1.0][k + 1]::DOUBLE AS tag_level_2, CASE WHEN k = 2 THEN 'reference:4:7:b0' WHEN k = 4 THEN 'bibliography_uid:0:0:b0' ELSE '' END AS notes FROM part, (SELECT unnest(range(0, 6)) AS k)""")
def article_lines(spark, d):
    rows = readers.read_items(files(spark, d, "part", "'p' || p_partkey || '.tei.xml'", _TEI))
    notes = F.array_join(F.transform("annotations", lambda a: F.concat_ws(":", a["name"], a["start"].cast("string"), a["end"].cast("string"), a["value"])), ",")
    return rows.select("path", "line_id", "text", "tag_type", "tag_level_1", "tag_level_2", notes.alias("notes"))


@query("SELECT 'n' || item_id || '.note.json' AS path, text FROM benchmark")
def notes(spark, d):
    return readers.read_items(files(spark, d, "benchmark", "'n' || item_id || '.note.json'", "to_json(named_struct('content', text, 'author', 'a'))")).select("path", "text")
