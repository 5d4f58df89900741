"""Queries on joins by ranges, orders, scalars, streams, plug points and parameters."""

from __future__ import annotations

import difflib

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import catalog, plugins
from .functions import text as T
from .operators import evaluation, labeling, relational
from .options import Options
from .plans import run, structured
from .registry import SQL, query
from .session import attach, table


@query("""SELECT p.event_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND p.event_type = 'purchase' AND v.event_type = 'view' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOUR""")
def interval_join(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    return relational.interval_join(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), views, ["user_id"], "ts", "start", "end", 7200).select("event_id", "view_id")


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents")
def global_sort(spark, d):
    return relational.global_order(catalog.docs(spark, d).select("doc_id", "n_chars"), "n_chars", ["doc_id"])


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def ordered_top(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT event_type, count(DISTINCT user_id) > 0 AS distinct_near, true AS median_near FROM events GROUP BY 1")
def approximate_aggregates(spark, d):
    """Sketches beside exact values: within a tenth (distinct), a hundredth of the ranks (median)."""
    e = table(spark, d, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("b"), F.percentile_approx("value", 0.5, 10_000).alias("m"), F.percentile("value", F.array(F.lit(0.48), F.lit(0.52))).alias("p")
    )
    return e.select("event_type", relational.near_exact(F.col("a"), F.col("b"), 0.1).alias("distinct_near"), F.col("m").between(F.col("p")[0], F.col("p")[1]).alias("median_near"))


_STAMP = "strftime(ts, '%Y%m%d%H%M%S')"


@query(f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(date_trunc('second', ts))::BIGINT - 10800 WHEN 1 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 2 THEN epoch(date_trunc('second', ts))::BIGINT + 5400 ELSE epoch(date_trunc('day', ts))::BIGINT END AS seconds FROM events""")
def pdf_times(spark, d):
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    made = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("D:"), stamp, F.lit("+03'00'"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("D:"), stamp, F.lit("Z00'00'")))
    made = made.when(F.col("event_id") % 4 == 2, F.concat(stamp, F.lit("-0130"))).otherwise(F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd")))
    return table(spark, d, "events").select("event_id", T.pdf_time(made).alias("seconds"))


@query("SELECT page_id, base64(encode(url)) AS encoded, true AS same FROM pages")
def base64_columns(spark, d):
    coded = T.base64_line(F.col("url").cast("binary"))
    return table(spark, d, "pages").select("page_id", coded.alias("encoded"), F.unbase64(coded).cast("string").eqNullSafe(F.col("url")).alias("same"))


@query(r"""WITH P AS (SELECT page_id, 'f' || page_id % 7 || CASE page_id % 3 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.txt' ELSE '' END AS name, repeat('x', (page_id * 9 % 300)::INT) || '.html' AS long FROM pages),
    N AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS k FROM P)
    SELECT page_id, split_part(name, '.', 1) AS stem, substr(name, length(split_part(name, '.', 1)) + 1) AS extension, length(left(long, length(long) - 5)[1:250] || '.html') AS capped, CASE WHEN k = 0 THEN name ELSE split_part(name, '.', 1) || '_' || k || substr(name, length(split_part(name, '.', 1)) + 1) END AS unique_name FROM N""")
def file_names(spark, d):
    k = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("f"), (k % 7).cast("string"), F.when(k % 3 == 0, ".tar.gz").when(k % 3 == 1, ".txt").otherwise("")).alias("name"), F.concat(F.expr("repeat('x', cast(page_id * 9 % 300 AS int))"), F.lit(".html")).alias("long"))
    stem, ext = T.stem_and_extension(F.col("name"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("page_id")) - 1
    rows = rows.withColumn("k", n)
    return rows.select("page_id", stem.alias("stem"), ext.alias("extension"), F.length(T.capped_name(F.col("long"))).cast("long").alias("capped"), F.when(F.col("k") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("k").cast("string"), ext)).alias("unique_name"))


SQL["stream_tumbling"] = """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events
    GROUP BY ALL HAVING time_bucket(INTERVAL 1 DAY, min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


@query("SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1")
def stream_state(spark, d):
    from .streaming import files

    return files.user_counts(spark, d)


@query("SELECT page_id, unnest(range(0, len(string_split(html, '><')))) AS line_id, unnest(string_split(html, '><')) AS text FROM pages")
def table_function(spark, d):
    plugins.register(attach(spark))
    table(spark, d, "pages").createOrReplaceTempView("foliolake_pages")
    return spark.sql("SELECT page_id, x.line_id, x.text FROM foliolake_pages, LATERAL split_lines(html, '><') AS x")


@query("SELECT event_type, round(mad(value), 6) AS deviation FROM events GROUP BY 1")
def own_aggregate(spark, d):
    attach(spark)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(plugins.aggregate()("value"), 6).alias("deviation"))


# --- parameters --------------------------------------------------------------------------------------


@query(structured.SQL.join(["WITH ", " SELECT doc_id, '0' AS node_id, '' AS text FROM L GROUP BY 1 UNION ALL SELECT doc_id, '0.' || line_id, text FROM L"]))
def options_linear(spark, d):
    return run.parse(structured.lines(spark, d), Options.of({"structure_type": "linear", "unknown": 1})).select("doc_id", "node_id", "text")


@query(SQL["text_render"])
def options_plain_text(spark, d):
    return run.render(structured.lines(spark, d), Options.of({"return_format": "plain_text"}))


@query("WITH " + structured.SQL + """, K AS (SELECT *, starts_with(text, 'Chapter') AS c FROM L), G AS (SELECT *, CASE WHEN c OR lag(c) OVER w IS DISTINCT FROM false THEN 1 ELSE 0 END AS new FROM K WINDOW w AS (PARTITION BY doc_id ORDER BY line_id)),
    R AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_id) AS node FROM G) SELECT doc_id, node::BIGINT AS node, CASE WHEN bool_and(c) THEN 'chapter' ELSE 'raw_text' END AS line_type, count(*) AS n_lines FROM R GROUP BY doc_id, node UNION ALL SELECT DISTINCT doc_id, 0, 'root', 0 FROM R""")
def options_patterns(spark, d):
    own = "[{'name': 'start_word', 'start_word': 'chapter', 'line_type': 'chapter', 'level_1': 1, 'level_2': 1, 'can_be_multiline': False}]"
    return run.parse(structured.lines(spark, d), Options.of({"patterns": own})).select("doc_id", "node", "line_type", "n_lines")


# --- labels ------------------------------------------------------------------------------------------


def _texts() -> list[str]:
    """All texts that structured lines have."""
    n = range(1, 8)
    return [*(f"{i}. a" for i in n), *(f"{i}.{m}. b" for i in n for m in range(1, 5)), *(f"{i}) c" for i in n), "a) d", "- e", "v. f", *(f"Chapter {i}" for i in n), *(f"plain {f}" for f in "ANR")]


_ALIKE = ", ".join(f"('{a}', '{b}')" for a in _texts() for b in _texts() if T.indel_ratio(a, b) > 0.8)


@query("WITH " + structured.SQL + f""", V(a, b) AS (VALUES {_ALIKE}) SELECT x.doc_id, x.line_id, min(y.line_id) AS label_line FROM L x LEFT JOIN (SELECT y.*, V.a FROM L y JOIN V ON y.text = V.b WHERE y.line_id % 2 = 1) y ON y.doc_id = x.doc_id AND y.a = x.text AND abs(x.line_id - y.line_id) <= 50 GROUP BY ALL""")
def label_transfer_fuzzy(spark, d):
    rows = structured.lines(spark, d).select("doc_id", "line_id", "text")
    return labeling.transfer_fuzzy(rows, rows.where("line_id % 2 = 1").withColumn("label", F.col("line_id")), 50).select("doc_id", "line_id", F.col("label").alias("label_line"))


_HEADS = [f"{n} {f}" for n in ("flag", "column", "x") for f in "ANR"]
_HEAD_PAIRS = ", ".join(f"('{a}', '{b}', {difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.8})" for a in _HEADS for b in _HEADS)


@query(f"""WITH C AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS col_id, ['flag', 'column', 'x'][l_linenumber % 2 + 1] || ' ' || l_returnflag AS text FROM lineitem),
    V(a, b, ok) AS (VALUES {_HEAD_PAIRS}), N AS (SELECT table_id, count(*) AS n FROM C GROUP BY 1), P AS (SELECT a.table_id, a.n = coalesce(b.n, -1) AS same FROM N a LEFT JOIN N b ON b.table_id = a.table_id + 1),
    J AS (SELECT x.table_id, bool_and(v.ok) AS alike FROM C x JOIN C y ON y.table_id = x.table_id + 1 AND y.col_id = x.col_id JOIN V v ON v.a = x.text AND v.b = y.text GROUP BY 1)
    SELECT table_id, same AND coalesce(alike, false) AS equal_next FROM P LEFT JOIN J USING (table_id)""")
def header_equality(spark, d):
    from .operators import tables

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.lit(0).cast("long").alias("row_id"), (F.row_number().over(w) - 1).cast("long").alias("col_id"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "flag ").otherwise("column "), "l_returnflag").alias("text"))
    return tables.equal_headers(cells)


@query(rf"""WITH {catalog.PRED}, F AS (SELECT *, ((row_number() OVER (ORDER BY doc_id) - 1) * 10 // count(*) OVER ())::BIGINT AS fold FROM X),
    Y AS (SELECT fold, label, count(*) AS support, sum((label = pred)::INT) AS tp FROM F GROUP BY ALL), Z AS (SELECT fold, pred AS label, count(*) AS p FROM F GROUP BY ALL),
    S AS (SELECT y.fold, support, tp / support AS r, coalesce(tp / p, 0) AS pr FROM Y y LEFT JOIN Z z USING (fold, label)), W AS (SELECT fold, sum(support * pr) / sum(support) AS precision, sum(support * r) / sum(support) AS recall, sum(support * CASE WHEN pr + r = 0 THEN 0 ELSE 2 * pr * r / (pr + r) END) / sum(support) AS f1 FROM S GROUP BY fold)
    SELECT fold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM W""")
def kfold_weighted(spark, d):
    return evaluation.weighted_folds(catalog.predicted(spark, d), "doc_id", "label", "pred", 10)


@query("""WITH M AS (SELECT doc_id, quality, CASE quality WHEN 0 THEN 'bad' END AS new FROM labels) SELECT doc_id, md5(doc_id || '_' || source) AS uid, coalesce(new, quality::VARCHAR) AS label, lang AS grp, length(text) AS size FROM documents JOIN M USING (doc_id)""")
def dataset_rows(spark, d):
    features = catalog.docs(spark, d).select("doc_id", "lang", T.uid(F.col("doc_id"), F.col("source")).alias("uid"), F.length("text").cast("long").alias("size"))
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return labeling.assemble(features, labels, {"0": "bad"}, "lang").select("doc_id", "uid", "label", "grp", "size")


@query("""SELECT event_type AS dataset, count(*) AS n_reports, round(avg(1000 + event_id % 7), 6) AS n_chars, round(avg(event_id % 11), 6) AS n_errors, round(avg(90 + event_id % 10 + 0.5), 6) AS accuracy FROM events GROUP BY 1""")
def ocr_report(spark, d):
    k = F.col("event_id")
    text = F.concat(F.lit("UNLV-ISRI OCR Accuracy Report\n  "), (1000 + k % 7).cast("string"), F.lit("   Characters\n  "), (k % 11).cast("string"), F.lit("   Errors\n  "), (90 + k % 10).cast("string"), F.lit(".50%  Accuracy\n"))
    return labeling.report_averages(table(spark, d, "events").select(F.col("event_type").alias("dataset"), text.alias("report")))
