"""All queries of the library's operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import annotations, evaluation, features, layout, lines, patterns, relational, tree
from .plans import structured
from .registry import QUERIES, SQL, query  # noqa: F401
from .session import table
from .sources import readers
from .streaming import windows

def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.split_lines(docs(spark, d)).withColumn("line_id", F.col("line_id").cast("long"))


DOC_LINES = "D AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line_id FROM documents)"
S, TREE = "WITH " + structured.SQL, "WITH RECURSIVE " + structured.TREE_SQL


# --- lines -----------------------------------------------------------------------------


@query(f"WITH {DOC_LINES} SELECT doc_id, line_id, text, md5(doc_id || '_' || line_id) AS uid FROM D")
def line_split(spark, d):
    return doc_lines(spark, d).withColumn("uid", T.uid(F.col("doc_id"), F.col("line_id")))


@query(f"""WITH {DOC_LINES}, E AS (SELECT doc_id, line_id, CASE WHEN line_id % 5 = 3 THEN '' WHEN line_id % 3 = 1 THEN chr(9) || '  ' || text ELSE text END AS text FROM D),
    F AS (SELECT *, trim(replace(text, chr(9), ' ')) = '' AS blank, len(regexp_extract(text, '^[ \\t]*')) AS n, len(regexp_replace(regexp_extract(text, '^[ \\t]*'), '[^\\t]', '', 'g')) AS tabs FROM E),
    G AS (SELECT *, coalesce(max(CASE WHEN NOT blank THEN line_id END) OVER (PARTITION BY doc_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM F),
    H AS (SELECT *, n + 3 * tabs AS width FROM G WHERE NOT blank)
    SELECT doc_id, line_id, text, ((n + 2 * tabs) * 211)::BIGINT AS indentation, (greatest(0.5, line_id - before - 1) * 100)::BIGINT AS spacing,
      width - coalesce(lag(width) OVER (PARTITION BY doc_id ORDER BY line_id), 0) < 2 AS can_be_multiline FROM H""")
def line_layout(spark, d):
    made = F.when(F.col("line_id") % 5 == 3, "").when(F.col("line_id") % 3 == 1, F.concat(F.lit("\t  "), "text")).otherwise(F.col("text"))
    return lines.with_layout(doc_lines(spark, d).withColumn("text", made))


@query(f"""WITH {DOC_LINES} SELECT doc_id, line_id, 0 AS part, CASE WHEN regexp_matches(text, '^[A-Z][a-z]+ ') THEN regexp_extract(text, '^[A-Z][a-z]+ ') ELSE text END AS text FROM D
    UNION ALL SELECT doc_id, line_id, 1, substr(text, len(regexp_extract(text, '^[A-Z][a-z]+ ')) + 1) FROM D WHERE regexp_matches(text, '^[A-Z][a-z]+ ') AND len(text) > len(regexp_extract(text, '^[A-Z][a-z]+ '))""")
def line_post_split(spark, d):
    return lines.head_and_rest(doc_lines(spark, d), "[A-Z][a-z]+ ")


@query("""WITH c AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM c) SELECT conv_id, run, role, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_rows FROM r GROUP BY conv_id, run, role""")
def merge_runs(spark, d):
    return lines.merge_runs(table(spark, d, "conversations"), "conv_id", "turn", "role")


# --- patterns and trees ------------------------------------------------------------------


@query(S + " SELECT doc_id, line_id, text, line_type, level_1, level_2, can_be_multiline FROM L")
def pattern_levels(spark, d):
    return structured.levelled(spark, d).select("doc_id", "line_id", "text", "line_type", "level_1", "level_2", "can_be_multiline")


@query("""SELECT p_partkey AS doc_id, 0::BIGINT AS line_id, CASE WHEN starts_with(lower(p_type), 'small') THEN 'small_part' WHEN regexp_matches(lower(p_type), '^(large|medium) [a-z]+') THEN 'big_part' ELSE 'raw_text' END AS line_type,
    CASE WHEN starts_with(lower(p_type), 'small') THEN 1 WHEN regexp_matches(lower(p_type), '^(large|medium) [a-z]+') THEN 2 END::DOUBLE AS level_1 FROM part""")
def pattern_custom(spark, d):
    own = patterns.parse_patterns("[{'name': 'start_word', 'start_word': 'Small', 'line_type': 'small_part', 'level_1': 1, 'level_2': 1}, {'name': 'regexp', 'regexp': '(large|medium) [a-z]+', 'line_type': 'big_part', 'level_1': 2, 'level_2': 1}]")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).cast("long").alias("line_id"), F.col("p_type").alias("text"))
    return patterns.assign_levels(rows, own).select("doc_id", "line_id", "line_type", "level_1")


@query(TREE + " SELECT doc_id, line_id, level_1, level_2 FROM N")
def list_insert(spark, d):
    return tree.insert_lists(structured.levelled(spark, d))


@query(TREE + " SELECT * FROM T")
def tree_nodes(spark, d):
    return tree.build_tree(structured.levelled(spark, d))


@query(TREE + " SELECT doc_id, node, parent FROM T")
def tree_parent(spark, d):
    return tree.parents(tree.build_tree(structured.levelled(spark, d)))


@query(TREE + """ SELECT doc_id, count(*) AS n_nodes, max(depth) AS max_depth, count(*) FILTER (line_type = 'header') AS n_header, count(*) FILTER (line_type = 'list') AS n_list,
    count(*) FILTER (line_type = 'list_item') AS n_list_item, count(*) FILTER (line_type = 'raw_text') AS n_raw_text FROM T GROUP BY doc_id""")
def tree_depth_stats(spark, d):
    return tree.depth_stats(tree.build_tree(structured.levelled(spark, d)))


@query(TREE + " SELECT doc_id, string_agg(text, chr(10) ORDER BY node) AS text FROM T GROUP BY doc_id")
def text_render(spark, d):
    return tree.render(tree.build_tree(structured.levelled(spark, d)))


@query(S + " SELECT doc_id, '0.' || line_id AS node_id, text FROM L UNION ALL SELECT DISTINCT doc_id, '0', '' FROM L")
def linear_nodes(spark, d):
    return tree.linear(structured.lines(spark, d))


@query(f"WITH {DOC_LINES} SELECT doc_id, 0::BIGINT AS node, string_agg(text, '' ORDER BY line_id) AS text, count(*) AS n_lines FROM D WHERE line_id % 7 = 0 GROUP BY doc_id")
def doc_name_root(spark, d):
    zero = F.when(F.col("line_id") % 7 == 0, 0.0).cast("double")
    named = doc_lines(spark, d).withColumns({"line_type": F.lit("raw_text"), "level_1": zero, "level_2": zero, "can_be_multiline": F.lit(True)})
    return tree.build_tree(named).where("node = 0").select("doc_id", "node", "text", "n_lines")


# --- annotations -------------------------------------------------------------------------

SPANS = "A AS (SELECT l_orderkey AS doc_id, l_returnflag AS name, (l_partkey % 60)::BIGINT AS start, (l_partkey % 60 + 1 + l_quantity)::BIGINT AS \"end\" FROM lineitem)"


def spans(spark, d):
    li = table(spark, d, "lineitem")
    start = (F.col("l_partkey") % 60).cast("long")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("name"), start.alias("start"), F.rint(start + 1 + F.col("l_quantity")).cast("long").alias("end"))


@query(f"""WITH {SPANS}, B AS (SELECT *, max("end") OVER (PARTITION BY doc_id, name ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM A),
    C AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, name ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM B)
    SELECT doc_id, name, min(start) AS start, max("end") AS "end", count(*) AS n_merged FROM C GROUP BY doc_id, name, island""")
def annotation_merge(spark, d):
    return annotations.merge(spans(spark, d), ["doc_id", "name"])


@query(f"""WITH RECURSIVE {SPANS}, N AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY start, "end") AS i FROM A),
    K AS (SELECT doc_id, name, i, start, "end", "end" AS reach, true AS ok FROM N WHERE i = 1
      UNION ALL SELECT n.doc_id, n.name, n.i, n.start, n."end", CASE WHEN n.start >= k.reach THEN n."end" ELSE k.reach END, n.start >= k.reach FROM K k JOIN N n ON n.doc_id = k.doc_id AND n.name = k.name AND n.i = k.i + 1)
    SELECT doc_id, name, start, "end" FROM K WHERE ok""")
def annotation_conflict(spark, d):
    return annotations.keep_first(spans(spark, d), ["doc_id", "name"])


@query(f"""WITH {SPANS} SELECT doc_id, name, greatest(0, start - 10) AS start, least("end", 40) - 10 AS "end", count(*) AS n FROM A WHERE "end" > 10 AND start < 40 GROUP BY ALL""")
def annotation_clip(spark, d):
    one = F.array(F.struct("start", "end", "name", F.lit("True").alias("value")))
    cut = spans(spark, d).select("doc_id", F.explode(lines.clip(one, 10, 40)).alias("a"))
    return cut.groupBy("doc_id", F.col("a.name").alias("name"), F.col("a.start").alias("start"), F.col("a.end").alias("end")).agg(F.count("*").alias("n"))


@query(f"""WITH {SPANS} SELECT a.doc_id, a.name, a.start, a."end" FROM A a WHERE a.name = 'N' AND NOT EXISTS (SELECT 1 FROM A b WHERE b.name = 'R' AND b.doc_id = a.doc_id AND a.start < b."end" AND b.start < a."end")""")
def overlap_join(spark, d):
    s = spans(spark, d)
    return annotations.overlaps(s.where("name = 'N'"), s.where("name = 'R'"), ["doc_id"])


# --- features ----------------------------------------------------------------------------


@query(S + """ SELECT doc_id, line_id, size, """ + ", ".join(f"lag(size, {k}, 0.0) OVER w AS size_prev_{k}, lead(size, {k}, 0.0) OVER w AS size_next_{k}" for k in (1, 2, 3)) + " FROM L WINDOW w AS (PARTITION BY doc_id ORDER BY line_id)")
def prev_next_features(spark, d):
    return features.shifted(structured.lines(spark, d), ["size"], 3)


@query(S + """ SELECT doc_id, line_id, round((rank() OVER (PARTITION BY doc_id ORDER BY size) - 1 + count(*) OVER (PARTITION BY doc_id, size) / 2) / count(*) OVER (PARTITION BY doc_id), 6) AS quantile,
    round(CASE WHEN max(size) OVER w = min(size) OVER w THEN 0.0 ELSE (size - avg(size) OVER w) / (max(size) OVER w - min(size) OVER w) END, 6) AS centred FROM L WINDOW w AS (PARTITION BY doc_id)""")
def line_norms(spark, d):
    return structured.lines(spark, d).select("doc_id", "line_id", features.quantile("size").alias("quantile"), features.centred("size").alias("centred"))


@query(S + """, W AS (SELECT doc_id, line_id, size, stddev_pop(size) OVER f AS std, list(size) OVER f AS near FROM L WINDOW f AS (PARTITION BY doc_id ORDER BY line_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
    SELECT doc_id, line_id, round(std, 6) AS std, len(list_filter(near, lambda v: abs(v - size) <= 0.1 * std + 1)) AS n_same FROM W""")
def list_window(spark, d):
    std, near = features.same_indent("size", 10)
    return structured.lines(spark, d).withColumn("std", std).withColumn("n_same", near.cast("long")).select("doc_id", "line_id", F.round("std", 6).alias("std"), "n_same")


@query(S + """, M AS (SELECT doc_id, line_id, number - coalesce(lag(number) OVER (PARTITION BY doc_id ORDER BY line_id), 0) AS step FROM L WHERE line_type = 'list_item')
    SELECT L.doc_id, L.line_id, coalesce(CASE WHEN step = 1 THEN 1 WHEN step IS NOT NULL THEN -1 END, 0)::BIGINT AS continues FROM L LEFT JOIN M USING (doc_id, line_id)""")
def list_continuity(spark, d):
    rows = structured.levelled(spark, d).withColumn("number", F.when(F.col("line_type") == "list_item", F.col("number")))
    return features.list_continuity(rows)


@query(S + """ SELECT doc_id, line_id, coalesce(line_id - min(CASE WHEN line_type = 'header' THEN line_id END) OVER (PARTITION BY doc_id), 0)::BIGINT AS distance,
    last_value(CASE WHEN line_type = 'header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS chapter,
    CASE WHEN bool_or(line_type = 'raw_text') OVER w THEN 'cellar' WHEN bool_or(line_type = 'header') OVER w THEN 'body' ELSE 'header' END AS segment FROM L WINDOW w AS (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING)""")
def line_context(spark, d):
    head = F.col("line_type") == "header"
    return structured.levelled(spark, d).select("doc_id", "line_id", features.distance_to_first(head).alias("distance"), features.carry_forward(F.when(head, F.col("text"))).alias("chapter"), features.segments(head, F.col("line_type") == "raw_text").alias("segment"))


@query(r"""WITH q AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda x: x <> '') AS w, length(text) AS n FROM documents)
    SELECT doc_id, n AS n_chars, round(coalesce((n - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::DOUBLE / nullif(n, 0), 0), 6) AS latin_share, round(coalesce((n - length(regexp_replace(text, '[A-Z]', '', 'g')))::DOUBLE / nullif(n, 0), 0), 6) AS upper_share,
      round(coalesce((n - length(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE / nullif(n, 0), 0), 6) AS digit_share, round(coalesce((n - length(regexp_replace(text, '[{}\[\]()]', '', 'g')))::DOUBLE / nullif(n, 0), 0), 6) AS bracket_share,
      round(coalesce((n - length(regexp_replace(text, '[ \n]', '', 'g')))::DOUBLE / nullif(n, 0), 0), 6) AS blank_share, round(coalesce((n - length(regexp_replace(text, '[!-/:-@]', '', 'g')))::DOUBLE / nullif(n, 0), 0), 6) AS sign_share,
      len(w)::BIGINT AS n_words, round(list_avg(list_transform(w, lambda x: length(x))), 6) AS mean_word, coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS longest_word,
      round(list_median(list_transform(w, lambda x: length(x))), 6) AS median_word, round(list_avg(c), 6) AS mean_code, round(list_stddev_pop(c), 6) AS std_code, round(list_median(c), 6) AS median_code,
      len(list_filter(c, lambda x: x = 33 OR x BETWEEN 35 AND 38 OR x = 42 OR x = 60 OR x = 62 OR x BETWEEN 123 AND 126))::BIGINT AS n_trash FROM (SELECT *, list_transform(string_split(text, ''), lambda c: unicode(c)) AS c FROM q)""")
def text_quality(spark, d):
    return features.text_quality(docs(spark, d))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[a-z]+[A-Z]'))::BIGINT AS case_changes, len(regexp_extract_all(text, '[A-Za-z]+[0-9]'))::BIGINT AS digit_changes, len(regexp_extract_all(text, '[A-Za-z]+[!-/:-@]'))::BIGINT AS sign_changes FROM documents""")
def symbol_transitions(spark, d):
    return docs(spark, d).select("doc_id", *features.transitions())


@query(r"""WITH L AS (SELECT (p_partkey // 12)::BIGINT AS doc_id, (p_partkey % 12)::BIGINT AS line_id, p_name || ' ..... ' || CASE WHEN p_partkey % 97 = 5 THEN 1 ELSE p_partkey % 12 + 10 END || CASE WHEN p_partkey % 5 = 0 THEN ' x' ELSE '' END AS text FROM part),
    I AS (SELECT doc_id, line_id, regexp_extract(text, '(\d{1,3})$', 1)::BIGINT AS page FROM L WHERE regexp_matches(text, '\.\.\.\.\. \d{1,3}$')),
    J AS (SELECT *, coalesce(page < lag(page) OVER (PARTITION BY doc_id ORDER BY line_id), false) AS falls FROM I)
    SELECT doc_id, line_id, page, count(*) OVER (PARTITION BY doc_id) > 6 AND NOT bool_or(falls) OVER (PARTITION BY doc_id) AS is_toc FROM J""")
def toc_lines(spark, d):
    k = F.col("p_partkey")
    text = F.concat("p_name", F.lit(" ..... "), F.when(k % 97 == 5, 1).otherwise(k % 12 + 10).cast("string"), F.when(k % 5 == 0, " x").otherwise(""))
    rows = table(spark, d, "part").select(F.floor(k / 12).alias("doc_id"), (k % 12).alias("line_id"), text.alias("text"))
    return features.toc(rows)


# --- layout and tables ---------------------------------------------------------------------

PAGE_LINES = "P AS (SELECT page_id, unnest(string_split(html, '><')) AS text, unnest(range(0, len(string_split(html, '><')))) AS line_id FROM pages)"


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS linked FROM events""")
def asof_link(spark, d):
    return layout.as_of(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type = 'view'", "event_id").select("event_id", "user_id", "linked")


@query("""WITH C AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS row_id, l_partkey % 5 AS col_id, l_returnflag AS text, l_partkey % 3 + 1 AS colspan, l_suppkey % 2 + 1 AS rowspan FROM lineitem)
    SELECT doc_id, row_id + dr AS row_id, col_id + dc AS col_id, text, dr > 0 OR dc > 0 AS invisible FROM (SELECT *, unnest(range(0, rowspan)) AS dr FROM C) , LATERAL (SELECT unnest(range(0, colspan)) AS dc)""")
def span_expand(spark, d):
    k = F.col
    cells = table(spark, d, "lineitem").select(k("l_orderkey").alias("doc_id"), k("l_linenumber").alias("row_id"), (k("l_partkey") % 5).alias("col_id"), k("l_returnflag").alias("text"), (k("l_partkey") % 3 + 1).alias("colspan"), (k("l_suppkey") % 2 + 1).alias("rowspan"))
    return layout.expand_spans(cells)


@query("""WITH T AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + o_custkey % 2 * (o_orderkey % 2) AS page_id, 100 + o_orderkey % 5 AS width, o_orderkey % 2 AS n_cols, 1::BIGINT AS n_rows, o_orderkey FROM orders),
    U AS (SELECT doc_id, page_id, min(width) AS width, min(n_cols) AS n_cols, sum(n_rows) AS n_rows FROM T GROUP BY ALL),
    V AS (SELECT *, CASE WHEN page_id = lag(page_id) OVER w + 1 AND n_cols = lag(n_cols) OVER w AND abs(width - lag(width) OVER w) <= 0.03 * lag(width) OVER w THEN 0 ELSE 1 END AS new FROM U WINDOW w AS (PARTITION BY doc_id ORDER BY page_id)),
    X AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page_id) AS chain FROM V)
    SELECT doc_id, min(page_id) AS first_page, max(page_id) AS last_page, sum(n_rows)::BIGINT AS n_rows FROM X GROUP BY doc_id, chain""")
def table_merge_multipage(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = F.col
    t = table(spark, d, "orders").select(k("o_custkey").alias("doc_id"), (F.row_number().over(w) + k("o_custkey") % 2 * (k("o_orderkey") % 2)).cast("long").alias("page_id"), (100 + k("o_orderkey") % 5).alias("width"), (k("o_orderkey") % 2).alias("n_cols"))
    return layout.merge_pages(t.groupBy("doc_id", "page_id").agg(F.min("width").alias("width"), F.min("n_cols").alias("n_cols"), F.count("*").alias("n_rows")))


@query("""SELECT l_orderkey AS page_num, (l_linenumber % 3)::BIGINT AS line_num, string_agg(l_returnflag || l_partkey, ' ' ORDER BY l_partkey, l_returnflag || l_partkey) AS text, count(*) AS n_words FROM lineitem WHERE l_quantity >= 20 GROUP BY ALL""")
def ocr_lines(spark, d):
    k = F.col
    words = table(spark, d, "lineitem").select(k("l_orderkey").alias("page_num"), (k("l_linenumber") % 3).cast("long").alias("line_num"), k("l_partkey").alias("word_num"), F.concat("l_returnflag", k("l_partkey").cast("string")).alias("text"), (k("l_quantity") * 2).alias("conf"))
    return layout.ocr_lines(words)


# --- labels, joins and evaluation -----------------------------------------------------------


def predicted(spark, d):
    bad = F.regexp_count("text", F.lit(r"[#*$%&|<>]")) * 10 > F.size(F.split("text", " "))
    return table(spark, d, "labels").join(docs(spark, d), "doc_id").select("doc_id", F.col("quality").cast("long").alias("label"), F.when(bad, 0).otherwise(1).cast("long").alias("pred"))


PRED = r"X AS (SELECT doc_id, quality::BIGINT AS label, CASE WHEN len(regexp_extract_all(text, '[#*$%&|<>]')) * 10 > len(string_split(text, ' ')) THEN 0 ELSE 1 END::BIGINT AS pred FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {PRED} SELECT * FROM X")
def uid_join(spark, d):
    return predicted(spark, d)


@query("SELECT doc_id, lang, quality::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_join(spark, d):
    return docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", F.col("quality").cast("long").alias("quality"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(spark, d):
    return docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, d):
    return docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query(f"WITH {PRED} SELECT label, pred, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM X WHERE label <> pred GROUP BY ALL")
def error_pairs(spark, d):
    return evaluation.errors(predicted(spark, d), "label", "pred")


@query(f"""WITH {PRED}, Y AS (SELECT label, 1 AS t, 0 AS p, (label = pred)::INT AS tp FROM X UNION ALL SELECT pred, 0, 1, 0 FROM X)
    SELECT label, round(coalesce(sum(tp)::DOUBLE / nullif(sum(p), 0), 0), 6) AS precision, round(coalesce(sum(tp)::DOUBLE / nullif(sum(t), 0), 0), 6) AS recall, round(coalesce(2 * sum(tp)::DOUBLE / nullif(sum(t) + sum(p), 0), 0), 6) AS f1 FROM Y GROUP BY label""")
def prf1(spark, d):
    return evaluation.scores(predicted(spark, d), "label", "pred")


@query(f"""WITH {PRED}, K AS (SELECT ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 AS fold, avg((label = pred)::INT) AS accuracy, count(*) AS n FROM X GROUP BY 1)
    SELECT fold, n, round(accuracy, 6) AS accuracy, round(avg(accuracy) OVER (), 6) AS mean_accuracy FROM K""")
def kfold_mean(spark, d):
    per = predicted(spark, d).groupBy(evaluation.fold("doc_id", 10).alias("fold")).agg(F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    return per.select("fold", "n", F.round("accuracy", 6).alias("accuracy"), F.round(F.avg("accuracy").over(Window.partitionBy()), 6).alias("mean_accuracy"))


@query("""WITH A AS (SELECT o_custkey AS doc_id, o_orderkey % 4 AS page, o_orderpriority AS text FROM orders WHERE o_orderkey % 5 <> 0), B AS (SELECT o_custkey AS doc_id, o_orderkey % 4 AS page, CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE o_orderpriority END AS text FROM orders WHERE o_orderkey % 6 <> 0),
    A1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY text) AS k FROM A), B1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY text) AS k FROM B)
    SELECT doc_id, count(*) FILTER (a.text = b.text) AS matched, count(*) FILTER (a.text <> b.text) AS mismatched, count(*) FILTER (b.text IS NULL) AS missed, count(*) FILTER (a.text IS NULL) AS added FROM A1 a FULL JOIN B1 b USING (doc_id, page, k) GROUP BY doc_id""")
def toc_align(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 4).alias("page"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("k"))
    found = o.where("k % 6 <> 0").withColumn("text", F.when(F.col("k") % 7 == 0, "other").otherwise(F.col("text")))
    pairs = evaluation.align(o.where("k % 5 <> 0"), found, ["doc_id", "page"])
    return pairs.groupBy("doc_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("matched", "mismatched", "missed", "added")])


@query(S + """ SELECT a.doc_id, a.line_id, min(b.line_id) AS label_line FROM L a LEFT JOIN L b ON a.doc_id = b.doc_id AND abs(a.line_id - b.line_id) <= 50 AND b.line_id <> a.line_id AND levenshtein(a.text, b.text) <= 1 GROUP BY ALL""")
def range_label_join(spark, d):
    rows = structured.lines(spark, d).select("doc_id", "line_id", "text")
    near = relational.near_join(rows, rows, ["doc_id"], "line_id", 50).where("r_line_id <> line_id").where(F.levenshtein("text", "r_text", 1) >= 0)
    found = near.groupBy("doc_id", "line_id").agg(F.min("r_line_id").alias("label_line"))
    return rows.select("doc_id", "line_id").join(found, ["doc_id", "line_id"], "left")


@query("SELECT doc_id, line_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_chars DESC, line_id) AS r FROM (WITH " + DOC_LINES + " SELECT doc_id, line_id, length(text) AS n_chars FROM D)) WHERE r <= 3")
def topk_per_doc(spark, d):
    w = Window.partitionBy("doc_id").orderBy(F.desc("n_chars"), "line_id")
    rows = doc_lines(spark, d).select("doc_id", "line_id", F.length("text").cast("long").alias("n_chars"))
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS n FROM (SELECT 'document' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages)")
def union_renumber(spark, d):
    both = docs(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")).unionByName(table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id")))
    return both.withColumn("n", (F.row_number().over(Window.partitionBy("kind").orderBy("id")) - 1).cast("long"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, d):
    return docs(spark, d).where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def set_except(spark, d):
    return docs(spark, d).where("lang = 'en'").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_types(spark, d):
    return docs(spark, d).rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def cube_types(spark, d):
    return docs(spark, d).cube("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def grouping_sets(spark, d):
    return docs(spark, d).groupingSets([[F.col("lang")], [F.col("source")]], "lang", "source").agg(F.count("*").alias("n"))


# --- readers ------------------------------------------------------------------------------


@query("SELECT event_id, json_keys(props)[1] AS key, json_extract_string(props, '$.k') AS value, md5(event_id || '_' || props) AS uid FROM events")
def json_walk(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "props", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).select("event_id", "key", "value", T.uid(F.col("event_id"), F.col("props")).alias("uid"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1) AS path FROM pages")
def url_parts(spark, d):
    host, path = T.url_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), path.alias("path"))


@query()
def html_lines(spark, d):
    return readers.html_lines(table(spark, d, "pages"), "page_id", "html")


@query()
def html_tree(spark, d):
    return tree.build_tree(patterns.assign_levels(readers.html_lines(table(spark, d, "pages"), "page_id", "html")))


@query()
def html_annotations(spark, d):
    got = readers.html_lines(table(spark, d, "pages"), "page_id", "html")
    return got.select("doc_id", "line_id", F.explode("annotations").alias("a")).select("doc_id", "line_id", "a.*")


# --- event time --------------------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return windows.tumbling(table(spark, d, "events"))


@query("""SELECT strftime(date_trunc('hour', ts) - to_hours(k), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest(range(0, 2)) AS k) GROUP BY ALL""")
def sliding_counts(spark, d):
    return windows.tumbling(table(spark, d, "events"), "2 hours", "1 hour")


@query("""WITH G AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    H AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM G) SELECT user_id, CASE WHEN microsecond(min(ts)) % 1000000 = 0 THEN strftime(min(ts), '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0') END AS start, count(*) AS n FROM H GROUP BY user_id, s""")
def session_counts(spark, d):
    return windows.sessions(table(spark, d, "events"))


@query()
def stream_tumbling(spark, d):
    from .streaming import files

    return files.event_counts(spark, d)


@query()
def fuzzy_ratio(spark, d):
    """Each benchmark item with the line that is most like it, the first one of equals."""
    return evaluation.nearest_lines(table(spark, d, "benchmark"), doc_lines(spark, d)).select("item_id", "ratio", "doc_id")
