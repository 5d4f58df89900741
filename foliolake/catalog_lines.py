"""Queries on annotations and features of lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import annotations, features, line_features, lines, patterns
from .plans import noted, structured
from .registry import query
from .session import table

Q = "WITH " + noted.SQL
KEYS = ["doc_id", "line_id"]

MERGED = """G AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line_id, name, value) AS n FROM A),
    S AS (SELECT doc_id, line_id, i - 1 AS start, i AS "end" FROM (SELECT doc_id, line_id, text, unnest(range(1, length(text) + 1)) AS i FROM N) WHERE substr(text, i, 1) = ' '),
    U AS (SELECT doc_id, line_id, name, value, start, "end", 1 AS own FROM G WHERE n > 1 AND name <> 'table'
      UNION ALL SELECT k.doc_id, k.line_id, name, value, start, "end", 0 FROM (SELECT DISTINCT doc_id, line_id, name, value FROM G WHERE n > 1 AND name <> 'table') k JOIN S USING (doc_id, line_id)),
    V AS (SELECT *, max("end") OVER (PARTITION BY doc_id, line_id, name, value ORDER BY start, own DESC, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM U),
    W AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_id, name, value ORDER BY start, own DESC, "end" ROWS UNBOUNDED PRECEDING) AS island FROM V),
    M AS (SELECT doc_id, line_id, name, value, min(start) FILTER (own = 1) AS start, max("end") FILTER (own = 1) AS "end" FROM W GROUP BY doc_id, line_id, name, value, island HAVING count(*) FILTER (own = 1) > 0
      UNION ALL SELECT doc_id, line_id, name, value, start, "end" FROM G WHERE n = 1 OR name = 'table')"""


def merged(spark, d):
    return annotations.merge_bridged(noted.spans(spark, d), noted.lines(spark, d), KEYS, ("table",))


@query(f'{Q}, {MERGED} SELECT doc_id, line_id, name, value, start, "end" FROM M')
def annotation_bridges(spark, d):
    return merged(spark, d)


@query(f"""WITH RECURSIVE {noted.SQL}, {MERGED}, R AS (SELECT M.*, text, row_number() OVER (PARTITION BY doc_id, line_id, name ORDER BY start, "end", value) AS i FROM M JOIN N USING (doc_id, line_id) WHERE name <> 'table'),
    K AS (SELECT doc_id, line_id, name, value, start, "end", i, 'add' AS act, start AS ls, "end" AS le FROM R WHERE i = 1
      UNION ALL SELECT doc_id, line_id, name, value, start, "end", i, act, CASE WHEN act = 'skip' THEN ls ELSE start END, CASE WHEN act = 'skip' THEN le ELSE "end" END FROM (
        SELECT r.*, CASE WHEN r.start >= k.le THEN 'add' WHEN substr(r.text, k.ls + 1, 1) = ' ' THEN 'instead' ELSE 'skip' END AS act, k.ls, k.le FROM K k JOIN R r ON r.doc_id = k.doc_id AND r.line_id = k.line_id AND r.name = k.name AND r.i = k.i + 1)),
    L AS (SELECT *, lead(act) OVER (PARTITION BY doc_id, line_id, name ORDER BY i) AS after FROM K WHERE act <> 'skip')
    SELECT doc_id, line_id, name, value, start, "end" FROM L WHERE after IS DISTINCT FROM 'instead' UNION ALL SELECT doc_id, line_id, name, value, start, "end" FROM M WHERE name = 'table'""")
def annotation_resolve(spark, d):
    return annotations.resolve(merged(spark, d), noted.lines(spark, d), KEYS, ("table",))


@query(Q + """ SELECT doc_id, line_id, 'a' AS piece, name, value, CASE WHEN name = 'table' THEN 0 ELSE start END AS start, CASE WHEN name = 'table' THEN 6 ELSE least("end", 6) END AS "end" FROM A WHERE name = 'table' OR start <= 6
    UNION ALL SELECT doc_id, line_id, 'b', name, value, greatest(start, 6) - 6, least("end", 14) - 6 FROM A WHERE name <> 'table' AND "end" > 6 AND start <= 14""")
def annotation_select(spark, d):
    rows = noted.with_spans(spark, d)
    cut = lambda p, a, b: rows.select(*KEYS, F.lit(p).alias("piece"), F.explode(annotations.select(F.col("annotations"), a, b)).alias("x")).select(*KEYS, "piece", "x.name", "x.value", "x.start", "x.end")
    return cut("a", 0, 6).unionByName(cut("b", 6, 14))


@query(Q + r""", H AS (SELECT *, regexp_extract(text, '^\s*\d+[.)]\S*\s*') AS h FROM N), I AS (SELECT *, CASE WHEN regexp_matches(h, '[^\d.)\s]') THEN substr(h, 1, length(regexp_extract(h, '^[\d.)\s]*'))) ELSE h END AS head FROM H)
    SELECT doc_id, line_id, 0 AS part, md5(doc_id || '_' || line_id) AS uid, CASE WHEN head <> '' THEN head ELSE text END AS text FROM I
    UNION ALL SELECT doc_id, line_id, 1, md5(doc_id || '_' || line_id) || '_split', substr(text, length(head) + 1) FROM I WHERE head <> '' AND length(text) > length(head)""")
def post_split(spark, d):
    from .functions import text as T

    rows = noted.lines(spark, d).select("doc_id", "line_id", "text", F.lit("item").alias("line_type"), T.uid(F.col("doc_id"), F.col("line_id")).alias("uid"))
    return lines.post_split(rows, ["item"], [(r"\s*\d+[.)]\S*\s*", r"[^\d.)\s]")]).select("doc_id", "line_id", "part", "uid", "text")


@query("""SELECT p_partkey, round((p_size / 100.0 * 1000 + 5) / 500, 6) AS x, round((p_partkey % 50 / 100.0 * 800 - 3) / 400, 6) AS y, round(0.25 * 1000 / 500, 6) AS w FROM part""")
def box_shift(spark, d):
    box = F.to_json(F.struct((F.col("p_size") / 100).alias("x_top_left"), (F.col("p_partkey") % 50 / 100).alias("y_top_left"), F.lit(0.25).alias("width"), F.lit(0.5).alias("height"), F.lit(1000).alias("page_width"), F.lit(800).alias("page_height")))
    rows = table(spark, d, "part").select("p_partkey", F.from_json(annotations.moved_box(box, 5, -3, 500, 400), annotations.BOX).alias("b"))
    return rows.select("p_partkey", F.round("b.x_top_left", 6).alias("x"), F.round("b.y_top_left", 6).alias("y"), F.round("b.width", 6).alias("w"))


@query(Q + """, O AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM N)
    SELECT doc_id, (SELECT string_agg(text, chr(10) ORDER BY line_id) FROM N n WHERE n.doc_id = O.doc_id) AS text, name, value, (start + off)::BIGINT AS start, ("end" + off)::BIGINT AS "end" FROM O JOIN A USING (doc_id, line_id)""")
def lines_joined(spark, d):
    joined = lines.join_lines(noted.with_spans(spark, d))
    return joined.select("doc_id", "text", F.explode("annotations").alias("a")).select("doc_id", "text", "a.name", "a.value", "a.start", "a.end")


@query(Q + """, B AS (SELECT doc_id, line_id AS id, x, y, width, height FROM N WHERE line_id % 2 = 0), T AS (SELECT doc_id, x + 50 AS x, y + 35 AS y, width, height FROM N WHERE line_id % 3 = 0)
    SELECT doc_id, id FROM B b WHERE NOT EXISTS (SELECT 1 FROM T t WHERE t.doc_id = b.doc_id AND b.x < t.x + t.width AND t.x < b.x + b.width AND b.y < t.y + t.height AND t.y < b.y + b.height)""")
def box_overlap_filter(spark, d):
    rows = noted.lines(spark, d)
    a = rows.where("line_id % 2 = 0").select("doc_id", F.col("line_id").alias("id"), "x", "y", "width", "height")
    b = rows.where("line_id % 3 = 0").select("doc_id", (F.col("x") + 50).alias("x"), (F.col("y") + 35).alias("y"), "width", "height")
    return annotations.overlapping_boxes(a, b, ["doc_id"]).select("doc_id", "id")


# --- features of lines ---------------------------------------------------------------------------


@query(Q + r""", T AS (SELECT *, trim(text) AS s FROM N) SELECT doc_id, line_id, length(regexp_extract(s, '^\s*\d+\.\s')) AS start_regexp_0, length(regexp_extract(s, '^\d+\)')) AS start_regexp_1, length(regexp_extract(s, '^[^\s]+')) AS start_regexp_2,
    (regexp_matches(s, '^\s*\d+\.\s'))::BIGINT + regexp_matches(s, '^\d+\)')::BIGINT + regexp_matches(s, '^[^\s]+')::BIGINT AS start_regexp_num_matches FROM T""")
def start_regexps(spark, d):
    return noted.lines(spark, d).select(*KEYS, *line_features.start_lengths(F.col("text"), (line_features.ITEM, r"\d+\)", r"[^\s]+")))


@query(Q + """, P AS (SELECT doc_id, line_id, list({'s': start, 'e': "end", 'n': name, 'v': value} ORDER BY start, "end", name, value) AS a FROM A GROUP BY ALL),
    R AS (SELECT N.doc_id, N.line_id, text, coalesce(a, []) AS a FROM N LEFT JOIN P USING (doc_id, line_id)), B AS (SELECT *, list_filter(a, lambda x: x.n = 'bold' AND x.v = 'True') AS b, list_filter(a, lambda x: x.n = 'size') AS z FROM R)
    SELECT doc_id, line_id, coalesce(z[1].v::DOUBLE, 0) AS font_size, (len(b) > 0)::INT::DOUBLE AS bold, CASE WHEN trim(text) = '' THEN 0.0 ELSE round(least(coalesce(list_sum(list_transform(b, lambda x: x.e - x.s)), 0) / length(trim(text)), 1.0), 6) END AS bold_percent,
      (len(list_filter(b, lambda x: x.s = 0)) > 0)::INT::DOUBLE AS first_bold, (len(list_filter(a, lambda x: x.n = 'italic')) > 0)::INT::DOUBLE AS italic, 0.0::DOUBLE AS underlined, -1.0::DOUBLE AS spacing, 0.0::DOUBLE AS indentation, 0.0::DOUBLE AS color_dispersion FROM B""")
def annotation_features(spark, d):
    return noted.with_spans(spark, d).select(*KEYS, *line_features.of_annotations())


@query(Q + r""", L AS (SELECT *, regexp_replace(trim(text), '[0-9{}\[\]()<>~!@#$%^&*_+\-/"|?.,:;''`= ]', '', 'g') AS l FROM N)
    SELECT doc_id, line_id, round(CASE WHEN l = '' THEN 0 ELSE length(regexp_replace(l, '\P{Lu}', '', 'g')) / length(l) END, 6) AS upper_letters_percent FROM L""")
def upper_letters(spark, d):
    return noted.lines(spark, d).select(*KEYS, line_features.upper_share(F.trim("text")).alias("upper_letters_percent"))


@query(Q + r""", M AS (SELECT doc_id, line_id, regexp_extract(trim(text), '^(\s*\d{1,2}(\.\d{1,2})*)(\s|$|\)|\}|\.([A-ZА-Яa-zа-яё]|\s))', 1) AS number FROM N),
    T AS (SELECT doc_id, line_id, list_filter(string_split(number, '.'), lambda x: x <> '') AS t FROM M WHERE number <> ''), P AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY line_id) AS p FROM T),
    F AS (SELECT doc_id, line_id, t = ['1'] OR coalesce(len(p) = len(t) AND t[:len(t) - 1] = p[:len(p) - 1] AND t[len(t)]::BIGINT - p[len(p)]::BIGINT = 1, false) OR coalesce(len(p) = len(t) - 1 AND p = t[:len(t) - 1] AND t[len(t)] = '1', false) AS ok FROM P)
    SELECT N.doc_id, N.line_id, CASE WHEN ok THEN 1 WHEN NOT ok THEN -1 ELSE 0 END::BIGINT AS list_item FROM N LEFT JOIN F USING (doc_id, line_id)""")
def list_numbers(spark, d):
    return line_features.list_continuity(noted.lines(spark, d))


#: kind and prefix as structured lines have them, and whether the second follows the first.
PREFIXED = structured.SQL + r""", X AS (SELECT doc_id, line_id, size, CASE WHEN regexp_matches(text, '^-') THEN 'bullet' WHEN regexp_matches(text, '^[a-z]\)') THEN 'letter' WHEN regexp_matches(text, '^\d\)') THEN 'bracket' WHEN regexp_matches(text, '^\d+\.') THEN 'dotted' ELSE 'empty' END AS kind,
    CASE WHEN regexp_matches(text, '^-') THEN '-' WHEN regexp_matches(text, '^[a-z]\)') THEN substr(text, 1, 2) WHEN regexp_matches(text, '^\d\)') THEN substr(text, 1, 1) WHEN regexp_matches(text, '^\d+\.') THEN rtrim(regexp_extract(text, '^(\d+\.)+\d*'), '.') ELSE '' END AS prefix FROM L)"""
FOLLOWS = """({a}.kind = {b}.kind AND CASE {a}.kind WHEN 'bullet' THEN {a}.prefix = {b}.prefix WHEN 'letter' THEN ascii({b}.prefix) = ascii({a}.prefix) + 1 WHEN 'bracket' THEN try_cast({b}.prefix AS BIGINT) = try_cast({a}.prefix AS BIGINT) + 1
    WHEN 'dotted' THEN CASE WHEN contains({a}.prefix, '.') AND contains({b}.prefix, '.') THEN split_part({a}.prefix, '.', 1) = split_part({b}.prefix, '.', 1) AND try_cast(split_part({b}.prefix, '.', 2) AS BIGINT) = try_cast(split_part({a}.prefix, '.', 2) AS BIGINT) + 1
      WHEN contains({b}.prefix, '.') THEN {b}.prefix = {a}.prefix || '.1' ELSE try_cast({b}.prefix AS BIGINT) = try_cast(split_part({a}.prefix, '.', 1) AS BIGINT) + 1 END ELSE false END)"""


@query(f"WITH {PREFIXED}, Y AS (SELECT doc_id, line_id, kind, prefix, lag(kind) OVER w AS k, lag(prefix) OVER w AS p FROM X WINDOW w AS (PARTITION BY doc_id ORDER BY line_id)) SELECT y.doc_id, y.line_id, y.kind, coalesce({FOLLOWS.format(a='b', b='y')}, false) AS follows FROM Y y JOIN (SELECT doc_id, line_id, k AS kind, p AS prefix FROM Y) b USING (doc_id, line_id)")
def prefix_follows(spark, d):
    from .operators.features import order

    rows = structured.lines(spark, d).select(*KEYS, line_features.prefix(F.col("text")).alias("own")).withColumn("before", F.lag("own").over(order()))
    return rows.select(*KEYS, "own.kind", line_features.follows(F.col("before"), F.col("own")).alias("follows"))


@query(f"""WITH {PREFIXED}, Z AS (SELECT *, stddev_pop(size) OVER (PARTITION BY doc_id ORDER BY line_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS std FROM X),
    J AS (SELECT x.doc_id, x.line_id, y.line_id IS NOT NULL AS has, abs(x.size - y.size) <= 0.1 * x.std + 1 AS alike, {FOLLOWS.format(a='x', b='y')} OR {FOLLOWS.format(a='y', b='x')} AS beside FROM Z x LEFT JOIN Z y ON x.doc_id = y.doc_id AND y.line_id BETWEEN x.line_id - 10 AND x.line_id + 9 AND x.line_id <> y.line_id)
    SELECT doc_id, line_id, round(count(*) FILTER (alike) / (count(*) FILTER (has) + 1), 6) AS same_indent_10, round(count(*) FILTER (beside) / (count(*) FILTER (has) + 1), 6) AS predecessor_num_10, round(count(*) FILTER (alike AND beside) / (count(*) FILTER (has) + 1), 6) AS predecessor_num_same_indent_10 FROM J GROUP BY ALL""")
def prefix_window(spark, d):
    return line_features.prefix_window(structured.lines(spark, d), 10, "size")


@query(Q + r""", C AS (SELECT *, regexp_replace(trim(text), '[0-9{}\[\]()<>~!@#$%^&*_+\-/"|?.,:;''`= ]', '', 'g') AS l, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END AS b, (p_size % 5)::DOUBLE AS col FROM N),
    D AS (SELECT *, round(CASE WHEN l = '' THEN 0 ELSE length(regexp_replace(l, '\P{Lu}', '', 'g')) / length(l) END, 6) AS caps FROM C)
    SELECT doc_id, line_id, x AS indent, x - lag(x) OVER w AS indent_prev, lead(x) OVER w - x AS indent_next, x + width AS indent_right, x + width - lag(x + width) OVER w AS indent_prev_right, length(lag(text) OVER w) AS prev_text_lens, length(text) AS text_lens,
      caps AS upper_letters_percent, (caps = 1)::BIGINT AS is_capitalized, ((b = 1) <> (lag(b) OVER w = 1))::BIGINT AS is_bold_changed, ((b = 1) <> (lead(b) OVER w = 1))::BIGINT AS is_bold_changed_next, abs(lag(col) OVER w - col) AS color_dispersion_diff,
      y - lag(y + height) OVER w AS distance_prev, lead(y) OVER w - y - height AS distance_next, height, round(height / (lead(height) OVER w + 1), 6) AS height_next, round(height / (lag(height) OVER w + 1), 6) AS height_prev FROM D WINDOW w AS (PARTITION BY doc_id ORDER BY line_id)""")
def paragraph_features(spark, d):
    rows = noted.lines(spark, d).withColumns({"bold_percent": F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(0.5), "color_dispersion": F.col("p_size") % 5 * 1.0})
    return line_features.paragraphs(rows)


@query(Q + """, H AS (SELECT doc_id, line_id, coalesce(h, min(h) OVER (PARTITION BY doc_id) - 1) AS h FROM (SELECT doc_id, line_id, height - lag(height) OVER (PARTITION BY doc_id ORDER BY line_id) AS h FROM N))
    SELECT doc_id, line_id, round((rank() OVER (PARTITION BY doc_id ORDER BY h) - 1 + count(*) OVER (PARTITION BY doc_id, h) / 2) / count(*) OVER (PARTITION BY doc_id), 6) AS h FROM H""")
def null_quantiles(spark, d):
    h = F.col("height") - F.lag("height").over(features.order())
    return line_features.quantiles(noted.lines(spark, d).select(*KEYS, h.alias("h")), ["h"])


_NAMED = r"'^(Статья|(Г|г)лава|ГЛАВА|ЧАСТЬ|Часть|Раздел|РАЗДЕЛ|\$|§)\s*((\d+\.*)+|[IVXХxхviУП]{1,3}\.?)\s*'"


@query(Q + rf""", T AS (SELECT *, trim(text) AS s, lower(text) AS low, line_id - min(line_id) OVER (PARTITION BY doc_id) AS pos, lag(text) OVER (PARTITION BY doc_id ORDER BY line_id) AS prev FROM N),
    U AS (SELECT *, pos - coalesce(max(CASE WHEN regexp_matches(s, {_NAMED}) THEN pos END) OVER (PARTITION BY doc_id ORDER BY line_id ROWS UNBOUNDED PRECEDING), 0) AS since, min(CASE WHEN starts_with(s, 'Приложение') THEN pos END) OVER (PARTITION BY doc_id) AS app FROM T)
    SELECT doc_id, line_id, since AS lines_from_named, coalesce(pos - app, 0) AS application, coalesce(regexp_matches(prev, '[.;]$'), false)::INT::DOUBLE AS prev_line_ends, coalesce(ends_with(prev, ':'), false)::INT::DOUBLE AS prev_ends_with_colon, 0.0::DOUBLE AS prev_starts_with_article,
      coalesce(prev = '   ', false)::INT::DOUBLE AS prev_is_space, (low LIKE '%2001%')::BIGINT AS num_year_regexp, ends_with(s, '.')::INT::DOUBLE AS endswith_dot, ends_with(s, ';')::INT::DOUBLE AS endswith_semicolon, ends_with(s, ':')::INT::DOUBLE AS endswith_colon, 0.0::DOUBLE AS endswith_comma,
      0.0::DOUBLE AS startswith_bracket, CASE WHEN regexp_matches(text, '^\d+\) \(') THEN 0 ELSE 0 END::BIGINT AS bracket_num, starts_with(s, '«')::INT::DOUBLE AS startswith_quote, contains(low, 'год')::INT::DOUBLE AS year_regexp, starts_with(s, 'Приложение')::INT::DOUBLE AS regexp_application_begin,
      length(regexp_extract(s, {_NAMED})) AS start_regexp_0_named, regexp_matches(s, {_NAMED})::BIGINT AS start_regexp_num_matches_named, length(regexp_extract(trim(low), '^\s*(\d{{1,3}}\.)+\s*[a-zA-Zа-яА-ЯёЁ]')) AS start_regexp_0_item, length(regexp_extract(trim(low), '^\s*\d{{1,3}}(\)|\}})')) AS start_regexp_1_item,
      regexp_matches(trim(low), '^\s*(\d{{1,3}}\.)+\s*[a-zA-Zа-яА-ЯёЁ]')::BIGINT + regexp_matches(trim(low), '^\s*\d{{1,3}}(\)|\}})')::BIGINT AS start_regexp_num_matches_item, length(regexp_extract(trim(low), '^\s*[а-яё]\)')) AS start_regexp_0_subitem, regexp_matches(trim(low), '^\s*[а-яё]\)')::BIGINT AS start_regexp_num_matches_subitem,
      0::BIGINT AS subitem_regexp_num, round(length(regexp_replace(s, '\P{{Lu}}', '', 'g')) / (length(s) + 1), 6) AS supper_percent, round(length(regexp_replace(s, '\P{{L}}', '', 'g')) / (length(s) + 1), 6) AS letter_percent, round(length(regexp_replace(s, '\P{{N}}', '', 'g')) / (length(s) + 1), 6) AS number_percent, regexp_matches(s, '^\p{{Lu}}')::INT::DOUBLE AS is_capitalized FROM U""")
def law_features(spark, d):
    return line_features.law(noted.lines(spark, d))


@query(Q + """, O AS (SELECT doc_id, line_id, starts_with(text, '«Статья') AS o, ends_with(text, '».') AS c FROM N)
    SELECT doc_id, line_id, (EXISTS (SELECT 1 FROM O b WHERE b.doc_id = a.doc_id AND b.o AND b.line_id <= a.line_id AND NOT EXISTS (SELECT 1 FROM O m WHERE m.doc_id = a.doc_id AND m.c AND m.line_id >= b.line_id AND m.line_id < a.line_id))
      AND EXISTS (SELECT 1 FROM O e WHERE e.doc_id = a.doc_id AND e.c AND e.line_id >= a.line_id))::BIGINT AS quoted FROM O a""")
def quoted_lines(spark, d):
    return line_features.in_quotes(noted.lines(spark, d))


@query(Q + r""", T AS (SELECT *, trim(text) AS s, regexp_replace(lower(text), '\s', '', 'g') AS tight FROM N)
    SELECT doc_id, line_id, 0::BIGINT AS is_title, 0::BIGINT AS is_title_keyword, (tight = 'введение')::BIGINT AS is_named_item, (starts_with(tight, 'приложени') OR starts_with(tight, 'глава'))::BIGINT AS named_item_start, contains(tight, 'рисунок')::BIGINT AS is_raw_text,
      length(regexp_extract(s, '^\s*\d+\.\s')) AS start_regexp_0, length(regexp_extract(s, '^\s*(\d+\.)+(\d+)?\s*')) AS start_regexp_1, length(regexp_extract(s, '^\s*\d+\s')) AS start_regexp_2, regexp_matches(s, '^\s*\d+\.\s')::BIGINT + regexp_matches(s, '^\s*(\d+\.)+(\d+)?\s*')::BIGINT + regexp_matches(s, '^\s*\d+\s')::BIGINT AS start_regexp_num_matches,
      length(regexp_replace(tight, '[^()]', '', 'g')) AS brackets_number, (lower(s) = s AND upper(s) <> s)::BIGINT AS is_lower, len(list_filter(string_split(trim(regexp_extract(s, '^(\d+\.)+(\d+)?')), '.'), lambda x: x <> '')) AS dotted_depth, length(s) AS text_length,
      len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) AS words_number FROM T""")
def thesis_features(spark, d):
    return line_features.thesis(noted.lines(spark, d))


#: Twenty parts are a document; it has a title at line 2 in some, items, gaps and a line that goes on.
TOC = """(p_partkey // 20) AS doc_id, p_partkey % 20 AS line_id, CASE WHEN p_partkey % 20 = 2 AND (p_partkey // 20) % 3 <> 0 THEN 'Table of contents:' WHEN p_partkey % 20 IN (5, 9) AND (p_partkey // 20) % 2 = 0 THEN p_name || ' and'
    WHEN p_partkey % 20 < 16 THEN p_name || ' ..... ' || CASE WHEN (p_partkey // 20) % 7 = 5 AND p_partkey % 20 = 11 THEN 1 ELSE p_partkey % 20 + 10 END ELSE 'Text of ' || p_name END AS text"""


@query(r"WITH L AS (SELECT " + TOC + r""" FROM part), T AS (SELECT *, text = 'Table of contents:' AS title, regexp_matches(text, ' \.\.\.\.\. \d+$') AS item FROM L), F AS (SELECT doc_id, max(CASE WHEN title THEN line_id END) AS f FROM T GROUP BY doc_id),
    B AS (SELECT T.*, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n, coalesce(sum(item::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier, bool_or(item) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead,
      coalesce(bool_or(item) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), false) AS later FROM T JOIN F USING (doc_id) WHERE line_id > coalesce(f, -1) WINDOW w AS (PARTITION BY doc_id ORDER BY line_id)),
    C AS (SELECT *, bool_or(earlier > 5 AND NOT ahead) OVER (PARTITION BY doc_id ORDER BY line_id) AS over FROM B WHERE n > 5), D AS (SELECT * FROM C WHERE k < n - 5 AND NOT over AND ((ahead AND earlier > 0) OR (item AND later))),
    E AS (SELECT *, sum(item::INT) OVER (PARTITION BY doc_id ORDER BY line_id) - item::INT AS own FROM D), G AS (SELECT doc_id, own::BIGINT AS item, min(line_id) AS first_line, max(line_id) AS last_line, max(CASE WHEN item THEN regexp_extract(text, '(\d+)$', 1)::BIGINT END) AS page, string_agg(text, '' ORDER BY line_id) AS text FROM E GROUP BY doc_id, own),
    H AS (SELECT *, coalesce(page < lag(page) OVER (PARTITION BY doc_id ORDER BY item), false) AS falls FROM G WHERE page IS NOT NULL), I AS (SELECT *, bool_or(falls) OVER (PARTITION BY doc_id) AS bad, count(*) OVER (PARTITION BY doc_id) AS c FROM H)
    SELECT doc_id, item, first_line, last_line, page, text FROM I WHERE c > 6 AND NOT bad""")
def toc_items(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey div 20 AS doc_id", "p_partkey % 20 AS line_id", TOC.split(", ", 2)[2].replace("//", "div"))
    return line_features.contents(rows)


@query(Q + """, C AS (SELECT doc_id, x, count(*) AS n FROM N GROUP BY ALL), B AS (SELECT doc_id, min(x) AS bound FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, x) AS r FROM C) WHERE r <= 2 GROUP BY doc_id), M AS (SELECT doc_id, median(height) AS mid FROM N GROUP BY doc_id)
    SELECT doc_id, line_id, greatest(round((x - bound) * 1440 / 300), 0)::BIGINT AS indentation, round(height * 72 / 300)::BIGINT AS size, coalesce(floor((y - lag(y + height) OVER (PARTITION BY doc_id, line_id // 6 ORDER BY line_id)) * 100 / mid), 0)::BIGINT AS spacing FROM N JOIN B USING (doc_id) JOIN M USING (doc_id)""")
def scan_layout(spark, d):
    return line_features.scan_layout(noted.lines(spark, d).withColumn("page_id", F.floor(F.col("line_id") / 6)))
