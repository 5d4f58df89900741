"""Structure of legal, technical and student documents: rules on lines and their labels.
All but depth_stack are expressions and windows; none needs a join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import doc, order

# How units of a law begin.
ITEM_BRACKET = r"(?U)^\s*(\d*\.)*\d+[)}]"
ITEM_DOTTED = r"(?U)^\s*(\d+\.)+\s*"
SUBITEM = r"(?U)^\s*[а-яё][)}]"
ROMAN_UNIT = r"(?U)^\s*(I|Г|T|Т|II|П|III|Ш|ТУ|TУ|IV|V|У|VI|УТ|УT|VII|УТТ|VIII|I[XХ]|[XХ]|[XХ]I|[XХ]II)\.\s+"
#: Kinds of laws in the order they are looked for.
LAW_TYPES = ("определение", "приказ", "распоряжение", "кодекс", "федеральный закон", "указ", "закон", "постановление", "директива", "конституция", "положение", "инструкция")
FOIV_TYPES = ("приказ", "положение", "инструкция")
#: Look-alikes of Roman figures.
LOOK_ALIKES = (("T", "I"), ("Т", "I"), ("У", "V"), ("П", "II"), ("Ш", "III"), ("Г", "I"))
FOOTNOTE_START = r"(?U)^\d+ "


def _unit(kind: str, level: int, second: Column | int = 0, more: bool = False, carries: bool = False) -> Column:
    second = F.lit(second) if isinstance(second, int) else second
    return F.struct(F.lit(kind).alias("line_type"), F.lit(float(level)).alias("level_1"), second.cast("double").alias("level_2"), F.lit(more).alias("can_be_multiline"), F.lit(carries).alias("carries"))


def _with_units(lines: DataFrame, unit: Column) -> DataFrame:
    """A line without a unit of its own goes on with the last one, if that may be carried."""
    rows = lines.withColumn("own", unit)
    last = F.last("own", ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0))
    none = F.struct(F.lit("raw_text").alias("line_type"), F.lit(None).cast("double").alias("level_1"), F.lit(None).cast("double").alias("level_2"), F.lit(False).alias("can_be_multiline"), F.lit(False).alias("carries"))
    rows = rows.withColumn("last", last)
    got = F.coalesce("own", F.when(F.col("last")["carries"], F.col("last")), none)
    return rows.withColumn("unit", got).withColumn("is_own", F.col("own").isNotNull()).drop("own", "last").select("*", "unit.line_type", "unit.level_1", "unit.level_2", "unit.can_be_multiline").drop("unit")


def law_units(lines: DataFrame, depth: int = 2) -> DataFrame:
    """Levels of a law's lines: part, section, subsection, chapter, paragraph and article
    are carried on, items, parts of articles and subitems end what was carried."""
    text, low = F.col("text"), F.lower("text")
    head = lambda word, kind, n: (low.startswith(word), _unit(kind, depth + n, 0, True, True))
    rules = [
        head("часть", "part", 1), head("раздел", "section", 2), (text.rlike(ROMAN_UNIT), _unit("subsection", depth + 3, 0, True, True)), head("глава", "chapter", 4), head("§", "paragraph", 5), head("статья", "article", 6),
        (text.rlike(ITEM_BRACKET), _unit("item", depth + 8)), (text.rlike(ITEM_DOTTED), _unit("articlePart", depth + 7)), (text.rlike(SUBITEM), _unit("subitem", depth + 9)),
    ]
    return _with_units(lines, F.coalesce(*[F.when(c, u) for c, u in rules]))


def foiv_units(lines: DataFrame, depth: int = 2) -> DataFrame:
    """Levels of an order's or a statute's lines; the second level counts the numbers."""
    text = F.col("text")
    size = lambda p: F.size(F.filter(F.split(F.regexp_extract(text, p, 0), "[.]"), lambda x: F.trim(x) != ""))
    rules = [
        (F.lower(text).startswith("глава") | text.rlike(ROMAN_UNIT), _unit("chapter", depth + 4, 0, True, True)), (text.rlike(ITEM_BRACKET), _unit("subitem", depth + 9, size(ITEM_BRACKET), carries=True)),
        (text.rlike(SUBITEM), _unit("subitem", depth + 10, size(SUBITEM), carries=True)), (text.rlike(ITEM_DOTTED), _unit("item", depth + 8, size(ITEM_DOTTED), carries=True)),
    ]
    return _with_units(lines, F.coalesce(*[F.when(c, u) for c, u in rules]))


def roman_repair(text: Column) -> Column:
    """Letters that were misread in a Roman number at the start become its figures."""
    prefix = F.regexp_extract(text, ROMAN_UNIT, 0)
    fixed = prefix
    for a, b in LOOK_ALIKES:
        fixed = F.replace(fixed, F.lit(a), F.lit(b))
    return F.concat(fixed, F.substr(text, F.length(prefix) + 1))


def law_type(lines: DataFrame, size: int = 3, batches: int = 8) -> DataFrame:
    """doc_id, law_type, extractor: the first kind named by a whole line among the first
    batches of non-blank lines. A batch counts once a line follows it. A law gives way to
    any other kind that is found later."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", "[ий]̆", "й"), "[ИЙ]̆", "Й"))
    filled = lines.withColumn("clean", clean).where(F.col("clean") != "").withColumn("n", F.row_number().over(order())).where(F.col("n") <= size * batches + 1)
    batch = F.floor((F.col("n") - 1) / size)
    rows = filled.withColumn("batch", batch).withColumn("all", F.max("n").over(doc())).where((F.col("all") > size * (F.col("batch") + 1)) & (F.col("batch") < batches))
    spaced = lambda word: r"\s*".join("[з3]" if c == "з" and word == "приказ" else c for c in word)
    whole = lambda word: F.col("clean").rlike(r"(?iU)^[\s\w-]*\b" + spaced(word) + r"\b[()/\.№\s\w-]*\z")
    found = F.filter(F.array(*[F.when(whole(w), F.struct(F.lit(w == "закон").alias("law"), "batch", F.lit(i).alias("rank"), F.lit(w).alias("word"))) for i, w in enumerate(LAW_TYPES)]), lambda x: x.isNotNull())
    best = rows.select("doc_id", F.explode(found).alias("f")).groupBy("doc_id").agg(F.min("f").alias("f")).select("doc_id", F.col("f.word").alias("law_type"))
    every = lines.select("doc_id").distinct().join(best, "doc_id", "left")
    return every.withColumn("extractor", F.when(F.col("law_type").isin(*FOIV_TYPES), "foiv_law").otherwise("law"))


def law_labels(lines: DataFrame, label: str = "label") -> DataFrame:
    """Labels that fit a law's course: title, body, cellar, application. A footer stays
    one; a cellar needs the last unit before it and no application before it."""
    at = F.col("line_id")
    begin = F.min(F.when(F.col(label).isin("structure_unit", "cellar", "application"), at)).over(doc())
    rows = lines.withColumn("begin", begin).withColumn("app", F.min(F.when(F.col(label) == "application", at)).over(doc()))
    rows = rows.withColumn("unit", F.coalesce(F.max(F.when((F.col(label) == "structure_unit") & (F.col("app").isNull() | (at < F.col("app"))), at)).over(doc()), "begin"))
    in_tail = (at >= F.col("unit")) & (F.col("app").isNull() | (at < F.col("app")))
    fixed = F.when(F.col(label) == "footer", "footer").when(F.col("begin").isNull() | (at < F.col("begin")), "title").when((F.col(label) == "title") | ((F.col(label) == "cellar") & ~in_tail), "raw_text").otherwise(F.col(label))
    return rows.withColumn("fixed", fixed).drop("begin", "app", "unit")


def law_segments(label: str = "fixed") -> Column:
    """header, body, cellar or application, by the labels up to the line."""
    upto = order().rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda x: F.max((F.col(label) == x).cast("int")).over(upto) == 1
    return F.when(seen("application"), "application").when(seen("cellar"), "cellar").when(seen("structure_unit"), "body").otherwise("header")


def task_segments(lines: DataFrame, label: str = "label") -> DataFrame:
    """header, toc and body of a technical task: the body begins with a part or an item, or
    after the last line labelled toc or title; toc goes on until then."""
    at, upto = F.col("line_id"), order().rowsBetween(Window.unboundedPreceding, 0)
    titled = F.lower(F.trim("text")).isin("содержание", "оглавление")
    rows = lines.withColumn("last_toc", F.coalesce(F.max(F.when(F.col(label).isin("toc", "title"), at)).over(doc()), F.lit(0)))
    body = F.max((F.col(label).isin("part", "item") | (at > F.col("last_toc"))).cast("int")).over(upto) == 1
    toc = F.max(((F.col(label) == "toc") | titled).cast("int")).over(upto) == 1
    return rows.withColumn("segment", F.when(body, "body").when(toc, "toc").otherwise("header")).drop("last_toc")


def task_labels(label: str, size: str) -> Column:
    """A unit of at least two points above the document's median size is a part; other parts become named items."""
    large = F.col(size) >= F.median(size).over(doc()) + 2
    return F.when(large & F.col(label).isin("item", "part", "named_item"), "part").when(F.col(label) == "part", "named_item").otherwise(F.col(label))


def title_labels(lines: DataFrame, label: str = "label") -> DataFrame:
    """Lines before the first that isn't title, raw text or other, or up to the first year,
    are the title; none later is. Blank lines after it are raw text."""
    year = F.regexp_replace(F.lower("text"), r"(?U)\s+", "").rlike(r"^(19\d\d|20\d\d)")
    blank = F.trim("text") == ""
    other = ~F.when(blank, "raw_text").otherwise(F.col(label)).isin("title", "raw_text", "other")
    first = F.coalesce(F.min(F.when(year, F.col("line_id") + 1).when(other, F.col("line_id"))).over(doc()), F.lit(0))
    fixed = F.when(F.col("line_id") < first, "title").when(blank | (F.col(label) == "title"), "raw_text").otherwise(F.col(label))
    return lines.withColumn("fixed", fixed)


def page_numbers() -> Column:
    """Lines of digits alone at the first or last place of a page, but not of the document."""
    before, after = F.lag("page_id").over(order()), F.lead("page_id").over(order())
    edge = (before < F.col("page_id")) | (F.col("page_id") < after)
    return F.coalesce(before.isNotNull() & after.isNotNull() & edge & F.trim("text").rlike(r"(?U)^\d+\z"), F.lit(False))


def footnotes(lines: DataFrame, label: str = "label") -> DataFrame:
    """Lines of one footnote joined: a new one begins after another kind of line, or with a number."""
    is_note = F.col(label) == "footnote"
    goes_on = is_note & (F.lag(label).over(order()) == "footnote") & ~F.col("text").rlike(FOOTNOTE_START)
    run = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order())
    parts = F.array_sort(F.collect_list(F.struct("line_id", "text")))
    joined = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    return lines.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("line_id").alias("line_id"), joined.alias("text"), F.first(label).alias(label), F.count("*").alias("n_lines")).drop("run")


def depth_stack(lines: DataFrame, size: str = "size") -> DataFrame:
    """doc_id, line_id, depth: how many lines are open that are larger by more than the
    document's standard deviation. A fold over sorted rows: only the stack is kept. Each
    document comes twice, first for its deviation, whose sums run in the order of lines and by
    Welford's form as in the SQL: where a size lies just a deviation above, its last bit decides."""
    known = F.when(F.col(size).isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = lines.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line_id").cast("long").alias("line_id"), F.coalesce(F.col(size), F.lit(0)).cast("double").alias("x"), known.alias("pass")).repartition("doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, mean, squares, std, stack = None, 0, 0.0, 0.0, None, []
        for frame in frames:
            depths = []
            for d, second, x in zip(*(frame[c].tolist() for c in ("doc_id", "pass", "x")), strict=True):
                if d != now:
                    now, n, mean, squares, std, stack = d, 0, 0.0, 0.0, None, []
                if not second:
                    n += 1
                    last, mean = mean, mean + (x - mean) / n
                    squares += (x - mean) * (x - last)
                    continue
                if std is None:
                    std = math.sqrt(squares / n) if n else 0.0
                while stack and stack[-1] <= x + std:
                    stack.pop()
                depths.append(len(stack))
                stack.append(x)
            yield frame.loc[frame["pass"] == 1, ["doc_id", "line_id"]].assign(depth=depths)

    twice = rows.withColumn("pass", F.explode("pass")).sortWithinPartitions("doc_id", "pass", "line_id")
    return twice.mapInPandas(run, "doc_id long, line_id long, depth long")


def with_contents(lines: DataFrame, toc: DataFrame, label: str = "label") -> DataFrame:
    """Lines whose places (doc_id, page_id, line_id) are those of items of contents get the
    label toc, and all are put in the order of pages and lines again (own: the old number)."""
    items = toc.select("doc_id", "page_id", "line_id", F.lit(True).alias("__toc"))
    rows = lines.join(items, ["doc_id", "page_id", "line_id"], "left").withColumn(label, F.when(F.col("__toc"), "toc").otherwise(F.col(label))).drop("__toc").withColumnRenamed("line_id", "own")
    return rows.withColumn("line_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id", "own")) - 1).cast("long"))
