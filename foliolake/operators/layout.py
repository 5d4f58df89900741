"""Layout: repeated page ends, linking of objects to lines, grids of tables, OCR words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Weights of the first and last lines of a page, from its edges inwards.
WEIGHTS = (1.0, 1.0, 0.85, 0.75)


def page_ends(lines: DataFrame, ends: int = 4) -> DataFrame:
    """The first and last lines of every page (doc_id, page_id) as slots (h1.., f1..), blank
    lines at the ends left out, digits made equal. Pages with fewer lines than slots have none."""
    page = Window.partitionBy("doc_id", "page_id")
    some = F.when(F.trim("text") != "", F.col("line_id"))
    rows = lines.withColumns({"__a": F.min(some).over(page), "__b": F.max(some).over(page)}).where(F.col("line_id").between(F.col("__a"), F.col("__b")))
    up, down = (page.orderBy(o) for o in (F.asc("line_id"), F.desc("line_id")))
    both = rows.select("doc_id", "page_id", "line_id", F.regexp_replace("text", "[0-9]", "@").alias("pattern"), F.row_number().over(up).alias("a"), F.row_number().over(down).alias("b"), F.count("*").over(page).alias("n")).where(F.col("n") >= 2 * ends)
    slots = F.array(F.when(F.col("a") <= ends, F.struct(F.concat(F.lit("h"), "a").alias("slot"), F.col("a").alias("k"))), F.when(F.col("b") <= ends, F.struct(F.concat(F.lit("f"), "b").alias("slot"), F.col("b").alias("k"))))
    return both.select("doc_id", "page_id", "line_id", "pattern", F.explode(F.filter(slots, lambda x: x.isNotNull())).alias("x")).select("doc_id", "page_id", "line_id", "pattern", "x.slot", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("x.k").cast("int")).alias("weight"))


def page_steps(lines: DataFrame) -> DataFrame:
    """doc_id, step, share: documents of more than 6 pages are compared two pages apart, and
    a pattern on 4 of 10 pages is frequent there, else on 7 of 10."""
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page_id").alias("pages"))
    return pages.select("doc_id", F.when(F.col("pages") > 6, 2).otherwise(1).alias("step"), F.when(F.col("pages") > 6, 0.4).otherwise(0.7).alias("share"))


def repeated_ends(lines: DataFrame, least: float = 0.5, ends: int = 4) -> DataFrame:
    """doc_id, slot, score: how alike a document's slots are on pages a step apart, on average
    and by weight; slots above `least` hold headers or footers. One join on equal keys."""
    slots = page_ends(lines, ends).join(page_steps(lines), "doc_id")
    later = slots.select("doc_id", (F.col("page_id") - F.col("step")).alias("page_id"), "slot", F.col("pattern").alias("next"))
    alike = F.col("weight") * (1 - F.levenshtein("pattern", "next") / F.greatest(F.length("pattern"), F.length("next"), F.lit(1)))
    return slots.join(later, ["doc_id", "page_id", "slot"]).groupBy("doc_id", "slot").agg(F.round(F.avg(alike), 6).alias("score"), F.count("*").alias("n_pairs")).where(F.col("score") > least)


def popular_ends(lines: DataFrame, ends: int = 4) -> DataFrame:
    """doc_id, slot, pattern, n_pages: patterns that are frequent in the slots of headers and
    footers of their document."""
    slots = page_ends(lines, ends).join(repeated_ends(lines, ends=ends).select("doc_id", "slot"), ["doc_id", "slot"])
    total = slots.groupBy("doc_id", "slot").agg(F.count("*").alias("all"))
    counted = slots.groupBy("doc_id", "slot", "pattern").agg(F.count("*").alias("n_pages"))
    return counted.join(total, ["doc_id", "slot"]).join(page_steps(lines), "doc_id").where(F.col("n_pages") > F.col("share") * F.col("all")).select("doc_id", "slot", "pattern", "n_pages")


def without_ends(lines: DataFrame, ends: int = 4) -> DataFrame:
    """Lines that are no header or footer: an anti-join with the slots of frequent patterns."""
    gone = page_ends(lines, ends).join(popular_ends(lines, ends).select("doc_id", "slot", "pattern"), ["doc_id", "slot", "pattern"], "left_semi")
    return lines.join(gone.select("doc_id", "page_id", "line_id").distinct(), ["doc_id", "page_id", "line_id"], "left_anti")


def as_of(rows: DataFrame, key: str, order: list[str], mark: str, value: str) -> DataFrame:
    """Each row with the value of the last marked row before it, in one window: no join,
    one sort by key and order."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("linked", F.last(F.when(F.expr(mark), F.col(value)), ignorenulls=True).over(w))


def expand_spans(cells: DataFrame) -> DataFrame:
    """A row for each place that a cell covers; all but the first are invisible."""
    places = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("rowspan") - 1)).alias("dr")).select("*", F.explode(F.sequence(F.lit(0), F.col("colspan") - 1)).alias("dc"))
    return places.select("doc_id", (F.col("row_id") + F.col("dr")).cast("long").alias("row_id"), (F.col("col_id") + F.col("dc")).cast("long").alias("col_id"), "text", ((F.col("dr") > 0) | (F.col("dc") > 0)).alias("invisible"))


def merge_pages(tables: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Tables of consecutive pages as one where widths differ by a share at most and
    the number of columns is equal; a chain of pairs, so islands."""
    w = Window.partitionBy("doc_id").orderBy("page_id")
    fits = (F.col("page_id") == F.lag("page_id").over(w) + 1) & (F.col("n_cols") == F.lag("n_cols").over(w)) & (F.abs(F.col("width") - F.lag("width").over(w)) <= tolerance * F.lag("width").over(w))
    chain = tables.withColumn("chain", F.sum(F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1)).over(w))
    return chain.groupBy("doc_id", "chain").agg(F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.sum("n_rows").alias("n_rows")).drop("chain")


def ocr_lines(words: DataFrame, threshold: float = 40) -> DataFrame:
    """Lines of words that were read with enough confidence, by page, block, paragraph and
    line, as far as the words have these."""
    parts = F.array_sort(F.collect_list(F.struct("word_num", "text")))
    keys = [c for c in ("page_num", "block_num", "par_num", "line_num") if c in words.columns]
    return words.where(F.col("conf") >= threshold).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n_words"))


def link_objects(objects: DataFrame, lines: DataFrame, near: int = 5) -> DataFrame:
    """Each object (object_id) with the line it belongs to, both with doc_id, page_id, x, y,
    width and height, lines also with line_id and text. Candidates are the lines just before
    and after in reading order; of those on the page the one with the least vertical gap, less
    the horizontal overlap, wins. Without any, it is the last line of the page before, else
    the nearest. Candidates are named by position, so the join is on equal keys."""
    place = ["doc_id", "page_id", "y", "x"]
    w = Window.partitionBy("doc_id").orderBy("page_id", "y", "x", "line_id")
    numbered = lines.withColumn("pos", F.row_number().over(w).cast("long"))
    both = lines.select(*place, F.lit(1).alias("is_line"), F.lit(None).cast("long").alias("object_id")).unionByName(objects.select(*place, F.lit(0).alias("is_line"), "object_id"))
    before = F.sum("is_line").over(Window.partitionBy("doc_id").orderBy("page_id", "y", "x", F.desc("is_line"), "object_id").rowsBetween(Window.unboundedPreceding, 0))
    at = both.withColumn("before", before).where("is_line = 0").select("doc_id", "object_id", "before")
    asked = objects.join(at, ["doc_id", "object_id"]).select("*", F.explode(F.sequence(F.col("before") - near + 1, F.col("before") + near)).alias("pos"))
    cand = numbered.select("doc_id", "pos", "line_id", F.lower(F.trim("text")).alias("low"), *[F.col(c).alias(f"l_{c}") for c in ("page_id", "x", "y", "width", "height")])
    c = F.col
    gap = F.least(F.abs(c("l_y") - c("y") - c("height")), F.abs(c("l_y") + c("l_height") - c("y"))) / (c("height") + 1e-3)
    common = F.least(c("l_x") + c("l_width"), c("x") + c("width")) - F.greatest("l_x", "x")
    special = F.when(c("low") == "", 0.5).when(c("low").rlike("^(таблица |таб[.] |table )"), -0.5).otherwise(0.0)
    distance = gap - F.when(common > 0, common / c("l_width")).otherwise(0.0) + special
    ahead = c("pos") <= c("before")
    # on the page by distance, then the lines before from the nearest, then those after
    score = F.struct(
        F.when(c("l_page_id") == c("page_id"), 0).when((c("l_page_id") == c("page_id") - 1) & ahead, 1).when(ahead, 2).otherwise(3).alias("rank"),
        F.when(c("l_page_id") == c("page_id"), F.round(distance, 9)).otherwise(F.abs(c("pos") - c("before"))).alias("distance"), "pos", "line_id",
    )
    return asked.join(cand, ["doc_id", "pos"]).groupBy("doc_id", "object_id").agg(F.min(score).alias("s")).select("doc_id", "object_id", "s.line_id")


def page_range(pages: str) -> tuple[int, int | None]:
    """First and end page of "from:to", counted from 1, both kept; either side may be missing."""
    left, sep, right = pages.partition(":")
    if not sep or not all(x.strip().lstrip("-").isdigit() or not x.strip() for x in (left, right)):
        raise ValueError(f"pages should be like 'from:to', not {pages!r}")
    first, last = max(int(left) - 1, 0) if left.strip() else 0, max(int(right), 0) if right.strip() else None
    if last is not None and last <= first and left.strip():
        raise ValueError(f"no page is in {pages!r}")
    return first, last


def page_slice(lines: DataFrame, pages: str) -> DataFrame:
    """Lines of a range of pages; the filter reaches the scan."""
    first, last = page_range(pages)
    kept = lines.where(F.col("page_id") >= first)
    return kept if last is None else kept.where(F.col("page_id") < last)


def merge_first_page(first: DataFrame, rest: DataFrame) -> DataFrame:
    """Lines of page 0 read one way, of all others read another way, numbered anew."""
    both = first.where("page_id = 0").unionByName(rest.where("page_id > 0"))
    return both.withColumn("line_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id", "line_id")) - 1).cast("long"))


def flatten_pages(parts: list[DataFrame], order: str = "line_id") -> DataFrame:
    """Pages that were read apart as one document, lines numbered in the order of pages."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.withColumn("line_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id", order)) - 1).cast("long"))


def merge_tables(cells: DataFrame, pages: DataFrame, width_share: float = 0.03, column_share: float = 0.1, least: float = 4) -> DataFrame:
    """doc_id, chain, page_id, row_id: rows of tables that go on over pages. A page's table
    (doc_id, page_id, width, widths: its columns' widths) goes on with that of the page
    before if both are as wide, to a share, with as many columns, each as wide to a tenth
    or 4; a header that comes again is left out. cells: doc_id, page_id, row_id, col_id,
    text, is_header."""
    w = Window.partitionBy("doc_id").orderBy("page_id")
    last = lambda c: F.lag(c).over(w)
    columns = F.forall(F.arrays_zip(F.col("widths").alias("a"), last("widths").alias("b")), lambda x: F.abs(x["a"] - x["b"]) <= F.greatest(F.lit(least), F.lit(column_share) * x["b"]))
    fits = (F.col("page_id") == last("page_id") + 1) & (F.size("widths") == F.size(last("widths"))) & (F.abs(F.col("width") - last("width")) <= width_share * last("width")) & columns
    chain = pages.withColumn("chain", F.sum(F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1)).over(w))
    rows = cells.groupBy("doc_id", "page_id", "row_id").agg(F.min(F.col("is_header").cast("int")).alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "text"))), lambda x: x["text"]), "\t").alias("text"))
    placed = rows.join(chain.select("doc_id", "page_id", "chain"), ["doc_id", "page_id"])
    of = Window.partitionBy("doc_id", "chain", "text", "head").orderBy("page_id", "row_id")
    kept = placed.withColumn("first", F.first("page_id").over(of)).where((F.col("head") == 0) | (F.col("page_id") == F.col("first")))
    number = F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("page_id", "row_id")) - 1
    return kept.select("doc_id", F.col("chain").cast("long").alias("chain"), "page_id", number.cast("long").alias("row_id"), "text")


def table_notes(links: DataFrame, lines: DataFrame) -> DataFrame:
    """Annotations of lines that tables belong to: links are (doc_id, object_id, line_id)."""
    return links.join(lines.select("doc_id", "line_id", "text"), ["doc_id", "line_id"]).select("doc_id", "line_id", F.lit("table").alias("name"), F.concat(F.lit("table_"), F.col("object_id").cast("string")).alias("value"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))


def font_runs(chars: DataFrame) -> DataFrame:
    """doc_id, line_id, start, end, style, bold, size: neighbours of one font and size (to
    the point) as one run. chars: doc_id, line_id, place, font, size."""
    w = Window.partitionBy("doc_id", "line_id").orderBy("place")
    same = (F.col("font") == F.lag("font").over(w)) & (F.round("size") == F.round(F.lag("size").over(w)))
    runs = chars.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    out = runs.groupBy("doc_id", "line_id", "run").agg(F.min("place").cast("long").alias("start"), (F.max("place") + 1).cast("long").alias("end"), F.min("font").alias("style"), F.round(F.min("size")).cast("long").alias("size"))
    return out.select("doc_id", "line_id", "start", "end", "style", F.lower("style").contains("bold").alias("bold"), "size")


def without_first_page_tables(tables: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, table_id, page_id) that aren't on page 0, whose own reading counts, and
    the annotations (doc_id, name, value) of all others but theirs."""
    gone = tables.where("page_id = 0").select("doc_id", F.lit("table").alias("name"), F.col("table_id").cast("string").alias("value"))
    return tables.where("page_id > 0"), notes.join(gone, ["doc_id", "name", "value"], "left_anti")
