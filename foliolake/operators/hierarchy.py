"""Levels of whole documents by their segments: laws, contents, articles, reports.

What a line continues is found by windows: the last line before that defined a level, and
whether a line in between has ended it. Nodes without a line of their own are a union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from . import domain
from .features import doc, order
from .line_features import APPLICATION, TOC_TITLES

COLUMNS = ("doc_id", "line_id", "text", "line_type", "level_1", "level_2", "can_be_multiline")


def _level(kind: str | None, a: float | None, b: float | None, multi: bool) -> Column:
    number = lambda x: F.lit(x).cast("double")
    return F.struct(F.lit(kind).alias("line_type"), number(a).alias("level_1"), number(b).alias("level_2"), F.lit(multi).alias("can_be_multiline"))


def law_levels(lines: DataFrame, depth: int = 2, units=domain.law_units) -> DataFrame:
    """COLUMNS of a law's lines (doc_id, line_id, text, label): the header is the root's
    text, the body hangs below a node of its own, cellar and applications follow. Raw text
    goes on with a chapter or application that nothing has ended. Lines are numbered anew."""
    seen = domain.law_labels(lines).withColumn("segment", domain.law_segments())
    own = units(seen.select("doc_id", "line_id", "text", "segment", "fixed"), depth)
    blank, roman = strip(F.col("text")) == "", F.col("text").rlike(domain.ROMAN_UNIT)
    part = Window.partitionBy("doc_id", "segment").orderBy("line_id")
    first = F.row_number().over(part) == 1
    begins = F.lower(strip(F.col("text"))).rlike(APPLICATION)
    label = F.col("fixed")
    in_body = F.when(label.isin("application", "raw_text", "cellar", "header") & roman, "structure_unit").when(label == "header", "raw_text").when(label == "application", "footer").otherwise(label)
    in_app = F.when(first, "application").when(blank, "raw_text").when(label.isin("header", "cellar", "title"), "application").when((label == "raw_text") & begins, "application").otherwise(label)
    in_app = F.when(in_app.isin("application", "raw_text") & roman & ~first, "structure_unit").otherwise(in_app)
    rows = own.withColumn("as", F.when(F.col("segment") == "body", in_body).when(F.col("segment") == "application", in_app))
    unit = F.struct("line_type", "level_1", "level_2", "can_be_multiline")
    defines = F.when((F.col("as") == "structure_unit") & F.col("is_own"), unit).when(F.col("as") == "application", _level("application", depth, 0, True))
    rows = rows.select("doc_id", "line_id", "text", "segment", "as", begins.alias("begins"), blank.alias("blank"), defines.alias("own"), F.col("is_own"))
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c: F.max(F.when(c, F.col("line_id"))).over(before)
    rows = rows.withColumns({
        "last": F.last("own", ignorenulls=True).over(before), "last_at": at(F.col("own").isNotNull()), "raw_at": at((F.col("as") == "raw_text")), "end_at": at(~F.col("as").isin("structure_unit", "application", "raw_text") | F.col("as").isNull()),
        "earlier": F.coalesce(F.last(F.when(~F.col("blank"), F.col("begins")), ignorenulls=True).over(before), F.lit(False)), "n": F.row_number().over(part),
    })
    open_ = F.col("last").isNotNull() & (F.col("end_at").isNull() | (F.col("end_at") < F.col("last_at")))
    goes_on = open_ & F.col("last.line_type").isin("chapter", "application")
    open_ = goes_on | (open_ & (F.col("raw_at").isNull() | (F.col("raw_at") < F.col("last_at"))))
    carried = F.when((F.col("as") == "structure_unit") & open_ & F.col("last.can_be_multiline"), F.col("last")).when((F.col("as") == "raw_text") & goes_on, F.col("last"))
    made = F.when(F.col("segment") == "header", _level("root", 0, 0, True)).when(F.col("segment") == "cellar", _level("cellar", depth, 0, True)).otherwise(F.coalesce("own", carried, _level("raw_text", None, None, False)))
    rows = rows.withColumn("hl", made)
    multi = F.when((F.col("segment") == "application") & (F.col("n") == 1), F.lit(False)).when((F.col("segment") == "application") & F.col("begins"), F.col("earlier")).when((F.col("segment") == "body") & F.col("blank"), F.lit(True)).otherwise(F.col("hl.can_be_multiline"))
    placed = rows.select("doc_id", (F.col("line_id") * 2 + 1).alias("line_id"), "text", "hl.line_type", "hl.level_1", "hl.level_2", multi.alias("can_be_multiline"))
    node = rows.groupBy("doc_id").agg((F.coalesce(F.min(F.when(F.col("segment") != "header", F.col("line_id"))), F.max("line_id") + 1) * 2).alias("line_id"))
    node = node.select("doc_id", "line_id", F.lit("").alias("text"), F.lit("body").alias("line_type"), F.lit(float(depth)).alias("level_1"), F.lit(0.0).alias("level_2"), F.lit(False).alias("can_be_multiline"))
    return placed.unionByName(node).withColumn("line_id", (F.row_number().over(order()) - 1).cast("long"))


def contents_levels(lines: DataFrame, depth: int = 2) -> DataFrame:
    """COLUMNS of the lines of a table of contents: titles, items below them, and a node
    without text where the first line isn't a title."""
    title = F.lower(strip(F.col("text"))).isin(*TOC_TITLES)
    rows = lines.select("doc_id", (F.col("line_id") * 2 + 1).alias("line_id"), "text", F.when(title, "toc").otherwise("toc_item").alias("line_type"), F.when(title, float(depth)).otherwise(depth + 1.0).alias("level_1"), F.lit(0.0).alias("level_2"), F.lit(False).alias("can_be_multiline"))
    heads = rows.groupBy("doc_id").agg(F.min(F.struct("line_id", "line_type")).alias("x")).where("x.line_type = 'toc_item'")
    node = heads.select("doc_id", (F.col("x.line_id") - 1).alias("line_id"), F.lit("").alias("text"), F.lit("toc").alias("line_type"), F.lit(float(depth)).alias("level_1"), F.lit(0.0).alias("level_2"), F.lit(False).alias("can_be_multiline"))
    return rows.unionByName(node).withColumn("line_id", (F.row_number().over(order()) - 1).cast("long"))


def article_levels(lines: DataFrame) -> DataFrame:
    """Levels that the reader has given, raw text where it gave none."""
    return lines.select("doc_id", "line_id", "text", F.coalesce("tag_type", F.lit("raw_text")).alias("line_type"), F.col("tag_level_1").cast("double").alias("level_1"), F.col("tag_level_2").cast("double").alias("level_2"), F.col("tag_type").isNull().alias("can_be_multiline"))


def report_levels(lines: DataFrame, most: int = 6) -> DataFrame:
    """Titles of reports: blank lines go, signs at the ends too; a predicted depth (null: no
    title) becomes the second level of a header."""
    text = F.regexp_replace("text", r"(?U)^[\s.…_*-]+|[\s.…_*-]+$", "")
    rows = lines.withColumn("text", text).where("text <> ''")
    depth = F.when(F.col("depth").isNotNull(), F.least(F.col("depth"), F.lit(most))).cast("double")
    return rows.select("doc_id", "line_id", "text", F.when(depth.isNotNull(), "header").otherwise("raw_text").alias("line_type"), F.when(depth.isNotNull(), 1.0).alias("level_1"), depth.alias("level_2"), depth.isNull().alias("can_be_multiline"))
