"""Lines of documents: splitting, indentation, spacing, paragraphs, slices, concatenation.

A line is a row; (doc_id, line_id) is the order. Windows over a document share one
exchange on doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_id, text; a narrow operation."""
    return docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("line_id", "text"))


def leading_blanks(c: Column, tab: int) -> Column:
    lead = F.regexp_extract(c, r"^[ \t]*", 0)
    return F.length(F.replace(lead, F.lit("\t"), F.lit(" " * tab))).cast("long")


def with_layout(lines: DataFrame) -> DataFrame:
    """Adds indentation (211 a blank, a tab is 3), spacing (100 x blank lines before,
    50 at least) and can_be_multiline (false where the indentation grows by 2 or more,
    a tab being 4). Blank lines are dropped."""
    by_doc = Window.partitionBy("doc_id").orderBy("line_id")
    blank = F.trim(F.translate("text", "\t", " ")) == ""
    seen = lines.withColumn("filled", F.when(~blank, F.col("line_id")))
    before = F.last("filled", ignorenulls=True).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("gap", F.col("line_id") - F.coalesce(before, F.lit(-1)) - 1).where(~blank)
    width = leading_blanks(F.col("text"), 4)
    step = width - F.coalesce(F.lag(width).over(by_doc), F.lit(0))
    return seen.select(
        "doc_id", "line_id", "text", (leading_blanks(F.col("text"), 3) * 211).alias("indentation"),
        (F.greatest(F.lit(0.5), F.col("gap").cast("double")) * 100).cast("long").alias("spacing"), (step < 2).alias("can_be_multiline"),
    )


def merge_runs(rows: DataFrame, doc: str, order: str, key: str, text: str = "text", sep: str = "\n") -> DataFrame:
    """Consecutive rows with one key as one row: islands by lag, then an ordered fold."""
    w = Window.partitionBy(doc).orderBy(order)
    new = (F.lag(key).over(w).isNull() | (F.lag(key).over(w) != F.col(key))).cast("int")
    runs = rows.withColumn("run", F.sum(new).over(w).cast("long"))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return runs.groupBy(doc, "run", key).agg(F.array_join(F.transform(parts, lambda x: x[text]), sep).alias("text"), F.count("*").alias("n_rows"))


def clip(annotations: Column, start: int, stop: int) -> Column:
    """Annotations of the slice [start:stop], based on its start."""
    kept = F.filter(annotations, lambda a: (a["end"] > start) & (a["start"] < stop))
    cut = lambda x: F.greatest(F.lit(0).cast("long"), F.least(x, F.lit(stop).cast("long")) - start)
    return F.transform(kept, lambda a: F.struct(cut(a["start"]).alias("start"), cut(a["end"]).alias("end"), a["name"].alias("name"), a["value"].alias("value")))


def shift(annotations: Column, by: Column) -> Column:
    return F.transform(annotations, lambda a: F.struct((a["start"] + by).alias("start"), (a["end"] + by).alias("end"), a["name"].alias("name"), a["value"].alias("value")))


def head_and_rest(lines: DataFrame, pattern: str) -> DataFrame:
    """Each line cut after a match at its start: the head keeps its type, the rest is
    raw text with the uid of the line and _split; empty rests are dropped."""
    head = F.regexp_extract("text", f"^(?:{pattern})", 0)
    rest = F.substring("text", F.length(head) + 1, F.length("text"))
    two = F.array(F.struct(F.lit(0).alias("part"), F.when(head == "", F.col("text")).otherwise(head).alias("text")), F.struct(F.lit(1).alias("part"), F.when(head != "", rest).alias("text")))
    return lines.select("doc_id", "line_id", F.explode(F.filter(two, lambda x: (x["part"] == 0) | (F.coalesce(x["text"], F.lit("")) != ""))).alias("x")).select("doc_id", "line_id", "x.part", "x.text")


def offsets(text: str = "text", sep: int = 1) -> Column:
    """Where each line starts when a document's lines are joined by a delimiter of a length;
    annotations of the line move by it, see shift()."""
    before = Window.partitionBy("doc_id").orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.length(text) + sep).over(before), F.lit(0)).cast("long")


def join_lines(lines: DataFrame, sep: str = "\n") -> DataFrame:
    """doc_id, text, annotations: a document's lines as one, annotations moved along. The
    offsets are a window's running sum; a document is one row of the result."""
    moved = lines.select("doc_id", "line_id", "text", shift(F.col("annotations"), offsets("text", len(sep))).alias("annotations"))
    rows = moved.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "text", "annotations"))).alias("rows"))
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: r["text"]), sep).alias("text"), F.flatten(F.transform("rows", lambda r: r["annotations"])).alias("annotations"))


def post_split(lines: DataFrame, kinds: list[str], patterns: list[tuple[str, str | None]]) -> DataFrame:
    """Lines (doc_id, line_id, text, line_type, uid) of some types cut after the first
    pattern that matches at their start, or before what its second pattern finds in the
    match. The rest becomes raw text with the uid and _split; empty raw text is dropped."""
    head = F.lit("")
    for pattern, stop in reversed(patterns):
        found = F.regexp_extract("text", f"^(?:{pattern})", 0)
        cut = F.regexp_extract(found, f"^(.*?)(?:{stop})", 1) if stop else found
        head = F.when(F.col("text").rlike(f"^(?:{pattern})"), F.when(found.rlike(stop), cut).otherwise(found) if stop else found).otherwise(head)
    head = F.when(F.col("line_type").isin(*kinds), head).otherwise("")
    rows = lines.where((F.col("line_type") != "raw_text") | (F.col("text") != "")).withColumn("head", head)
    whole = F.struct(F.lit(0).alias("part"), F.when(F.col("head") != "", F.col("head")).otherwise(F.col("text")).alias("text"), F.col("uid").alias("uid"), F.col("line_type").alias("line_type"))
    rest = F.struct(F.lit(1).alias("part"), F.substring("text", F.length("head") + 1, F.length("text")).alias("text"), F.concat("uid", F.lit("_split")).alias("uid"), F.lit("raw_text").alias("line_type"))
    pieces = F.when((F.col("head") != "") & (F.length("text") > F.length("head")), F.array(whole, rest)).otherwise(F.array(whole))
    return rows.select("doc_id", "line_id", F.explode(pieces).alias("x")).select("doc_id", "line_id", "x.*")
