"""Features of lines and documents, as expressions and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec



def doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def order() -> WindowSpec:
    return doc().orderBy("line_id")


def shifted(lines: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Each column from k lines before and after, 0.0 beyond the ends."""
    out = [f(c, k, 0.0).over(order()).alias(f"{c}_{name}_{k}") for c in columns for k in range(1, n + 1) for name, f in (("prev", F.lag), ("next", F.lead))]
    return lines.select("doc_id", "line_id", *columns, *out)


def quantile(x: str) -> Column:
    """(rank - 1 + ties / 2) / n in the document."""
    r = F.rank().over(doc().orderBy(x)) - 1
    return F.round((r + F.count("*").over(Window.partitionBy("doc_id", x)) / 2) / F.count("*").over(doc()), 6)


def centred(x: str) -> Column:
    """(x - mean) / (max - min), 0 where all are equal."""
    span = F.max(x).over(doc()) - F.min(x).over(doc())
    return F.round(F.when(span == 0, 0.0).otherwise((F.col(x) - F.avg(x).over(doc())) / span), 6)


def distance_to_first(is_mark: Column) -> Column:
    """Lines since the first marked line of the document (negative before it), 0 without."""
    return F.coalesce(F.col("line_id") - F.min(F.when(is_mark, F.col("line_id"))).over(doc()), F.lit(0)).cast("long")


def same_indent(indent: str, width: int) -> tuple[Column, Column]:
    """In the frame of `width` lines before and width - 1 after: the population standard
    deviation, and the lines with an indent as near as a tenth of it, plus 1."""
    frame = order().rowsBetween(-width, width - 1)
    std = F.stddev_pop(indent).over(frame)
    near = F.size(F.filter(F.collect_list(indent).over(frame), lambda v: F.abs(v - F.col(indent)) <= 0.1 * F.col("std") + 1))
    return std, near


def list_continuity(lines: DataFrame) -> DataFrame:
    """doc_id, line_id, continues: 1 where a numbered line follows the numbered line
    before it by one, -1 where it doesn't, 0 for other lines. `number` is null there."""
    numbered = lines.where("number IS NOT NULL")
    step = F.col("number") - F.coalesce(F.lag("number").over(order()), F.lit(0))
    marked = numbered.select("doc_id", "line_id", F.when(step == 1, 1).otherwise(-1).alias("continues"))
    return lines.select("doc_id", "line_id").join(marked, ["doc_id", "line_id"], "left").select("doc_id", "line_id", F.coalesce("continues", F.lit(0)).cast("long").alias("continues"))


def carry_forward(x: Column) -> Column:
    """The last value that isn't null, this line's included."""
    return F.last(x, ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, 0))


def segments(body: Column, tail: Column) -> Column:
    """header before the first body line, body from there, cellar from the first tail line."""
    upto = order().rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda c: F.max(c.cast("int")).over(upto) == 1
    return F.when(seen(tail), "cellar").when(seen(body), "body").otherwise("header")


#: Classes of code points that a text layer is judged by.
LATIN, UPPER, DIGITS = ((65, 90), (97, 122)), ((65, 90),), ((48, 57),)
BRACKETS, BLANKS, SIGNS = tuple((ord(c), ord(c)) for c in "{}[]()"), ((32, 32), (10, 10)), ((33, 47), (58, 64))
TRASH = ((33, 33), (35, 38), (42, 42), (60, 60), (62, 62), (123, 126))
QUALITY = "doc_id long, n_chars long, latin_share double, upper_share double, digit_share double, bracket_share double, blank_share double, sign_share double, n_words long, mean_word double, longest_word long, median_word double, mean_code double, std_code double, median_code double, n_trash long"


def _quality(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in QUALITY.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.float64() for x in QUALITY.split(", ")]
    blank = np.zeros(0x110000, bool)
    blank[[9, 10, 32]] = True
    for batch in batches:
        rows = []
        for d, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            c = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
            n = len(c)
            count = lambda ranges: sum(int(((c >= a) & (c <= b)).sum()) for a, b in ranges)  # noqa: B023, E731
            shares = [count(x) / n if n else 0.0 for x in (LATIN, UPPER, DIGITS, BRACKETS, BLANKS, SIGNS)]
            ink = np.concatenate([[False], ~blank[c], [False]])
            edge = np.flatnonzero(ink[1:] != ink[:-1])
            size = edge[1::2] - edge[::2]
            words = [len(size), float(size.mean()), int(size.max()), float(np.median(size))] if len(size) else [0, None, 0, None]
            rows.append((d, n, *shares, *words, *((float(c.mean()), float(c.std()), float(np.median(c))) if n else (None,) * 3), count(TRASH)))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)


def text_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Features by which a text layer is judged: shares of classes of characters, words, code
    points, signs of trash. Numpy over the code points of a text: splitting it into one
    string a character costs several times as much."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_quality, QUALITY)
    return found.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in found.schema])


def transitions(text: str = "text") -> list[Column]:
    """Changes between neighbours: lower to upper, letter to digit, letter to sign."""
    pairs = lambda a, b: F.regexp_count(text, F.lit(f"(?<={a}){b}")).cast("long")
    return [pairs("[a-z]", "[A-Z]").alias("case_changes"), pairs("[A-Za-z]", "[0-9]").alias("digit_changes"), pairs("[A-Za-z]", "[!-/:-@]").alias("sign_changes")]


#: Fixed value: an item of a table of contents, and its page.
TOC_ITEM = r"^(.*[^\s.…])?[….\s]+(\d{1,3})(-\d{1,3})?$"


def toc(lines: DataFrame) -> DataFrame:
    """Lines that look like items of a table of contents, with their pages. A document
    has one if more than 6 such lines are there and their pages don't fall."""
    page = F.regexp_extract("text", TOC_ITEM, 2).try_cast("long")
    items = lines.withColumn("page", page).where(F.col("text").rlike(TOC_ITEM))
    falls = F.col("page") < F.lag("page").over(order())
    items = items.withColumn("falls", F.coalesce(falls, F.lit(False)))
    return items.withColumn("is_toc", (F.count("*").over(doc()) > 6) & ~F.max("falls").over(doc())).select("doc_id", "line_id", "page", "is_toc")
