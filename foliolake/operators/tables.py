"""Tables from boxes: rows, snapped borders, grids, headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rows_of_boxes(boxes: DataFrame, key: str = "table_id", gap: float = 15) -> DataFrame:
    """row_id and col_id of boxes in reading order `ord`: a new row where the upper edge
    moves by more than the gap, then from left to right."""
    w = Window.partitionBy(key).orderBy("ord")
    new = F.coalesce((F.abs(F.col("y") - F.lag("y").over(w)) > gap).cast("int"), F.lit(0))
    rows = boxes.withColumn("row_id", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return rows.withColumn("col_id", (F.row_number().over(Window.partitionBy(key, "row_id").orderBy("x", "ord")) - 1).cast("long"))


def _snap(borders: Column, threshold: Column) -> Column:
    """Sorted borders with the border that stands for each: the first within the threshold."""
    start = F.array().cast("array<struct<border:double,snap:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))["snap"]
        return F.array_append(acc, F.struct(x.alias("border"), F.when(x - last <= threshold, last).otherwise(x).alias("snap")))

    return F.aggregate(F.array_sort(F.array_distinct(borders)), start, step)


def split_cells(cells: DataFrame, key: str = "table_id", eps: float = 0.5) -> DataFrame:
    """Cells (key, ord, x, y, width, height, text) on the grid of their table's borders.
    Borders nearer than eps times the smallest side are one. The first place of a cell has its
    spans, the others are invisible; a later cell covers an earlier one. Places without a
    cell are empty. One group's state is one table's borders."""
    ends = lambda a, n: F.flatten(F.collect_list(F.array(F.col(a).cast("double"), (F.col(a) + F.col(n)).cast("double"))))
    edges = cells.groupBy(key).agg(ends("x", "width").alias("xs"), ends("y", "height").alias("ys"), (eps * F.min("width")).alias("ex"), (eps * F.min("height")).alias("ey"))
    maps = edges.select(key, _snap(F.col("xs"), F.col("ex")).alias("xs"), _snap(F.col("ys"), F.col("ey")).alias("ys"))
    at = lambda m, v: F.filter(m, lambda e: e["border"] == v.cast("double"))[0]["snap"]
    c = cells.join(maps, key).select(
        key, "ord", "text", at(F.col("xs"), F.col("x")).alias("l"), at(F.col("xs"), F.col("x") + F.col("width")).alias("r"), at(F.col("ys"), F.col("y")).alias("t"), at(F.col("ys"), F.col("y") + F.col("height")).alias("b")
    ).where("l < r AND t < b")
    sides = lambda a, b: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(a, b)))))
    grid = c.groupBy(key).agg(sides("l", "r").alias("gx"), sides("t", "b").alias("gy"))
    placed = c.join(grid, key)
    pos = lambda g, v: F.array_position(g, F.col(v)) - 1
    placed = placed.select(key, "ord", "text", pos("gy", "t").alias("top"), pos("gy", "b").alias("bottom"), pos("gx", "l").alias("left"), pos("gx", "r").alias("right"))
    spread = placed.select("*", F.explode(F.sequence("top", F.col("bottom") - 1)).alias("row_id")).select("*", F.explode(F.sequence("left", F.col("right") - 1)).alias("col_id"))
    first = (F.col("row_id") == F.col("top")) & (F.col("col_id") == F.col("left"))
    cell = F.struct("ord", "text", F.when(first, F.col("right") - F.col("left")).otherwise(1).cast("long").alias("colspan"), F.when(first, F.col("bottom") - F.col("top")).otherwise(1).cast("long").alias("rowspan"), (~first).alias("invisible"))
    top = spread.groupBy(key, "row_id", "col_id").agg(F.max(cell).alias("cell"))
    places = grid.select(key, F.explode(F.sequence(F.lit(0).cast("long"), (F.size("gy") - 2).cast("long"))).alias("row_id"), "gx").select(key, "row_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.size("gx") - 2).cast("long"))).alias("col_id"))
    got = places.join(top, [key, "row_id", "col_id"], "left")
    return got.select(key, "row_id", "col_id", F.coalesce("cell.text", F.lit("")).alias("text"), F.coalesce("cell.colspan", F.lit(1)).cast("long").alias("colspan"), F.coalesce("cell.rowspan", F.lit(1)).cast("long").alias("rowspan"), F.coalesce("cell.invisible", F.lit(False)).alias("invisible"))


def header_rows(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """key, n_header: leading rows whose cells are all attributes; all rows if none breaks off."""
    rows = cells.groupBy(key, "row_id").agg(F.min(F.col("is_attribute").cast("int")).alias("full"))
    return rows.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("full") == 0, F.col("row_id"))), F.max("row_id") + 1).cast("long").alias("n_header"))


def cell_text(lines: DataFrame) -> DataFrame:
    """Cells of lines, in their order."""
    parts = F.array_sort(F.collect_list(F.struct("line_id", "text")))
    return lines.groupBy("table_id", "row_id", "col_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def equal_headers(cells: DataFrame, share: float = 0.8) -> DataFrame:
    """table_id, equal_next: whether the next table's header (row_id, col_id, text) has the
    same shape and alike texts in every place."""
    from .evaluation import similarity

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[p] if p in known else known.setdefault(p, similarity(*p)) for p in zip(a, b)])

    place = ["table_id", "row_id", "col_id"]
    sizes = cells.groupBy("table_id").agg(F.count("*").alias("n"), F.max("row_id").alias("rows"))
    after = sizes.select((F.col("table_id") - 1).alias("table_id"), F.col("n").alias("m"), F.col("rows").alias("after_rows"))
    pairs = cells.join(cells.select((F.col("table_id") - 1).alias("table_id"), "row_id", "col_id", F.col("text").alias("other")), place)
    good = pairs.groupBy("table_id").agg(F.count("*").alias("met"), F.min((alike("text", "other") >= share).cast("int")).alias("ok"))
    both = sizes.join(after, "table_id", "left").join(good, "table_id", "left")
    same = (F.col("n") == F.col("m")) & (F.col("rows") == F.col("after_rows")) & (F.col("met") == F.col("n")) & (F.col("ok") == 1)
    return both.select("table_id", F.coalesce(same, F.lit(False)).alias("equal_next"))
