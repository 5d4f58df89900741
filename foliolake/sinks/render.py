"""Trees of nodes as HTML rows, JSON and label files; nodes come from operators.tree."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def path(node_id: Column) -> Column:
    """A node's id as numbers, which sort in pre-order."""
    return F.transform(F.split(node_id, "[.]"), lambda x: x.cast("long"))


def html_rows(nodes: DataFrame) -> DataFrame:
    """One paragraph a node, indented by depth, with its id and type."""
    row = F.concat(F.lit("<p>"), F.expr("repeat('&nbsp;', cast(4 * depth AS int))"), F.lit("<b>"), "node_id", F.lit(" "), "line_type", F.lit("</b> "), escaped(F.col("text")), F.lit("</p>"))
    return nodes.select("doc_id", "node", row.alias("html"))


def html_pages(nodes: DataFrame) -> DataFrame:
    """A page for each document."""
    rows = html_rows(nodes).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node", "html"))).alias("rows"))
    return rows.select("doc_id", F.concat(F.lit("<html><body>\n"), F.array_join(F.transform("rows", lambda x: x["html"]), "\n"), F.lit("\n</body></html>")).alias("html"))


def json_nodes(nodes: DataFrame) -> DataFrame:
    """Each node as a JSON object of the document schema; children are found by id."""
    meta = F.struct(F.col("line_type").alias("paragraph_type"), F.col("n_lines").alias("n_lines"))
    return nodes.select("doc_id", "node", F.to_json(F.struct("node_id", "text", meta.alias("metadata"))).alias("json"))


def label_columns() -> list[Column]:
    """Columns of lines (text, page_id, line_id, uid) with the names of labelling tasks."""
    return [F.col("text").alias("_line"), F.struct("page_id", "line_id").alias("_metadata"), F.col("uid").alias("_uid")]


def write_labels(lines: DataFrame, folder: str) -> None:
    """Lines as JSON lines, appended."""
    lines.select(*label_columns()).write.mode("append").json(folder)


def html_tables(cells: DataFrame) -> DataFrame:
    """table_id, html: cells (row_id, col_id, text, colspan, rowspan, invisible) as a table;
    invisible places of spans are left out."""
    cell = F.concat(F.lit('<td colspan="'), F.col("colspan").cast("string"), F.lit('" rowspan="'), F.col("rowspan").cast("string"), F.lit('">'), escaped(F.col("text")), F.lit("</td>"))
    seen = cells.where("NOT invisible").groupBy("table_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", cell.alias("html")))).alias("cells"))
    rows = seen.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_id", F.array_join(F.transform("cells", lambda x: x["html"]), "").alias("html")))).alias("rows"))
    return rows.select("table_id", F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda x: F.concat(F.lit("<tr>"), x["html"], F.lit("</tr>"))), ""), F.lit("</table>")).alias("html"))


def collapsed_pages(nodes: DataFrame, width: int = 60) -> DataFrame:
    """A page for each document in which nodes fold: the summary is a node's id, type and
    first letters, the rest of its text and its children are inside."""
    deep = F.lead("depth").over(Window.partitionBy("doc_id").orderBy("node"))
    cut = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("..."))).otherwise(F.col("text"))
    more = F.when(F.length("text") > width, F.concat(F.lit("<p>"), escaped(F.col("text")), F.lit("</p>"))).otherwise("")
    open_ = F.concat(F.lit("<details><summary>"), "node_id", F.lit(" "), "line_type", F.lit(" "), escaped(cut), F.lit("</summary>"), more)
    close = F.expr("repeat('</details>', cast(greatest(depth - after + 1, 0) AS int))")
    rows = nodes.withColumn("after", F.coalesce(deep, F.lit(0))).select("doc_id", "node", F.concat(open_, close).alias("html"))
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node", "html"))).alias("rows"))
    return joined.select("doc_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("rows", lambda x: x["html"]), "\n"), F.lit("</body></html>")).alias("html"))


def documents(nodes: DataFrame, indent: int | None = None) -> DataFrame:
    """doc_id, json: a document as nested JSON, children in their parent's subparagraphs.
    Nodes come sorted within partitions that hold whole documents; the state is the open
    document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root, at = None, None, {}

        def done() -> pa.RecordBatch:
            text = json.dumps({"content": {"structure": root, "tables": []}, "metadata": {"uid": f"doc_{now}"}, "attachments": []}, ensure_ascii=False, indent=indent)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([text])], ["doc_id", "json"])

        for batch in batches:
            for r in batch.to_pylist():
                made = {"node_id": r["node_id"], "text": r["text"], "annotations": [], "metadata": {"paragraph_type": r["line_type"], "n_lines": r["n_lines"]}, "subparagraphs": []}
                if r["doc_id"] != now:
                    if now is not None:
                        yield done()
                    now, root, at = r["doc_id"], made, {}
                else:
                    at[r["parent"]]["subparagraphs"].append(made)
                at[r["node"]] = made
        if now is not None:
            yield done()

    rows = nodes.select("doc_id", "node", "parent", "node_id", "text", "line_type", "n_lines").repartition("doc_id").sortWithinPartitions("doc_id", "node")
    return rows.mapInArrow(run, "doc_id long, json string")


def api_schema(nodes: DataFrame) -> DataFrame:
    """A row a document: its nodes as an array of structs of the document schema, by path."""
    node = F.struct(path(F.col("node_id")).alias("at"), "node_id", "text", F.struct(F.col("line_type").alias("paragraph_type"), F.col("level_1"), F.col("level_2")).alias("metadata"))
    return nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(node)).alias("structure"))
