"""Document trees from levelled lines.

The builder folds each document's lines in order with a stack, in one narrow pass over
partitions that hold whole documents, sorted: memory is the stack of one document,
whatever its length. The relational forms say the same with windows and joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INF = float("inf")
NODES = "doc_id long, node long, parent long, ord long, node_id string, depth long, line_type string, level_1 double, level_2 double, n_lines long, text string"


def rank(l1: Column, l2: Column) -> Column:
    """The order of levels as a struct; null is the lowest level."""
    inf = F.lit(INF)
    return F.struct(F.coalesce(l1, inf).alias("a"), F.coalesce(l2, inf).alias("b"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc, lists = None, []
    for batch in batches:
        out = []
        for d, i, kind, l1, l2 in zip(*(batch[c].to_pylist() for c in ("doc_id", "line_id", "line_type", "level_1", "level_2")), strict=True):
            if d != doc:
                doc, lists = d, []
            if kind == "list_item":
                hl = (INF if l1 is None else l1, INF if l2 is None else l2)
                while lists and lists[-1] > hl:
                    lists.pop()
                if not lists or lists[-1] < hl:
                    out.append((d, i, l1, None if l2 is None else l2 - 0.5))
                    lists.append(hl)
            elif kind != "raw_text":
                lists = []
        cols = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "line_id", "level_1", "level_2"])


def insert_lists(lines: DataFrame) -> DataFrame:
    """The lines before which a list begins: doc_id, line_id, level_1, level_2 of the
    list. Of the list items since the last other line (not raw text), the nearest one
    before that isn't deeper decides: none, or a higher one, opens a list. A fold with the
    open lists as state."""
    rows = lines.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line_id").cast("long").alias("line_id"), "line_type", F.col("level_1").cast("double"), F.col("level_2").cast("double"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "line_id").mapInArrow(_lists, "doc_id long, line_id long, level_1 double, level_2 double")


def _fold(batches: Iterator[pa.RecordBatch], places: bool = False) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "node", "parent", "ord", "node_id", "depth", "line_type", "level_1", "level_2", "n_lines", "text"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
    out: list[tuple] = []
    at: list[tuple] = []  # line, node, where its text begins there
    doc: int | None = None
    stack: list[list] = []  # [hl, node, children, node_id, depth]
    lists: list[tuple] = []
    node: list | None = None  # the row under construction; its text grows by merging
    root: list = []
    count = width = 0

    def put(row: list) -> None:
        out.append((*row[:10], "".join(row[10])))

    def close() -> None:
        if node is not None:
            put(node)
        if doc is not None:
            put(root)

    def attach(kind: str, hl: tuple, text: str) -> list:
        nonlocal count
        while stack[-1][0] >= hl:
            stack.pop()
        up = stack[-1]
        count += 1
        made = f"{up[3]}.{up[2]}"
        row = [doc, count, up[1], up[2], made, up[4] + 1, kind, *(None if x == INF else x for x in hl), 1, [text]]
        up[2] += 1
        stack.append([hl, count, 0, made, up[4] + 1])
        return row

    def flush() -> pa.RecordBatch:
        if places:
            out.clear()
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*at, strict=True)] if at else [pa.array([], pa.int64())] * 4, ["doc_id", "line_id", "node", "offset"])
            at.clear()
            return made
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        return made

    for batch in batches:
        cols = (batch[c].to_pylist() for c in ("doc_id", "line_id", "text", "line_type", "level_1", "level_2", "can_be_multiline"))
        for d, line, text, kind, l1, l2, more in zip(*cols, strict=True):
            if d != doc:
                close()
                doc, count, node, lists = d, 0, None, []
                root = [d, 0, None, 0, "0", 0, "root", 0.0, 0.0, 0, []]
                stack = [[(-1.0, -1.0), 0, 0, "0", 0]]
            hl = (INF if l1 is None else l1, INF if l2 is None else l2)
            if hl == (0, 0):  # a part of the document's name, wherever it stands
                if places:
                    at.append((d, line, 0, sum(map(len, root[10]))))
                root[10].append(text or "")
                root[9] += 1
                continue
            if kind == "list_item":
                while lists and lists[-1] > hl:
                    lists.pop()
                if not lists or lists[-1] < hl:
                    if node is not None:
                        put(node)
                    node = attach("list", (hl[0], hl[1] - 0.5), "")
                    lists.append(hl)
            elif kind != "raw_text":
                lists = []
            if node is not None and more and kind == node[6] and hl == stack[-1][0]:
                if places:
                    at.append((d, line, node[1], width))
                    width += len(text or "")
                node[10].append(text or "")
                node[9] += 1
            else:
                if node is not None:
                    put(node)
                node = attach(kind, hl, text or "")
                if places:
                    at.append((d, line, node[1], 0))
                    width = len(text or "")
            if len(out) >= 10_000:
                yield flush()
    close()
    if out:
        yield flush()


def _sorted(lines: DataFrame) -> DataFrame:
    cols = ["doc_id", "line_id", "text", "line_type", "level_1", "level_2", "can_be_multiline"]
    rows = lines.select(*cols).repartition("doc_id").sortWithinPartitions("doc_id", "line_id")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line_id").cast("long").alias("line_id"), "text", "line_type", F.col("level_1").cast("double"), F.col("level_2").cast("double"), "can_be_multiline")


def build_tree(lines: DataFrame) -> DataFrame:
    """Nodes of every document: see NODES; node 0 is the root, ids are paths."""
    return _sorted(lines).mapInArrow(_fold, NODES)


def line_places(lines: DataFrame) -> DataFrame:
    """doc_id, line_id, node, offset: the node that holds each line, and where the line's
    text begins in it."""
    return _sorted(lines).mapInArrow(lambda batches: _fold(batches, True), "doc_id long, line_id long, node long, offset long")


def node_annotations(lines: DataFrame, spans: DataFrame, fixed: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, node, name, value, start, end: the lines' annotations (doc_id, line_id, name,
    value, start, end) moved into the nodes' texts, merged and freed of contradictions."""
    from . import annotations

    moved = spans.join(line_places(lines), ["doc_id", "line_id"]).select("doc_id", "node", "name", "value", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"))
    texts = build_tree(lines).select("doc_id", "node", "text")
    keys = ["doc_id", "node"]
    return annotations.resolve(annotations.merge_bridged(moved, texts, keys, fixed), texts, keys, fixed)


def page_spans(lines: DataFrame) -> DataFrame:
    """doc_id, node, page_id, start, end: the parts of nodes that lie on another page than
    their first line; neighbours on one page are one part. lines have page_id too."""
    rows = line_places(lines).join(lines.select("doc_id", "line_id", "page_id", F.length("text").alias("size")), ["doc_id", "line_id"])
    w = Window.partitionBy("doc_id", "node").orderBy("line_id")
    away = rows.withColumn("home", F.first("page_id").over(w)).where("page_id <> home")
    new = F.coalesce((F.col("page_id") != F.lag("page_id").over(w)).cast("int"), F.lit(1))
    parts = away.withColumn("part", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("doc_id", "node", "part").agg(F.min("page_id").alias("page_id"), F.min("offset").alias("start"), F.max(F.col("offset") + F.col("size")).cast("long").alias("end")).drop("part")


def traversal(nodes: DataFrame) -> DataFrame:
    """doc_id, node, root, ancestors (nearest first), breadth and depth-first positions. A
    node's ancestors are the prefixes of its path, so nothing is climbed."""
    parts = F.split("node_id", "[.]")
    up = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    chain = F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))
    number = F.transform(parts, lambda x: x.cast("long"))
    wide = F.row_number().over(Window.partitionBy("doc_id").orderBy("depth", number)) - 1
    deep = F.row_number().over(Window.partitionBy("doc_id").orderBy(number)) - 1
    return nodes.select("doc_id", "node", parts[0].alias("root"), F.array_join(chain, ",").alias("ancestors"), wide.cast("long").alias("breadth"), deep.cast("long").alias("preorder"))


def item_before(a: Column, b: Column) -> Column:
    """Whether list item a (its numbers) comes before b."""
    return a < b


def item_above(a: Column, b: Column) -> Column:
    """Whether list item a is the item that b lies directly below."""
    return (F.size(a) == F.size(b) - 1) & (F.slice(b, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0))) == a)


def linear(lines: DataFrame) -> DataFrame:
    """An empty root for each document and one node a line below it."""
    w = Window.partitionBy("doc_id").orderBy("line_id")
    below = lines.select("doc_id", F.concat(F.lit("0."), (F.row_number().over(w) - 1).cast("string")).alias("node_id"), "text")
    return below.unionByName(lines.select("doc_id").distinct().select("doc_id", F.lit("0").alias("node_id"), F.lit("").alias("text")))


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc, stack = None, []
    for batch in batches:
        docs, numbers = batch["doc_id"].to_pylist(), batch["node"].to_pylist()
        found: list[int | None] = []
        for d, k, l1, l2 in zip(docs, numbers, batch["level_1"].to_pylist(), batch["level_2"].to_pylist(), strict=True):
            if d != doc:
                doc, stack = d, []
            hl = (-1.0, -1.0) if k == 0 else (INF if l1 is None else l1, INF if l2 is None else l2)
            while stack and stack[-1][0] >= hl:
                stack.pop()
            found.append(stack[-1][1] if stack else None)
            stack.append((hl, k))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["node"], pa.array(found, pa.int64())], ["doc_id", "node", "parent"])


def parents(nodes: DataFrame) -> DataFrame:
    """doc_id, node, parent from levels alone: the last node before with a smaller level, by
    a fold with a stack, so the time is linear in the nodes."""
    rows = nodes.select("doc_id", "node", "level_1", "level_2").repartition("doc_id").sortWithinPartitions("doc_id", "node")
    return rows.mapInArrow(_parents, "doc_id long, node long, parent long")


def depth_stats(nodes: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("line_type") == k).alias(f"n_{k}")
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("max_depth"), kind("header"), kind("list"), kind("list_item"), kind("raw_text"))


def render(nodes: DataFrame) -> DataFrame:
    """Each document's text in pre-order, which is the order of nodes."""
    parts = F.array_sort(F.collect_list(F.struct("node", "text")))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
